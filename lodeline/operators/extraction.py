"""Rule-based facts from sentences, as native columns and joins.

Cue words are parameters; the defaults are patterns of English narrative. Null
sentences give UNKNOWN or no fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cues of travel by sea and by land, and what makes a cue unasserted before it.
SEA = r"sailed|sailing|embarked|embark|set\s+sail|crossed\s+the\s+sea"
LAND = r"marched|marching|rode|riding|travelled\s+overland|traveled\s+overland"
UNASSERTED = r"did\s+not|didn't|never|planned\s+to|might|intended\s+to|intends\s+to|would"

# Outcomes of movements that were not completed, first match first.
OUTCOMES = (
    ("PREVENTED", r"(?:prevented|blocked|stopped)\b(?!\s+before\b)"),
    ("ABORTED", r"(?:abandoned|aborted|stopped\s+before)\b"),
    ("PLANNED", r"(?:planned|intended|proposed)\s+to\b"),
    ("ATTEMPTED", r"attempted\s+to\b"),
    ("NEGATED", r"(?:did\s+not|didn't|never)\s+(?:enter|march|sail|move|reach)\b"),
)
MOVEMENT = r"enter(?:ed|ing)?|march(?:ed|ing)?|sail(?:ed|ing)?|moved?|reach(?:ed|ing)?|advance"
MODAL = r"if|might|would|could|may|should"

#: The role that a preposition gives to the place after it; others are RELATED_PLACE.
ROLES = {"at": "EVENT_SITE", "from": "ORIGIN", "to": "DESTINATION", "into": "DESTINATION"}
MENTION = r"(?:^|[^A-Za-z])({prepositions})\s+([A-Z][a-z]+)"

# Verbs of movement, where clauses part, and auxiliaries that a negation may follow.
VERBS = r"marched|marches|marching|march|advanced|proceeded|moved|travelled|traveled|departed|arrived|entered|crossed|withdrew|retreated|fled|left|leaving|reached|came|passed|sailed|embarked|landed|went|returned|repassed|travel|escaped|descended|made\s+(?:his|her|their)\s+way"
#: Any case, and letters beyond ASCII are letters of words too.
ANY = "(?iU)"
CLAUSES = r"[,;]|\bbut\b|\band\b"
AUXILIARIES = "did|does|do|had|has|have|was|were|is|are|could|would|should|might|may"

# Cues that leave a movement open, unasserted or prevented, before its verb.
OPEN = r"would|could|might|should|may|planned\s+to|intended\s+to|wanted\s+to|hoped\s+to|feared\s+(?:that|lest)|if|discussed|debated|considered|contemplated|(?:prevented|stopped|blocked|forbidden|barred|hindered)(?:\s+\w+){0,8}\s+from"

# A retrospective reference, and the kinds of events in order of preference.
RETROSPECTIVE = r"\b(?:after|following|because of|since)\s+(?:the\s+)?(?:battle|defeat|death|murder|assassination)\b[^,;:.]*[,;:]?\s*"
KINDS = (
    ("ASSASSINATION", r"assassinated|assassination|murdered"),
    ("REFORM", r"reform(?:ed)?|reformers?|land law|legislation|proposed a law"),
    ("BATTLE", r"battle|fought at|defeated .* at"),
    ("SIEGE", r"siege|besieged"),
    ("TREATY", r"treaty|peace agreement|concluded peace"),
    ("ELECTION", r"elected|election|chosen as"),
    ("REBELLION", r"rebellion|revolt(?:ed)?|uprising|insurrection"),
    ("MOVEMENT", None),
    ("MILITARY", r"campaign|army|war|invaded|conquered|captured"),
    ("POLITICAL", r"senate .*\bdecree|tribune .*\b(?:proposed|elected|opposed)|consul .*\b(?:appointed|elected|sent)|assembly .*\b(?:elected|passed)|issued a decree"),
)


def negated(verbs: str = VERBS) -> str:
    """A pattern for a negation and the last verb among the four words after it; "not"
    reaches so far only after an auxiliary, else the next word alone."""
    reach = r"(?:[^\w']+[\w']+){0,3}[^\w']+"
    return rf"(?:(?:\bnever|\bno\s+longer|\w+n't|\b(?:{AUXILIARIES})\s+not){reach}|\bnot\s+)(?:{verbs})\b"


def moves(sentence: Column, verbs: str = VERBS, completed: bool = False, opened: str = OPEN) -> Column:
    """Whether a clause asserts a movement that no negation governs; with completed, also
    without a cue before its verb that leaves it open. Null sentences assert none."""

    def holds(clause: Column) -> Column:
        found = F.regexp_replace(clause, ANY + negated(verbs), " ").rlike(rf"{ANY}\b(?:{verbs})\b")
        return found & ~clause.rlike(rf"{ANY}\b(?:{opened})\b.*\b(?:{verbs})\b") if completed else found

    return F.coalesce(F.exists(F.split(sentence, ANY + CLAUSES), holds), F.lit(False))


def event_kind(sentence: Column, kinds=KINDS, retrospective: str = RETROSPECTIVE, verbs: str = VERBS) -> Column:
    """The first kind that the sentence shows without its retrospective reference; a kind
    without a pattern needs an asserted movement. UNKNOWN if there is none."""
    main = F.regexp_replace(sentence, ANY + retrospective, "")
    found = F.lit("UNKNOWN")
    for name, pattern in reversed(kinds):
        shown = moves(main, verbs) if pattern is None else main.rlike(rf"{ANY}\b(?:{pattern})\b")
        found = F.when(shown, name).otherwise(found)
    return found


def transition(port: Column, before: Column, after: Column, by_land: Column, by_sea: Column, evidence: Column) -> Column:
    """Whether a route may change its mode at a port: DENIED without a port, a change or
    access both ways, ALLOWED on confirmed or supported evidence, else UNKNOWN."""
    denied = port.isNull() | before.eqNullSafe(after) | ~F.coalesce(by_land & by_sea, F.lit(False))
    return F.when(denied, "DENIED").when(evidence.isin("CONFIRMED", "SUPPORTED"), "ALLOWED").otherwise("UNKNOWN")


def travel_mode(sentence: Column, sea: str = SEA, land: str = LAND, unasserted: str = UNASSERTED) -> Column:
    """SEA or LAND if cues of exactly one are asserted, else UNKNOWN."""
    asserted = F.regexp_replace(sentence, rf"(?i)\b(?:{unasserted})\s+(?:{sea}|{land})\b", " ")
    wet, dry = asserted.rlike(rf"(?i)\b(?:{sea})\b"), asserted.rlike(rf"(?i)\b(?:{land})\b")
    return F.when(wet & ~dry, "SEA").when(dry & ~wet, "LAND").otherwise("UNKNOWN")


def outcome(sentence: Column, movement: str = MOVEMENT, modal: str = MODAL, outcomes=OUTCOMES) -> Column:
    """How a movement failed to be completed; null for sentences without one or with a modal."""
    applies = sentence.rlike(rf"(?i)\b(?:{movement})\b") & ~sentence.rlike(rf"(?i)\b(?:{modal})\b")
    found = F.lit(None).cast("string")
    for name, pattern in reversed(outcomes):
        found = F.when(sentence.rlike(rf"(?i)\b{pattern}"), name).otherwise(found)
    return F.when(applies, found)


def place_role(preposition: Column, roles: dict[str, str] = ROLES) -> Column:
    role = F.lit("RELATED_PLACE")
    for word, name in roles.items():
        role = F.when(F.lower(preposition) == word, name).otherwise(role)
    return role


def place_mentions(rows: DataFrame, by: str, text: str, prepositions: str = "at|from|to|into|in|near|through", roles: dict[str, str] = ROLES, mention: str = MENTION) -> DataFrame:
    """(by, ordinal, place, role): a row for each preposition and name after it, in order."""
    pattern = F.lit(mention.format(prepositions=prepositions))
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("preposition"), F.regexp_extract_all(text, pattern, 2).alias("place"))
    found = rows.select(by, F.posexplode(both).alias("ordinal", "m"))
    return found.select(by, "ordinal", F.col("m.place").alias("place"), place_role(F.col("m.preposition"), roles).alias("role"))


def mention_inventory(mentions: DataFrame, by: str) -> DataFrame:
    """(by, place, first, n, roles): each place once, where it comes first and all its roles."""
    return mentions.groupBy(by, "place").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def continuation(rows: DataFrame, by: str, pos: str, destination: str, cue: Column) -> DataFrame:
    """rows with origin: after a continuation cue, the destination of the row before it."""
    before = F.lag(destination).over(Window.partitionBy(by).orderBy(pos))
    return rows.withColumn("origin", F.when(cue, before))


def declared_events(rows: DataFrame, event: str, sequence: str, period: str, description: str, step: str) -> DataFrame:
    """(event, status, n, steps): an event is OK if its rows agree on period and description
    (nulls are a value of their own) and their sequence numbers differ; else the first
    condition it breaks. Steps are joined in sequence order, null unless OK."""
    one = lambda c: F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(F.lit(0), F.count(F.lit(1)))
    found = rows.groupBy(event).agg(
        F.count(F.lit(1)).alias("n"),
        one(period).alias("same_period"),
        one(description).alias("same_description"),
        F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("at"), F.col(step).alias("step")))).alias("all"),
    )
    places = F.transform("all", lambda x: x["at"])
    status = F.when(~F.col("same_period"), "PERIOD_CONFLICT").when(~F.col("same_description"), "DESCRIPTION_CONFLICT").when(F.size(F.array_distinct(places)) < F.col("n"), "SEQUENCE_CONFLICT").otherwise("OK")
    steps = F.array_join(F.transform("all", lambda x: x["step"].cast("string")), ">")
    return found.select(event, status.alias("status"), "n", F.when(status == "OK", steps).alias("steps"))


def unsupported(phrases: DataFrame, vocabulary: DataFrame, on: list[str]) -> DataFrame:
    """The distinct phrases that the query and the evidence of the same answer don't hold."""
    return phrases.select(*on).distinct().join(vocabulary.select(*on).distinct(), on, "left_anti")


def authority_class(locations: DataFrame, place: str) -> DataFrame:
    """(place, points, authority) from (place, lon, lat, representative) rows. Rows with a null
    coordinate are locations that are not points. Points are counted by a partial aggregate
    for each distinct point first, so a place with many copies stays small."""
    is_point = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    folded = locations.groupBy(place, F.when(is_point, F.struct("lon", "lat")).alias("point")).agg(F.max("representative").alias("representative"))
    found = folded.groupBy(place).agg(F.count("point").alias("points"), F.coalesce(F.max(F.when(F.col("point").isNotNull(), F.col("representative"))), F.lit(False)).alias("any"))
    n = F.col("points")
    kind = F.when(n == 0, "NON_POINT_GEOMETRY").when(n >= 3, "MULTI_LOCATION_CONFLICT").when(F.col("any"), "REPRESENTATIVE_ONLY").when(n >= 2, "MULTI_LOCATION_CONFLICT").otherwise("SOURCE_POINT_UNCERTAIN")
    return found.select(place, "points", kind.alias("authority"))
