"""Predicates and verdicts as columns: they prune rows or say why a row is out, and move no data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of pages that are not indexed.
NON_BODY = ("front_matter", "advertisement", "copyright", "toc", "gutenberg_footer")

# How navigational text begins, and headings that are navigation.
NAVIGATION_STARTS = ("the following is contained", "table of contents", "contents", "this ebook is for the use")
NAVIGATION_HEADING = r"(?i)^\s*(?:index|contents|table of contents)\.?\s*$"
NAVIGATION_SOURCES = ("toc", "contents", "navigation", "index")
NUMBERED_BOOKS = r"(?i)^\s*book\s+[ivxlcdm0-9]+\.?\s+(?:[0-9]+\s+){8,}"

# Queries about routes, polar questions, and cues of a wanted route.
ROUTE_QUERY = r"(?i)\b(?:route|march(?:ed|ing)?|movements?|moved|advance(?:d|ment)?|cross(?:ed|ing)?|journey|expedition)\b"
POLAR_QUERY = r"(?i)^\s*(?:did|does|do|was|were|is|are|has|have|had)\b"
ROUTE_CUE = r"(?i)\b(?:trace|reconstruct|map|follow|show|route|routes|journey|expedition)\b"

#: Named boxes as (name, least latitude, least longitude, most latitude, most longitude).
BASINS = (
    ("western_anatolia", 35.5, 25.5, 42.5, 32.0),
    ("hispania", 35.5, -10.0, 44.0, 4.5),
    ("north_africa", 24.0, -12.0, 38.0, 25.0),
    ("near_east", 24.0, 30.0, 42.0, 55.0),
    ("bactria_india", 23.0, 60.0, 42.0, 85.0),
)

# What coordinates of each kind of feature mean, and which kinds block or allow uses.
COORDINATE_ROLES = {
    "sea": "feature_reference",
    "strait": "feature_reference",
    "river": "representative_point",
    "mountain_region": "regional_centroid",
    "region": "regional_centroid",
    "island": "feature_centroid",
    "pass": "exact_site",
    "port": "exact_site",
}
NO_POINT = ("sea", "strait", "river", "mountain_region", "region", "island")
TRAVERSED = ("sea", "strait", "river", "mountain_region", "pass")
SIMULATED = ("settlement", "port")
# Place types that can't be an endpoint or be traversed.
NO_ENDPOINT = ("plaza", "label", "labeled feature")
NO_TRAVERSAL = ("province", "province-2", "diocese-roman", "plaza", "label", "labeled feature")


def equals(wanted: dict[str, object]) -> Column:
    """All of the values that are not empty hold; parquet readers get them as pushed filters."""
    given = [F.col(k) == F.lit(v) for k, v in wanted.items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def page_type(text: Column, page: Column, book: Column) -> Column:
    """The first rule that fits; only the first 15 or 20 pages can be matter before the body."""
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return (
        F.when(has("project gutenberg", "gutenberg-tm"), "gutenberg_footer")
        .when((page < 15) & has("contents"), "toc")
        .when((page < 15) & has("copyright", "all rights reserved"), "copyright")
        .when((page < 20) & has("dictionary", "published by", "advertisement"), "advertisement")
        .when(page < 20, "front_matter")
        .when(book != "unknown", "body")
        .otherwise("unknown")
    )


def is_navigation(text: Column, source: Column, heading: Column) -> Column:
    """Navigation by its source, its heading, or the head of its text."""
    head = F.lower(F.ltrim(F.coalesce(text, F.lit(""))))
    starts = reduce(lambda a, b: a | b, [F.startswith(head, F.lit(s)) for s in NAVIGATION_STARTS])
    return F.lower(F.coalesce(source, F.lit(""))).isin(*NAVIGATION_SOURCES) | F.coalesce(heading, F.lit("")).rlike(NAVIGATION_HEADING) | starts | head.rlike(NUMBERED_BOOKS)


def query_modes(query: Column, route: str = ROUTE_QUERY, polar: str = POLAR_QUERY, cue: str = ROUTE_CUE) -> tuple[Column, Column]:
    """(whether a query is about movement, whether its sources are spread): polar questions only with a route cue."""
    moves = query.rlike(route)
    return moves, moves & (~query.rlike(polar) | query.rlike(cue))


def output_kind(query: Column, geography: str, route: str = ROUTE_QUERY) -> Column:
    """What a question asks for: a route, a geographic fact or an answer."""
    return F.when(query.rlike(route) & query.rlike(ROUTE_CUE), "historical_route").when(query.rlike(geography), "geography_fact").otherwise("answer")


def qualifies(semantic: Column, lexical: Column, r: dict[str, Column]) -> Column:
    """Whether a candidate may propose itself by either channel; navigation never may."""
    by_words = lexical & ((r["lexical_support"] >= 0.15) | (r["lexical_rank_relevance"] >= 0.65) | (r["lexical_score_relevance"] >= 0.45))
    by_vector = semantic & ((r["semantic_relevance"] >= 0.08) | (r["passage_local_support"] >= 0.05)) & (r["parent_semantic_prior"] >= 0.15)
    return (r["navigation_penalty"] < 0.32) & (by_words | by_vector)


def coordinate_role(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in COORDINATE_ROLES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("representative_point"))


def anchors(kind: Column, role: Column, strong: Column) -> tuple[Column, Column, Column]:
    """(exact anchor, simulation anchor, traversal) eligibility."""
    point = ~kind.isin(*NO_POINT)
    exact = point & (role == "exact_site")
    return ~strong | exact, point & (kind != "unknown") & (exact | (kind.isin(*SIMULATED) & (role == "representative_point"))), kind.isin(*TRAVERSED)


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive bounds (west, south, east, north)."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def basins(lat: Column, lon: Column) -> Column:
    """Names of all boxes that hold a point; the boxes are constants, so no join is needed."""
    return F.array_compact(F.array(*[F.when(lat.between(a, c) & lon.between(b, d), F.lit(n)) for n, a, b, c, d in BASINS]))


def failed_filters(period: Column, role: Column, types: Column, located: Column, mine: Column, others: Column) -> Column:
    """Names of the filters that exclude a candidate place; none: it passes.

    period: whether its periods contradict the event's. mine: its boxes; others:
    the boxes of each located co-mention, an array of arrays."""
    some = lambda names: F.array(*map(F.lit, names))
    endpoint, all_of = role.isin("ORIGIN", "DESTINATION"), lambda names: F.size(F.array_except(types, some(names))) == 0
    kind = (F.size(types) > 0) & (((role == "TRAVERSAL") & F.arrays_overlap(types, some(NO_TRAVERSAL))) | (endpoint & all_of(NO_ENDPOINT)) | ((endpoint | (role == "EVENT_SITE")) & (types == some(["unlocated"]))) | ((role == "RELATED_PLACE") & all_of(NO_ENDPOINT) & (F.size(others) > 0)))
    apart = (F.size(mine) > 0) & F.exists(others, lambda o: (F.size(o) > 0) & ~F.arrays_overlap(o, mine))
    floating = role.isin("ORIGIN", "DESTINATION", "EVENT_SITE") & ~located
    return F.array_compact(F.array(F.when(period, "period_incompatible"), F.when(kind, "type_incompatible"), F.when(apart, "geo_basin_incompatible"), F.when(floating, "unlocated_anchor_ineligible")))


def resolve(candidates: DataFrame, mention: str) -> DataFrame:
    """(mention, status, survivors): context may exclude candidates (failed, located) but never prove one."""
    passed = F.size("failed") == 0
    found = candidates.groupBy(mention).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(passed).alias("survivors"),
        F.count_if(passed & F.col("located")).alias("located"),
        F.coalesce(F.bool_or(F.array_contains("failed", "geo_basin_incompatible")), F.lit(False)).alias("by_basin"),
    )
    one = F.col("survivors") == 1
    status = F.when(one & (F.col("located") == 1) & ~((F.col("n") >= 2) & F.col("by_basin")), "UNIQUE").when(one & (F.col("located") == 0), "UNLOCATED").otherwise("AMBIGUOUS")
    return found.select(mention, status.alias("status"), "survivors")


def admitted(signals: dict[str, Column], required: dict[str, Column], vetoes: tuple[str, ...] = ()) -> Column:
    """Tri-state admission: true, false or null for match, wrong or unknown. Every required
    signal must match; a veto's false rejects though it isn't required."""
    ok = [F.coalesce(~need | value, F.lit(False)) | ~need for value, need in ((signals[k], required[k]) for k in required)]
    held = [F.coalesce(signals[k], F.lit(True)) for k in vetoes]
    return reduce(lambda a, b: a & b, [*ok, *held], F.lit(True))


def reasons(signals: dict[str, Column], required: dict[str, Column]) -> Column:
    """Codes of required signals that are wrong (..._REJECTED) or unknown (..._UNKNOWN), in order."""
    return F.array_compact(F.array(*[F.when(required[k] & (signals[k] == F.lit(False)), F.lit(f"{k}_REJECTED")).when(required[k] & signals[k].isNull(), F.lit(f"{k}_UNKNOWN")) for k in required]))


def temporal_state(start: Column, end: Column, conflict: Column, query_start: Column, query_end: Column) -> Column:
    """Whether closed year intervals meet: false also for a conflict, null for anything unknown."""
    last, query_last = F.coalesce(end, start), F.coalesce(query_end, query_start)
    return F.when(conflict, False).when(start.isNull() | query_start.isNull(), None).otherwise((last >= query_start) & (query_last >= start))


def alignment(origin: Column, destination: Column, query_origin: Column, query_destination: Column) -> Column:
    """How a movement's endpoints lie to a query's, all given as arrays of tokens."""
    oo, dd = F.arrays_overlap(origin, query_origin), F.arrays_overlap(destination, query_destination)
    od, do = F.arrays_overlap(origin, query_destination), F.arrays_overlap(destination, query_origin)
    return F.when(~(oo | dd | od | do), "disjoint").when(oo & dd, "forward").when(od & do, "reverse").when(oo | dd, "partial").otherwise("fragment")


def completeness(components: Column, branches: Column, constrained: Column, has_origin: Column, has_destination: Column) -> Column:
    return F.when(components == 0, "ABSENT").when((branches > 0) | (components > 1), "PARTIAL").when(~constrained | (has_origin & has_destination), "COMPLETE").otherwise("PARTIAL")


def result_status(wants_route: Column, error: Column, completed: Column, route: Column, presented: Column) -> Column:
    """Null unless a route was asked for; completed (COMPLETE, PARTIAL, ABSENT or null) decides first."""
    known = F.when(completed == "COMPLETE", "FULL_ROUTE").when(completed == "PARTIAL", "PARTIAL").when(completed == "ABSENT", "NO_ROUTE")
    return F.when(~wants_route, None).when(error, "ERROR").otherwise(F.coalesce(known, F.when(route, "FULL_ROUTE").when(presented, "PARTIAL").otherwise("NO_ROUTE")))


def relevance(own: Column, subjects: Column, query_terms: Column, query_subjects: Column, window: Column, continues: Column) -> Column:
    """A passage's relation to a query, by arrays of terms and subjects: the first rule that fits."""
    meets = lambda a, b: F.arrays_overlap(a, b)
    conflict = (F.size(query_subjects) > 0) & (F.size(subjects) > 0) & ~meets(subjects, query_subjects)
    nothing = F.size(query_terms) == 0
    return (
        F.when(nothing, "UNKNOWN")
        .when(conflict, "OTHER_CAMPAIGN")
        .when(meets(subjects, query_subjects), "DIRECT_SUBJECT")
        .when(meets(own, query_terms), "DIRECT_CAMPAIGN")
        .when(meets(window, query_terms) & continues, "DIRECT_SUBJECT")
        .when(meets(window, query_terms), "DIRECT_EVENT")
        .otherwise("UNKNOWN")
    )


def cited(claims: DataFrame, evidence: DataFrame, by: str, order: list, fields: list[str], visible: int = 8) -> DataFrame:
    """claims (by, id, fields) with a verdict against the first `visible` pieces of evidence."""
    from lodeline.operators.retrieval import top_k

    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    seen = top_k(evidence, by, order, visible, "__rank").select(by, "id", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__seen"))
    differs = reduce(lambda a, b: a | b, [~key(F.col(f)).eqNullSafe(key(F.col(f"__{f}"))) for f in fields])
    verdict = F.when(F.col("__seen").isNull(), "UNKNOWN_CITATION").when(differs, "MISMATCHED_CITATION").otherwise("OK")
    return claims.join(seen, [by, "id"], "left").withColumn("verdict", verdict).select(*claims.columns, "verdict")


def consistent(journal: DataFrame, store: DataFrame) -> DataFrame:
    """(missing, extra): ids that only the journal, and that only the store holds; equal sets give 0 and 0."""
    a, b = journal.distinct().withColumn("j", F.lit(1)), store.distinct().withColumn("s", F.lit(1))
    both = a.join(b, journal.columns, "full_outer")
    return both.agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("j").isNull()).alias("extra"))
