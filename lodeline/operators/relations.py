"""Joins, merges, grouped verdicts and windows that keep provenance. All are joins, aggregates or windows of Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_on_key(rows: DataFrame, key: str, lists: str = "channel") -> DataFrame:
    """One row for each key: least vector rank, greatest lexical score, any flag, and the channels that gave it."""
    return rows.groupBy(key).agg(
        F.min("vector_rank").alias("vector_rank"),
        F.max("lexical_score").alias("lexical_score"),
        F.bool_or("semantic").alias("semantic"),
        F.bool_or("lexical").alias("lexical"),
        F.array_sort(F.collect_set(lists)).alias("channels"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_with_provenance(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, channels): every id once, with the channels it came by in the order given."""
    marked = [df.select(key, F.lit(i).alias("__i"), F.lit(name).alias("__c")) for i, (name, df) in enumerate(parts.items())]
    rows = reduce(DataFrame.unionByName, marked)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("__i", "__c"))), lambda x: x["__c"]).alias("channels"))


def adjacent_overlap(passages: DataFrame, most: int = 1200) -> DataFrame:
    """Of passages (source, idx, start, stop, rank) those that begin inside the one before, by
    index, and end after it: the anchor, and where the suffix lies. The best rank wins."""
    a, b = passages.alias("a"), passages.alias("b")
    inside = (F.col("b.start") >= F.col("a.start")) & (F.col("b.start") < F.col("a.stop")) & (F.col("b.stop") > F.col("a.stop")) & (F.col("b.stop") - F.col("a.stop") <= most)
    met = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("b.idx") == F.col("a.idx") + 1) & inside)
    found = met.select(F.col("a.source").alias("source"), F.col("a.idx").alias("idx"), F.col("a.stop").alias("suffix_start"), F.col("b.stop").alias("suffix_stop"), F.col("b.rank").alias("rank"))
    return keep_first(found, ["source", "idx"], ["rank", "suffix_start", "suffix_stop"])


def conditional_admission(rows: DataFrame, allowed: DataFrame, conflicting: DataFrame, source: str, key: str) -> DataFrame:
    """Rows whose source is allowed, but for those that conflict."""
    return rows.join(allowed.select(source).distinct(), source, "left_semi").join(conflicting.select(key).distinct(), key, "left_anti")


def unordered_pairs(rows: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """Each pair of rows of a group once, earlier position first. Groups are bounded by their key."""
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{position}") < F.col(f"b.{position}"))).select(F.col(f"a.{by}").alias(by), F.col(f"a.{value}").alias("left"), F.col(f"b.{value}").alias("right"))


def precedence(start: Column, end: Column, other_start: Column, other_end: Column, structural: Column) -> tuple[Column, Column]:
    """(strict, lenient) order of two items: -1 before, 1 after, null none. Strict: items with
    dates that overlap have no order; lenient: they fall through to the structural order."""
    dated = start.isNotNull() & other_start.isNotNull()
    last, other_last = F.coalesce(end, start), F.coalesce(other_end, other_start)
    by_date = F.when(dated & (last < other_start), -1).when(dated & (other_last < start), 1)
    return F.when(dated, by_date).otherwise(structural), F.coalesce(by_date, structural)


def candidate_matches(events: DataFrame, records: DataFrame, stop: list[str], generic: list[str], rare: int = 10, most: int = 20) -> DataFrame:
    """(event_id, record_id, status, distinctive): records that share two distinctive terms and a
    name with an event. events (event_id, text, year), records (record_id, text, year).

    Terms are joined by an inverted index. MATCH: a rare pair of neighbouring terms that holds a shared name
    is common to both, and two names or the year are; CONFLICT: years differ; else
    AMBIGUOUS, of which the first `most` by id come back; NO_MATCH without any."""
    words = lambda t: F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z][a-z']{2,}"), 0), lambda w: ~w.isin(*stop))
    names = lambda t: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit("[A-Z][A-Za-z']{2,}"), 0), F.lower), lambda w: ~w.isin(*stop)))
    pairs = lambda a: F.array_distinct(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y)))
    terms = lambda df, key: df.withColumn("w", words(F.col("text"))).select(key, "year", F.array_distinct("w").alias("terms"), names(F.col("text")).alias("names"), pairs(F.col("w")).alias("pairs"))
    e, r = terms(events, "event_id"), terms(records, "record_id")
    index = r.select("record_id", F.explode("terms").alias("term"))
    frequent = index.groupBy("term").count().where(F.col("count") > rare).select("term")
    hits = e.select("event_id", F.explode("terms").alias("term")).where(~F.col("term").isin(*generic)).join(index, "term")
    shared = hits.groupBy("event_id", "record_id").agg(F.count(F.lit(1)).alias("distinctive")).where("distinctive >= 2")
    both = shared.join(e, "event_id").join(r.select("record_id", *(F.col(c).alias(f"r_{c}") for c in ("year", "names", "pairs"))), "record_id")
    both = both.withColumn("common_names", F.array_intersect("names", "r_names")).where(F.size("common_names") > 0)
    phrases = both.select("event_id", "record_id", "common_names", F.explode(F.array_intersect("pairs", "r_pairs")).alias("pair")).withColumn("parts", F.split("pair", " "))
    named = phrases.where(F.arrays_overlap("parts", "common_names"))
    # a pair is rare if its rarer term is: at most one of its terms may be frequent
    counted = named.select("event_id", "record_id", "pair", F.explode("parts").alias("term")).join(frequent.withColumn("f", F.lit(1)), "term", "left").groupBy("event_id", "record_id", "pair").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("often"))
    rare_pairs = counted.where("often < n").select("event_id", "record_id").distinct().withColumn("has_rare", F.lit(True))
    agrees = F.col("year") == F.col("r_year")
    judged = both.join(rare_pairs, ["event_id", "record_id"], "left")
    strong = F.col("has_rare").isNotNull() & ((F.size("common_names") >= 2) | F.coalesce(agrees, F.lit(False)))
    status = F.when(F.coalesce(~agrees, F.lit(False)), "CONFLICT").when(strong, "MATCH").otherwise("AMBIGUOUS")
    rows = judged.select("event_id", "record_id", status.alias("status"), "distinctive")
    own = Window.partitionBy("event_id")
    ranked = rows.withColumns({"matched": F.max(F.col("status") == "MATCH").over(own), "place": F.row_number().over(own.orderBy("record_id"))})
    kept = ranked.where(F.when(F.col("matched"), F.col("status") == "MATCH").otherwise(F.col("place") <= most)).select("event_id", "record_id", "status", "distinctive")
    return events.select("event_id").join(kept, "event_id", "left").select("event_id", "record_id", F.coalesce("status", F.lit("NO_MATCH")).alias("status"), F.coalesce("distinctive", F.lit(0)).alias("distinctive"))


def alias_hits(texts: DataFrame, key: str, text: Column, aliases: list[tuple[str, str]]) -> DataFrame:
    """(key, name, alias): aliases that stand in a text, bounded by other characters than letters and digits where they
    are Latin. The alias list is a bounded constant, so its patterns are columns of one scan."""
    low = F.lower(text)
    hit = lambda a: F.contains(low, F.lit(a)) if any(ord(c) > 0x2E7F for c in a) else low.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{a}\E(?![\p{{L}}\p{{N}}_])")
    found = F.array_compact(F.array(*[F.when(hit(a.lower()), F.struct(F.lit(n).alias("name"), F.lit(a).alias("alias"))) for n, a in aliases]))
    return texts.select(key, F.explode(found).alias("x")).select(key, "x.*")


def best_alias(texts: DataFrame, key: str, text: Column, entities: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """(key, entity): an alias scores 100 and its length, all match terms 50 and theirs; ties by id. Both sides without punctuation."""
    strip = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum() or c == "_")
    low = strip(text)
    scores = []
    for name, aliases, terms in entities:
        by_alias = F.greatest(F.lit(0), F.lit(0), *[F.when(F.contains(low, F.lit(plain(a))), 100 + len(plain(a))).otherwise(0) for a in aliases])
        every = reduce(lambda a, b: a & b, [F.contains(low, F.lit(plain(t))) for t in terms], F.lit(bool(terms)))
        score = F.when(by_alias > 0, by_alias).when(every, 50 + sum(len(plain(t)) for t in terms)).otherwise(0)
        scores.append(F.struct((-score).alias("minus"), F.lit(name).alias("entity")))
    best = F.array_min(F.array(*scores))
    return texts.select(key, F.when(best["minus"] < 0, best["entity"]).alias("entity"))


def probe_ranked(pairs: DataFrame, by: str, order: list, valid: Column, most: int = 4) -> DataFrame:
    """Of each group's pairs the first `most` by order are tried; the first valid one wins."""
    tried = pairs.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= most)
    return keep_first(tried.where(valid), [by], ["__n"]).drop("__n")


def closed(rows: DataFrame, refs: str, visible: DataFrame, id: str) -> DataFrame:
    """Rows with references, all of which are visible; by joins, since what is visible grows with the data."""
    each = rows.withColumn("__row", F.monotonically_increasing_id())
    lost = each.select("__row", F.explode(refs).alias(id)).join(visible.select(id).distinct(), id, "left_anti").select("__row").distinct()
    return each.where(F.size(refs) > 0).join(lost, "__row", "left_anti").drop("__row")


def enrich(left: DataFrame, right: DataFrame, key: str, refs: str) -> DataFrame:
    """left with right's columns and a fault: MISSING, DUPLICATE or FOREIGN_REFERENCE, null if there is none."""
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(refs).alias("__refs"))
    both = left.join(one, key, "left")
    fault = F.when(F.col("__n").isNull(), "MISSING").when(F.col("__n") > 1, "DUPLICATE").when(F.size(F.array_except("__refs", refs)) > 0, "FOREIGN_REFERENCE")
    return both.withColumn("fault", fault).drop("__n", "__refs")


def pool_weights(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, grp, weight): ln(1 + n / (1 + count)) for each term group that occurs in the
    query's pool. tokens (query_id, item, terms), groups (query_id, grp, members)."""
    n = tokens.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hit = tokens.join(F.broadcast(groups), "query_id").where(F.arrays_overlap("terms", "members"))  # groups: a handful a query
    return hit.groupBy("query_id", "grp").agg(F.count(F.lit(1)).alias("c")).join(n, "query_id").select("query_id", "grp", F.log1p(F.col("n") / (1 + F.col("c"))).alias("weight"))


def compare_variants(rows: DataFrame, pair: str, variant: str, value: str, base: str, other: str) -> DataFrame:
    """(pair, base, other, delta, change) of two variants of one measurement."""
    wide = rows.groupBy(pair).pivot(variant, [base, other]).agg(F.round(F.avg(value), 6))
    delta = F.round(F.col(other) - F.col(base), 6)
    return wide.withColumn("delta", delta).withColumn("change", F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("same"))


def consolidate(rows: DataFrame, key: Column, actor: str, order: list[str], kind: str, items: str, first: str) -> DataFrame:
    """Rows of one identity key and actor become one, items in first-seen order and once; a null key stays apart.
    The kind named `first` wins, else the first seen."""
    ident = F.coalesce(key, F.concat(F.lit("#"), F.concat_ws(":", *order)))
    seen = F.array_sort(F.collect_list(F.struct(*order, kind, items)))
    grouped = rows.groupBy(ident.alias("identity"), actor).agg(seen.alias("s"))
    kinds = F.transform("s", lambda x: x[kind])
    return grouped.select("identity", actor, F.size("s").alias("merged"), F.when(F.array_contains(kinds, first), first).otherwise(F.element_at(kinds, 1)).alias(kind), F.array_distinct(F.transform("s", lambda x: x[items])).alias(items))


def conflicts(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys with several distinct values in one of the columns, and in which."""
    found = rows.groupBy(*key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return found.where(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns]))


def carry_forward(rows: DataFrame, by: str, order: str, levels: list[str]) -> DataFrame:
    """Last known value of each level; a new value of a level clears those below it."""
    w = Window.partitionBy(by).orderBy(order)
    out, groups = rows, [by]
    for i, level in enumerate(levels):
        mine = Window.partitionBy(*groups).orderBy(order)
        out = out.withColumn(f"carried_{level}", F.last(level, True).over(mine))
        if i + 1 < len(levels):
            out = out.withColumn(f"__g{i}", F.sum(F.when(F.col(level).isNotNull(), 1).otherwise(0)).over(mine if i else w))
            groups = [*groups, f"__g{i}"]
    return out.drop(*[f"__g{i}" for i in range(len(levels) - 1)])


def neighbours(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Text of the rows before and after, without the row's own."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("context", F.concat_ws(" ", F.lag(text).over(w), F.lead(text).over(w)))


def since_match(rows: DataFrame, by: str, order: str, matches: Column, most: int) -> DataFrame:
    """Rows back to the last match before each row, within `most`; null if there is none."""
    w = Window.partitionBy(by).orderBy(order)
    placed = rows.withColumns({"__p": F.row_number().over(w), "__m": matches})
    back = w.rowsBetween(-most, -1)
    return placed.withColumn("distance", F.col("__p") - F.last(F.when(F.col("__m"), F.col("__p")), True).over(back)).drop("__p", "__m")


def budget_groups(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """(by, order, part): consecutive rows fill a part until the next would take it above `most`; a larger
    row is a part of its own. Order-dependent: a fold over each group's sizes, 16 bytes a row."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("fill"), F.array().cast("array<struct<o:bigint,part:bigint>>").alias("out"))

    def step(a, x):
        opens = (a["fill"] > 0) & (a["fill"] + x["s"] > most)
        part = a["part"] + opens.cast("long")
        return F.struct(part.alias("part"), (F.when(opens, F.lit(0)).otherwise(a["fill"]) + x["s"]).cast("long").alias("fill"), F.concat(a["out"], F.array(F.struct(x["o"].cast("long").alias("o"), part.alias("part")))).alias("out"))

    return listed.select(by, F.explode(F.aggregate("r", start, step, lambda a: a["out"])).alias("x")).select(by, F.col("x.o").alias(order), "x.part")


def relative_years(rows: DataFrame, by: str, order: str, year: str, shift: str) -> DataFrame:
    """The last explicit year dates one later relative phrase (shift in years) and is then used up; year 0 is skipped."""
    w = Window.partitionBy(by).orderBy(order)
    a = rows.withColumns({"__anchor": F.last(year, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__g": F.count(year).over(w)})
    phrase = F.col(shift).isNotNull() & F.col(year).isNull()
    nth = F.sum(F.when(phrase, 1).otherwise(0)).over(Window.partitionBy(by, "__g").orderBy(order))
    moved = F.col("__anchor") + F.col(shift)
    skipped = F.when((F.col("__anchor") != 0) & (moved == 0), F.when(F.col(shift) > 0, 1).otherwise(-1)).otherwise(moved)
    return a.withColumn("dated", F.when(F.col(year).isNotNull(), F.col(year)).when(phrase & (nth == 1), skipped)).drop("__anchor", "__g")


def reserve(rows: DataFrame, by: str, kind: str, order: list, seats: int) -> DataFrame:
    """Seats go to each kind's best row first, then to the best of the rest; the place of every seated row."""
    first = F.row_number().over(Window.partitionBy(by, kind).orderBy(*order)) == 1
    marked = rows.withColumn("__p", F.when(first, 0).otherwise(1))
    return marked.withColumn("seat", F.row_number().over(Window.partitionBy(by).orderBy("__p", *order)).cast("long")).where(F.col("seat") <= seats).drop("__p")
