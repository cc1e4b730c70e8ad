"""Queries of joins, merges, grouped verdicts and windows over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.operators import relations
from lodeline.plans.registry import query, table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""SELECT l_partkey AS id, min(l_linenumber) FILTER (l_returnflag = 'A') AS vector_rank, max(l_quantity) FILTER (l_returnflag <> 'A') AS lexical_score, bool_or(l_returnflag = 'A') AS semantic, bool_or(l_returnflag <> 'A') AS lexical, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS channels FROM lineitem GROUP BY 1""")
def channel_merge(spark, sf_dir):
    """One row a key: least rank, greatest score, any flag, channels kept."""
    a = F.col("l_returnflag") == "A"
    rows = _lines(spark, sf_dir).select(F.col("l_partkey").alias("id"), F.when(a, F.col("l_linenumber")).alias("vector_rank"), F.when(~a, F.col("l_quantity")).alias("lexical_score"), a.alias("semantic"), (~a).alias("lexical"), F.col("l_returnflag").alias("channel"))
    return relations.merge_on_key(rows, "id").withColumn("channels", F.array_join("channels", ","))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def first_of_key(spark, sf_dir):
    return relations.keep_first(_lines(spark, sf_dir), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT id, string_agg(c, ',' ORDER BY i) AS channels FROM (SELECT DISTINCT o_custkey AS id, 1 AS i, 'open' AS c FROM orders WHERE o_orderstatus = 'O' UNION SELECT DISTINCT o_custkey, 2, 'rich' FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey, 3, 'known' FROM customer WHERE c_acctbal > 0) GROUP BY id""")
def channel_union(spark, sf_dir):
    """Ids of three channels, once, with the channels in order."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    parts = {"open": o.where("o_orderstatus = 'O'"), "rich": o.where("o_totalprice > 200000"), "known": table(spark, sf_dir, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "id")}
    return relations.union_with_provenance(parts, "id").withColumn("channels", F.array_join("channels", ","))


_SPANS = "SELECT l_orderkey AS source, l_linenumber AS idx, l_linenumber * 100 AS start, l_linenumber * 100 + 60 + CAST(l_quantity AS INT) * 3 AS stop, l_partkey AS rank FROM lineitem"


@query(f"""WITH p AS ({_SPANS}) SELECT source, idx, suffix_start, suffix_stop, rank FROM (SELECT a.source, a.idx, a.stop AS suffix_start, b.stop AS suffix_stop, b.rank, row_number() OVER (PARTITION BY a.source, a.idx ORDER BY b.rank, a.stop, b.stop) AS n
FROM p a JOIN p b ON a.source = b.source AND b.idx = a.idx + 1 AND b.start >= a.start AND b.start < a.stop AND b.stop > a.stop AND b.stop - a.stop <= 1200) WHERE n = 1""")
def adjacent_overlaps(spark, sf_dir):
    """The suffix that the next passage adds to each one."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("source"), n.alias("idx"), (n * 100).alias("start"), (n * 100 + 60 + q * 3).alias("stop"), F.col("l_partkey").alias("rank"))
    return relations.adjacent_overlap(rows)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def conditional_admissions(spark, sf_dir):
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("l_suppkey"))
    against = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relations.conditional_admission(_lines(spark, sf_dir), allowed, against, "l_suppkey", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN -(l_partkey % 90) END AS s, -(l_partkey % 90) + l_suppkey % 4 AS e FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber AS left_no, b.l_linenumber AS right_no, a.s, coalesce(a.e, a.s) AS e, b.s AS s2, coalesce(b.e, b.s) AS e2, CASE WHEN (a.l_linenumber + b.l_linenumber) % 3 = 0 THEN -1 END AS structural FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
d AS (SELECT *, s IS NOT NULL AND s2 IS NOT NULL AS dated, CASE WHEN s IS NOT NULL AND s2 IS NOT NULL AND e < s2 THEN -1 WHEN s IS NOT NULL AND s2 IS NOT NULL AND e2 < s THEN 1 END AS by_date FROM p)
SELECT l_orderkey, left_no, right_no, coalesce(CASE WHEN dated THEN by_date ELSE structural END, 0) AS strict, coalesce(by_date, structural, 0) AS lenient FROM d""")
def pair_precedence(spark, sf_dir):
    """Every pair of an order's lines once, ordered by dates or by structure, in both variants."""
    k = F.col("l_partkey") % 90
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.struct("l_linenumber", F.when(F.col("l_partkey") % 5 > 0, -k).alias("s"), (-k + F.col("l_suppkey") % 4).alias("e")).alias("v"))
    pairs = relations.unordered_pairs(rows, "l_orderkey", "l_linenumber", "v")
    structural = F.when((F.col("left.l_linenumber") + F.col("right.l_linenumber")) % 3 == 0, -1)
    strict, lenient = relations.precedence(F.col("left.s"), F.col("left.e"), F.col("right.s"), F.col("right.e"), structural)
    return pairs.select("l_orderkey", F.col("left.l_linenumber").alias("left_no"), F.col("right.l_linenumber").alias("right_no"), F.coalesce(strict, F.lit(0)).alias("strict"), F.coalesce(lenient, F.lit(0)).alias("lenient"))


_STOP, _GENERIC = ("the", "and", "that", "of"), ("with", "for")


@query("""WITH e AS (SELECT conv_id * 100 + turn AS event_id, text, conv_id % 7 AS year FROM conversations WHERE turn = 0), r AS (SELECT item_id AS record_id, text, item_id % 7 AS year FROM benchmark),
ew AS (SELECT event_id, year, list_filter(regexp_extract_all(lower(text), '[a-z][a-z'']{2,}'), lambda w: w NOT IN ('the', 'and', 'that', 'of')) AS w, list_filter(list_transform(regexp_extract_all(text, '[A-Z][A-Za-z'']{2,}'), lambda x: lower(x)), lambda x: x NOT IN ('the', 'and', 'that', 'of')) AS names FROM e),
rw AS (SELECT record_id, year, list_filter(regexp_extract_all(lower(text), '[a-z][a-z'']{2,}'), lambda w: w NOT IN ('the', 'and', 'that', 'of')) AS w, list_filter(list_transform(regexp_extract_all(text, '[A-Z][A-Za-z'']{2,}'), lambda x: lower(x)), lambda x: x NOT IN ('the', 'and', 'that', 'of')) AS names FROM r),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT record_id, unnest(w) AS term FROM rw) GROUP BY 1),
ep AS (SELECT DISTINCT event_id, w[i] AS x, w[i + 1] AS y FROM ew, unnest(range(1, len(w))) AS u(i)), rp AS (SELECT DISTINCT record_id, w[i] AS x, w[i + 1] AS y FROM rw, unnest(range(1, len(w))) AS u(i)),
s AS (SELECT event_id, record_id, count(*) AS distinctive FROM (SELECT DISTINCT event_id, unnest(w) AS term FROM ew) JOIN (SELECT DISTINCT record_id, unnest(w) AS term FROM rw) USING (term) WHERE term NOT IN ('with', 'for') GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT s.*, ew.year AS y1, rw.year AS y2, list_distinct(list_intersect(ew.names, rw.names)) AS common FROM s JOIN ew USING (event_id) JOIN rw USING (record_id) WHERE len(list_intersect(ew.names, rw.names)) > 0),
q AS (SELECT DISTINCT b.event_id, b.record_id FROM b JOIN ep ON b.event_id = ep.event_id JOIN rp ON b.record_id = rp.record_id AND ep.x = rp.x AND ep.y = rp.y JOIN df dx ON dx.term = ep.x JOIN df dy ON dy.term = ep.y WHERE least(dx.df, dy.df) <= 10 AND list_has_any(common, [ep.x, ep.y])),
j AS (SELECT b.event_id, b.record_id, distinctive, CASE WHEN y1 <> y2 THEN 'CONFLICT' WHEN q.event_id IS NOT NULL AND (len(common) >= 2 OR y1 = y2) THEN 'MATCH' ELSE 'AMBIGUOUS' END AS status FROM b LEFT JOIN q ON b.event_id = q.event_id AND b.record_id = q.record_id),
k AS (SELECT *, bool_or(status = 'MATCH') OVER (PARTITION BY event_id) AS matched, row_number() OVER (PARTITION BY event_id ORDER BY record_id) AS place FROM j)
SELECT e.event_id, coalesce(record_id, -1) AS record_id, coalesce(status, 'NO_MATCH') AS status, coalesce(distinctive, 0) AS distinctive FROM e LEFT JOIN (SELECT * FROM k WHERE CASE WHEN matched THEN status = 'MATCH' ELSE place <= 20 END) k USING (event_id)""")
def chronology_candidates(spark, sf_dir):
    """First turns of conversations against the benchmark's passages by shared terms, names and rare phrases."""
    c = table(spark, sf_dir, "conversations").where("turn = 0")
    events = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("event_id"), "text", (F.col("conv_id") % 7).alias("year"))
    records = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record_id"), "text", (F.col("item_id") % 7).alias("year"))
    return relations.candidate_matches(events, records, list(_STOP), list(_GENERIC)).withColumn("record_id", F.coalesce("record_id", F.lit(-1)))


_ALIASES = (("clown", "worthless"), ("hand", "hand"), ("thing", "thing"), ("der", "der"))


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\P{{L}}a-z]', 'z', 'g') AS t FROM documents)
SELECT doc_id, name, alias FROM d, (VALUES {', '.join(f"('{n}', '{a}')" for n, a in _ALIASES)}) AS x(name, alias) WHERE regexp_matches(t, '(?:^|[^a-z0-9_])' || alias || '(?:$|[^a-z0-9_])')""")
def alias_containment(spark, sf_dir):
    return relations.alias_hits(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), list(_ALIASES))


_ENTITIES = (("gold", ("Brand#1", "nosuch"), ()), ("steel", (), ("steel", "large")), ("brass", ("BRASS!",), ("x",)))


@query("""SELECT p_partkey, CASE WHEN contains(t, 'brand1') THEN CASE WHEN contains(t, 'brass') AND 105 > 106 THEN 'brass' ELSE 'gold' END WHEN contains(t, 'brass') THEN 'brass' WHEN contains(t, 'steel') AND contains(t, 'large') THEN 'steel' ELSE 'none' END AS entity
FROM (SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_type || ' ' || p_name), '[^a-z0-9_]', '', 'g') AS t FROM part)""")
def best_entities(spark, sf_dir):
    """The entity with the best alias or match terms of each part's name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("t"))
    return relations.best_alias(rows, "p_partkey", F.col("t"), list(_ENTITIES)).fillna("none", ["entity"])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS w FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n <= 4 AND l_suppkey % 3 > 0) WHERE w = 1""")
def ranked_probing(spark, sf_dir):
    """Of each order's lines the four cheapest are tried; the first valid one wins."""
    return relations.probe_ranked(_lines(spark, sf_dir), "l_orderkey", ["l_extendedprice", "l_linenumber", "l_suppkey"], F.col("l_suppkey") % 3 > 0).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""WITH r AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS lost FROM lineitem GROUP BY 1) SELECT l_orderkey, n FROM r WHERE lost = 0""")
def evidence_closure(spark, sf_dir):
    """Orders whose suppliers are all visible."""
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("refs"), F.count(F.lit(1)).alias("n"))
    visible = table(spark, sf_dir, "supplier").where("s_acctbal > 0").withColumnRenamed("s_suppkey", "id")
    return relations.closed(rows, "refs", visible, "id").select("l_orderkey", "n")


@query("""WITH a AS (SELECT o_orderkey, count(*) AS n, min(l_suppkey) AS ref FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 + o_orderkey % 4 GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN a.n IS NULL THEN 'MISSING' WHEN a.n > 1 THEN 'DUPLICATE' WHEN ref % 5 <> o.o_orderkey % 5 THEN 'FOREIGN_REFERENCE' ELSE 'OK' END AS fault FROM orders o LEFT JOIN a USING (o_orderkey)""")
def enrichment_checks(spark, sf_dir):
    """One annotation for each order, its references a subset of the order's."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 5).alias("refs"))
    l = _lines(spark, sf_dir).where("l_linenumber = 1 + l_orderkey % 4").select(F.col("l_orderkey").alias("o_orderkey"), F.array(F.col("l_suppkey") % 5).alias("refs"))
    return relations.enrich(o, l, "o_orderkey", "refs").select("o_orderkey", F.coalesce("fault", F.lit("OK")).alias("fault"))


_GROUPS = ((1, "a", ("thing",)), (1, "b", ("hand", "inen")), (1, "c", ("nosuchword",)), (2, "a", ("de", "der")))


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), g AS (SELECT * FROM (VALUES (1, 'a', ['thing']), (1, 'b', ['hand', 'inen']), (1, 'c', ['nosuchword']), (2, 'a', ['de', 'der'])) AS v(query_id, grp, members)),
p AS (SELECT 1 AS query_id, doc_id, t FROM d UNION ALL SELECT 2, doc_id, t FROM d WHERE doc_id % 2 = 0), n AS (SELECT query_id, count(*) AS n FROM p GROUP BY 1)
SELECT query_id, grp, round(ln(1 + any_value(n)::DOUBLE / (1 + count(*))), 6) AS weight FROM p JOIN g USING (query_id) JOIN n USING (query_id) WHERE list_has_any(t, members) GROUP BY ALL""")
def pool_term_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("terms"))
    pools = docs.select(F.lit(1).alias("query_id"), "doc_id", "terms").unionAll(docs.where("doc_id % 2 = 0").select(F.lit(2), "doc_id", "terms"))
    groups = spark.createDataFrame([(q, g, list(m)) for q, g, m in _GROUPS], "query_id int, grp string, members array<string>")
    return relations.pool_weights(pools, groups).withColumn("weight", F.round("weight", 6))


@query("""WITH w AS (SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1)
SELECT l_suppkey, A, R, round(R - A, 6) AS delta, CASE WHEN R > A THEN 'improved' WHEN R < A THEN 'regressed' ELSE 'same' END AS change FROM w""")
def variant_deltas(spark, sf_dir):
    """Two variants of a measurement by supplier, their difference and its class."""
    return relations.compare_variants(_lines(spark, sf_dir), "l_suppkey", "l_returnflag", "l_quantity", "A", "R")


@query("""WITH e AS (SELECT CASE WHEN l_partkey % 9 > 0 THEN 'k' || l_partkey % 40 ELSE '#' || l_orderkey || ':' || l_linenumber END AS identity, l_returnflag, l_orderkey, l_linenumber, list_value('VISIT', 'BATTLE', 'MARCH')[CAST(l_suppkey % 3 AS INT) + 1] AS kind, l_suppkey % 10 AS item FROM lineitem),
g AS (SELECT identity, l_returnflag, count(*) AS merged, bool_or(kind = 'BATTLE') AS b, arg_min(kind, (l_orderkey, l_linenumber, kind, item)) AS f FROM e GROUP BY ALL),
i AS (SELECT identity, l_returnflag, string_agg(CAST(item AS VARCHAR), ',' ORDER BY o) AS items FROM (SELECT identity, l_returnflag, item, min((l_orderkey, l_linenumber, kind, item)) AS o FROM e GROUP BY ALL) GROUP BY ALL)
SELECT identity, l_returnflag, merged, CASE WHEN b THEN 'BATTLE' ELSE f END AS kind, items FROM g JOIN i USING (identity, l_returnflag)""")
def event_consolidation(spark, sf_dir):
    """Events of one identity and actor merged, a null identity apart, one kind of event first."""
    kind = F.element_at(F.array(*map(F.lit, ("VISIT", "BATTLE", "MARCH"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = _lines(spark, sf_dir).select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", kind.alias("kind"), (F.col("l_suppkey") % 10).alias("item"))
    key = F.when(F.col("l_partkey") % 9 > 0, F.concat(F.lit("k"), F.col("l_partkey") % 40))
    found = relations.consolidate(rows, key, "l_returnflag", ["l_orderkey", "l_linenumber"], "kind", "item", "BATTLE")
    return found.select("identity", "l_returnflag", F.col("merged").cast("long").alias("merged"), "kind", F.array_join("item", ",").alias("items"))


@query("""SELECT l_partkey, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1""")
def conflict_counts(spark, sf_dir):
    return relations.conflicts(_lines(spark, sf_dir), ["l_partkey"], ["l_returnflag", "l_linestatus"])


_MARKS = "SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS book, CASE WHEN event_type = 'click' THEN event_id END AS chapter, CASE WHEN event_id % 5 = 0 THEN event_id END AS section FROM events"


@query(f"""WITH m AS ({_MARKS}), a AS (SELECT *, last_value(book IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS carried_book, count(book) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM m),
b AS (SELECT *, last_value(chapter IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id) AS carried_chapter, count(chapter) OVER (PARTITION BY user_id, g ORDER BY event_id) AS h FROM a)
SELECT event_id, coalesce(carried_book, -1) AS book, coalesce(carried_chapter, -1) AS chapter, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY user_id, g, h ORDER BY event_id), -1) AS section FROM b""")
def carried_headings(spark, sf_dir):
    """Last book, chapter and section of each event; a new level clears those below."""
    mark = lambda c, n: F.when(c, F.col("event_id")).alias(n)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", mark(F.col("event_type") == "purchase", "book"), mark(F.col("event_type") == "click", "chapter"), mark(F.col("event_id") % 5 == 0, "section"))
    found = relations.carry_forward(rows, "user_id", "event_id", ["book", "chapter", "section"])
    return found.select("event_id", *[F.coalesce(f"carried_{c}", F.lit(-1)).alias(c) for c in ("book", "chapter", "section")])


@query("""SELECT conv_id, turn, md5(concat_ws(' ', lag(text) OVER w, lead(text) OVER w)) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_context(spark, sf_dir):
    found = relations.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", "turn", F.md5("context").alias("context"))


@query("""WITH p AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT event_id, coalesce(p - last_value(CASE WHEN event_type = 'purchase' THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), -1) AS distance FROM p""")
def since_purchase(spark, sf_dir):
    """Events since the user's last purchase, if it is among the 40 before."""
    found = relations.since_match(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase", 40)
    return found.select("event_id", F.coalesce("distance", F.lit(-1)).cast("long").alias("distance"))


@query("""WITH RECURSIVE n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, turn, length(text) AS s FROM conversations),
g AS (SELECT conv_id, r, turn, 0 AS part, s AS fill FROM n WHERE r = 1 UNION ALL SELECT n.conv_id, n.r, n.turn, CASE WHEN g.fill > 0 AND g.fill + n.s > 2000 THEN g.part + 1 ELSE g.part END, CASE WHEN g.fill > 0 AND g.fill + n.s > 2000 THEN n.s ELSE g.fill + n.s END FROM g JOIN n ON n.conv_id = g.conv_id AND n.r = g.r + 1)
SELECT conv_id, turn, CAST(part AS BIGINT) AS part FROM g""")
def turn_budgets(spark, sf_dir):
    """Consecutive turns packed greedily into parts of up to 2,000 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return relations.budget_groups(rows, "conv_id", "turn", "size", 2000)


@query("""WITH y AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN event_id % 7 - 3 END AS year, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 END AS shift FROM events),
z AS (SELECT event_id, user_id, CASE WHEN year <> 0 THEN year END AS year, shift FROM y), a AS (SELECT *, last_value(year IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor, count(year) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM z),
b AS (SELECT *, sum(CASE WHEN shift IS NOT NULL AND year IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS nth FROM a)
SELECT event_id, coalesce(CASE WHEN year IS NOT NULL THEN year WHEN shift IS NOT NULL AND nth = 1 THEN CASE WHEN anchor + shift = 0 THEN CASE WHEN shift > 0 THEN 1 ELSE -1 END ELSE anchor + shift END END, -9999) AS dated FROM b""")
def relative_dating(spark, sf_dir):
    """A year dates the first relative phrase after it; there is no year 0."""
    year = F.when(F.col("event_type") == "purchase", F.col("event_id") % 7 - 3)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(year != 0, year).alias("year"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).alias("shift"))
    return relations.relative_years(rows, "user_id", "event_id", "year", "shift").select("event_id", F.coalesce("dated", F.lit(-9999)).alias("dated"))


@query("""WITH m AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 0 ELSE 1 END AS p FROM orders)
SELECT o_custkey, o_orderkey, seat FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_totalprice DESC, o_orderkey) AS seat FROM m) WHERE seat <= 6""")
def reserved_seats(spark, sf_dir):
    """Six seats a customer, the best order of each priority first."""
    return relations.reserve(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 6).select("o_custkey", "o_orderkey", "seat")
