"""Queries of dates, keys, scores, routes and graphs over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.functions import dates, geo, text
from lodeline.operators import chunks, ordering, retrieval, routes, scoring, selection
from lodeline.plans.registry import query, table

# Dates: statements are made from numbers, so that the SQL knows every reading without a pattern

_A, _B = "(1 + o_orderkey % 300)", "(1 + o_custkey % 200)"


@query(f"""SELECT o_orderkey, status, coalesce(s, 0) AS start, coalesce(e, 0) AS "end", precision FROM (
SELECT o_orderkey, k, CASE WHEN k = 6 THEN 'CONFLICT' WHEN k = 7 THEN 'CENTURY_UNRESOLVED' WHEN k >= 8 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status,
CASE k WHEN 0 THEN -a WHEN 1 THEN -a WHEN 2 THEN least(-a, -b) WHEN 3 THEN -a WHEN 4 THEN -a WHEN 5 THEN least(a, b) END AS s, CASE k WHEN 0 THEN -a WHEN 1 THEN -a WHEN 2 THEN greatest(-a, -b) WHEN 3 THEN -a WHEN 4 THEN -a WHEN 5 THEN greatest(a, b) END AS e,
CASE k WHEN 0 THEN 'YEAR' WHEN 1 THEN 'YEAR' WHEN 2 THEN 'YEAR_RANGE' WHEN 3 THEN 'APPROXIMATE' WHEN 4 THEN 'YEAR' WHEN 5 THEN 'YEAR_RANGE' ELSE 'UNKNOWN' END AS precision
FROM (SELECT o_orderkey, o_orderkey % 10 AS k, {_A} AS a, {_B} AS b FROM orders))""")
def statement_dates(spark, sf_dir):
    """Readings of years and ranges in made-up statements of ten forms."""
    a, b = (F.expr(x).cast("string") for x in (_A, _B))
    forms = [F.concat(F.lit("In "), a, F.lit(" BCE he left.")), F.concat(F.lit("B.C. "), a), F.concat(a, F.lit("–"), b, F.lit(" BC")), F.concat(F.lit("circa "), a, F.lit(" BC")), F.concat(F.lit("公元前"), a, F.lit("年")), F.concat(F.lit("between "), a, F.lit(" and "), b, F.lit(" AD")), F.concat(a, F.lit(" BC or "), b, F.lit(" AD")), F.lit("in the second century BC"), F.concat(F.lit("Book XXVIII, "), a, F.lit(" iugera")), F.lit("0 BCE")]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("t"))
    found = rows.withColumn("v", dates.verdict(dates.readings(F.col("t")), F.col("t")))
    return found.select("o_orderkey", "v.status", F.coalesce("v.start", F.lit(0)).alias("start"), F.coalesce("v.end", F.lit(0)).alias("end"), "v.precision")


@query(f"""SELECT o_orderkey, CASE k WHEN 0 THEN least(-a, b) WHEN 1 THEN -509 WHEN 2 THEN -a ELSE 0 END AS start, CASE k WHEN 0 THEN greatest(-a, b) WHEN 1 THEN -27 WHEN 2 THEN -a ELSE 0 END AS "end",
CASE WHEN k > 2 THEN false ELSE CASE k WHEN 0 THEN greatest(-a, b) WHEN 1 THEN -27 ELSE -a END >= CASE WHEN o_orderkey % 3 = 0 THEN 1500 ELSE -640 END AND CASE k WHEN 0 THEN least(-a, b) WHEN 1 THEN -509 ELSE -a END <= CASE WHEN o_orderkey % 3 = 0 THEN 2100 ELSE 640 END END AS attested
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, {_A} AS a, {_B} AS b FROM orders)""")
def period_windows(spark, sf_dir):
    """Year windows of periods, and whether an attested period meets them."""
    a, b = (F.expr(x).cast("string") for x in (_A, _B))
    forms = [F.concat(a, F.lit(" BCE to "), b, F.lit(" CE")), F.lit("the late Roman Republic"), F.concat(F.lit("-"), a), F.lit("long ago")]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.window(F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("w"), dates.attested(F.when(F.col("o_orderkey") % 3 == 0, "Modern").otherwise("roman")).alias("p"))
    return rows.select("o_orderkey", F.coalesce("w.start", F.lit(0)).alias("start"), F.coalesce("w.end", F.lit(0)).alias("end"), F.coalesce(dates.meets(F.col("w.start"), F.col("w.end"), F.col("p.start"), F.col("p.end")), F.lit(False)).alias("attested"))


# Keys

_FOLD = "replace(replace(lower(text), 'æ', 'ae'), 'œ', 'oe')"
_SYNONYMS = {"thing": "object", "hand": "limb"}


@query(rf"""WITH d AS (SELECT doc_id, translate(regexp_replace({_FOLD}, '([{text.MARKED}])', '\1 ', 'g'), '{text.MARKED}', '{text.PLAIN}') AS gaps, translate({_FOLD}, '{text.MARKED}', '{text.PLAIN}') AS bare, text FROM documents),
t AS (SELECT *, list_filter(regexp_extract_all(gaps, '[a-z][a-z'']{{2,}}'), lambda w: w NOT IN ('the', 'and')) AS w FROM d)
SELECT doc_id, len(list_distinct(regexp_extract_all(gaps, '[a-z0-9]+'))) AS tokens, md5(array_to_string(list_transform(w, lambda x: CASE x WHEN 'thing' THEN 'object' WHEN 'hand' THEN 'limb' ELSE x END), ' ')) AS terms, greatest(len(w) - 1, 0) AS pairs,
md5(trim(regexp_replace(bare, '\s+', ' ', 'g'))) AS surface, len(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '', 'g'), '[^\x00-\x7f]', '', 'g')) AS key_length FROM t""")
def folded_keys(spark, sf_dir):
    """Folded tokens, terms with synonyms, pairs of neighbours, surface and match keys of whole texts."""
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", text.terms(t, ["the", "and"], _SYNONYMS).alias("w"))
    return rows.select("doc_id", F.size(text.folded_tokens(t)).cast("long").alias("tokens"), F.md5(F.array_join("w", " ")).alias("terms"), F.size(text.bigrams(F.col("w"))).cast("long").alias("pairs"), F.md5(text.surface_key(t)).alias("surface"), F.length(F.regexp_replace(text.match_key(t), r"[^\x00-\x7f]", "")).cast("long").alias("key_length"))


@query("""WITH n AS (SELECT p_partkey, p_brand || ', ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' (old ' || p_size || ')' ELSE '' END AS name FROM part)
SELECT DISTINCT p_partkey, trim(f) AS form FROM (SELECT p_partkey, unnest(string_split(regexp_replace(name, '\\s*\\([^()]*\\)\\s*$', ''), ',')) AS f FROM n) WHERE trim(f) <> ''""".replace("\\\\", "\\"))
def name_forms(spark, sf_dir):
    note = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" (old "), F.col("p_size"), F.lit(")"))).otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(", "), "p_type", note).alias("name"))
    return rows.select("p_partkey", F.explode(text.name_forms(F.col("name"))).alias("form"))


@query(r"""WITH w AS (SELECT conv_id, turn, i, w[i] AS word FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM conversations), unnest(range(1, len(w) + 1)) AS u(i)),
f AS (SELECT conv_id, turn, min(i) AS i, arg_min(word, i) AS word FROM w GROUP BY conv_id, turn, lower(word)) SELECT c.conv_id, c.turn, md5(coalesce(j, '')) AS words FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY i) AS j FROM f GROUP BY ALL) x ON c.conv_id = x.conv_id AND c.turn = x.turn""")
def distinct_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.distinct_words(F.col("text"))).alias("words"))


# Chunks


@query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '([A-Za-z])-[ ]*\n[ ]*([A-Za-z])', '\1\2', 'g'), '[ \t\r\n\f]+', ' ', 'g')) AS t FROM pages), s AS (SELECT page_id, t, unnest(range(0, length(t), 375)) AS start FROM p WHERE length(t) > 0),
c AS (SELECT page_id, start, regexp_replace(t[start + 1:start + 500], '^\s+|\s+$', '', 'g') AS part FROM s)
SELECT 'page ' || page_id % 7 AS source_file, CAST(page_id AS INT) AS page_start, CASE WHEN page_id % 2 = 0 THEN 'unknown' ELSE '1' END AS book, start, sha256('page ' || page_id % 7 || ':' || start || ':' || part)[:24] AS chunk_id FROM c WHERE part <> ''""")
def page_chunks(spark, sf_dir):
    """Fixed windows of cleaned pages with defaults for what isn't known."""
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), p % 7).alias("source_file"), p.alias("page_number"), F.when(p % 2 == 1, "1").alias("book"), F.lit(None).cast("string").alias("chapter"), F.col("html").alias("text"))
    return chunks.page_chunks(rows, 500, 300).select("source_file", "page_start", "book", "start", "chunk_id")


@query()
def sentence_chunks(spark, sf_dir):
    """Sentence-aware windows of whole documents as sections; tests hold them against their invariants and cases."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("s").alias("spine_item"), F.lit(0).alias("section_index"), "text")
    return chunks.section_chunks(rows, 800).select("document_id", "start", "end", "chunk_id", "fallback")


# Costs and grids


@query("""SELECT p_partkey, round(least(1.0, greatest(0.0, t)), 6) AS fraction, nx AS columns, ny AS rows, nx * ny <= 1000 AS allowed, least(floor(x / 7.5), nx - 1) AS cell, round(penalty, 6) AS penalty, mode, round(lon, 6) AS lon FROM (
SELECT *, (x * 30 + y * 40) / 2500.0::DOUBLE AS t, greatest(ceil((x + 20) / 7.5), 1) AS nx, greatest(ceil((y + 20) / 7.5), 1) AS ny,
 CASE WHEN abs(rise) / 100 < 0.05 THEN 1.0 WHEN abs(rise) / 100 < 0.15 THEN 1.5 ELSE 5.0 END * 100 * (greatest(rise, 0) / 100 * 0.6::DOUBLE + greatest(-rise, 0) / 100 * 0.05::DOUBLE) + (1 + p_size / 50.0::DOUBLE - 1) * 2 + CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE 0 END AS penalty,
 CASE WHEN h IN ('LAND', 'SEA') THEN h WHEN mixed IS NULL THEN CASE WHEN land IS NULL THEN 'UNAVAILABLE' ELSE 'LAND' END WHEN land IS NULL OR mixed <= land * 0.75 THEN 'LAND_SEA_MIXED' ELSE 'LAND' END AS mode, 10 + degrees(x / (6371000.0::DOUBLE * cos(radians(45)))) AS lon
FROM (SELECT p_partkey, p_size, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 41 - 20 AS DOUBLE) AS rise, CASE p_partkey % 5 WHEN 0 THEN 'LAND' WHEN 1 THEN 'SEA' ELSE 'UNKNOWN' END AS h, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS land, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 50 END AS mixed FROM part))""")
def grid_and_costs(spark, sf_dir):
    """Projection fractions, grid sizes and cells, profile penalties, simulation modes, and local metres backwards."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y, rise = (k % 97).cast("double"), size.cast("double"), (k % 41 - 20).cast("double")
    nx, ny, allowed = geo.grid_size(x, y, 7.5, 10.0, 1000)
    zero = F.lit(0.0)
    mode = geo.simulation_mode(F.when(k % 5 == 0, "LAND").when(k % 5 == 1, "SEA").otherwise("UNKNOWN"), F.when(k % 4 > 0, size), F.when(k % 3 > 0, k % 50))
    penalty = geo.profile_penalty(rise, F.lit(100.0), 1 + size / 50, k % 9 == 0, 0.4, 2.0, 3.0)
    lon, _ = geo.from_local_xy(x, y, F.lit(10.0), F.lit(45.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geo.along(x, y, zero, zero, F.lit(30.0), F.lit(40.0)), 6).alias("fraction"), nx.cast("double").alias("columns"), ny.cast("double").alias("rows"), allowed.alias("allowed"), geo.grid_cell(x, 7.5, nx).cast("double").alias("cell"), F.round(penalty, 6).alias("penalty"), mode.alias("mode"), F.round(lon, 6).alias("lon"))


# Scores

_POOL = """SELECT o_custkey AS q, o_orderkey AS id, o_orderkey % 3 * 0.04::DOUBLE AS person, o_orderkey % 2 * 0.06::DOUBLE AS location, CASE WHEN o_orderkey % 5 < 2 THEN 0.12::DOUBLE ELSE 0 END AS action, o_orderkey % 3 * 0.01::DOUBLE AS generic, CASE WHEN o_orderkey % 7 = 0 THEN 0.06::DOUBLE WHEN o_orderkey % 7 = 1 THEN 0.03::DOUBLE ELSE 0 END AS fragment,
 o_orderkey % 40 AS n_tokens, o_orderkey % 4 > 0 AS semantic, o_orderkey % 5 > 0 AS lexical, o_orderkey % 97 AS vector_rank, o_orderkey % 50 / 100.0::DOUBLE AS distance, o_totalprice / 1000 AS lexical_score, o_orderkey % 11 = 0 AS navigation, o_orderkey % 13 = 0 AS competing, o_orderkey % 2 = 0 AS whole_name, 0.5::DOUBLE AS coverage FROM orders"""


@query(f"""WITH p AS ({_POOL}), r AS (SELECT *, count(*) FILTER (semantic) OVER (PARTITION BY q) AS ns, count(*) FILTER (lexical) OVER (PARTITION BY q) AS nl, median(CASE WHEN lexical THEN lexical_score END) OVER (PARTITION BY q) AS med, rank() OVER (PARTITION BY q ORDER BY CASE WHEN lexical THEN 0 ELSE 1 END, lexical_score DESC) AS lr FROM p),
a AS (SELECT *, CASE WHEN lexical THEN (0.6::DOUBLE * lexical_score / (lexical_score + med) + 0.4::DOUBLE * (nl - lr + 1) / nl) * (0.35::DOUBLE + 0.65::DOUBLE * (person / 0.08::DOUBLE + location / 0.06::DOUBLE) / 2) ELSE 0 END AS words, CASE WHEN action >= 0.12 AND n_tokens >= 20 THEN 0.04::DOUBLE ELSE 0 END AS st FROM r),
b AS (SELECT *, least(1.0::DOUBLE, person / 0.08::DOUBLE * 0.4::DOUBLE + action / 0.12::DOUBLE * 0.4::DOUBLE + location / 0.06::DOUBLE * 0.1::DOUBLE + st / 0.04::DOUBLE * 0.1::DOUBLE + fragment / 0.06::DOUBLE * 0.2::DOUBLE) AS local, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 / (1 + distance) - 0.75::DOUBLE) / 0.03::DOUBLE)) AS s FROM a),
c AS (SELECT *, CASE WHEN semantic THEN local ELSE 0 END AS near FROM b),
d AS (SELECT *, least(1.0::DOUBLE, greatest(near, words) + CASE WHEN fragment > 0 AND ((near = 0 AND words > 0) OR fragment < 0.06) THEN fragment ELSE 0 END) + CASE WHEN semantic AND lexical THEN 0.02::DOUBLE ELSE 0 END + location + action + generic + st AS h, CASE WHEN semantic AND NOT navigation THEN 0.32::DOUBLE * s * s * (3 - 2 * s) * CASE WHEN person > 0 AND person < 0.08 THEN person / 0.08::DOUBLE ELSE 1 END ELSE 0 END AS v FROM c),
e AS (SELECT *, h * CASE WHEN person > 0 AND action >= 0.12 THEN 1 ELSE coverage END + v + CASE WHEN whole_name AND person >= 0.08 AND NOT navigation THEN 0.2::DOUBLE ELSE 0 END AS sup FROM d)
SELECT q, id, round_even(words, 6) AS lexical_support, round_even(local, 6) AS local_support, round_even(v, 6) AS vector_bonus, round_even(sup - CASE WHEN navigation THEN 0.32::DOUBLE ELSE 0 END - CASE WHEN competing THEN least(0.32::DOUBLE, sup / 2) ELSE 0 END, 6) AS final_score FROM e""")
def rerank_scores(spark, sf_dir):
    """The whole score of each candidate of a customer's pool."""
    o, c = F.col("o_orderkey"), F.col
    flag = {"semantic": o % 4 > 0, "lexical": o % 5 > 0, "navigation": o % 11 == 0, "competing": o % 13 == 0, "whole_name": o % 2 == 0}
    numbers = {"person": o % 3 * 0.04, "location": o % 2 * 0.06, "action": F.when(o % 5 < 2, 0.12).otherwise(0.0), "generic": o % 3 * 0.01, "fragment": F.when(o % 7 == 0, 0.06).when(o % 7 == 1, 0.03).otherwise(0.0), "n_tokens": o % 40, "vector_rank": o % 97, "distance": o % 50 / 100.0, "lexical_score": c("o_totalprice") / 1000, "coverage": F.lit(0.5)}
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("q"), o.alias("id"), *[v.alias(k) for k, v in {**flag, **numbers}.items()])
    found = scoring.rerank(rows, "q", "id")
    return found.select("q", "id", "lexical_support", "local_support", "vector_bonus", "final_score")


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN NOT list_has_any(t, ['inen', 'thing']) THEN 0 WHEN list_has_all(t, ['inen', 'thing']) THEN 0.08 WHEN list_contains(t, 'thing') AND list_has_any(t, ['the', 'hand']) THEN 0 ELSE 0.04 END AS person, CASE WHEN list_has_any(t, ['de', 'er']) THEN 0.06 ELSE 0 END AS location, list_contains(t, 'and') AS a, list_contains(t, 'on') AS x, least(0.02, 0.01 * len(list_intersect(t, ['of', 'that', 'in']))) AS generic FROM t)
SELECT doc_id, CAST(person AS DOUBLE) AS person, CAST(location AS DOUBLE) AS location, CAST(CASE WHEN person > 0 OR location > 0 THEN CASE WHEN a OR x THEN 0.12 ELSE 0 END WHEN a THEN 0.02 ELSE 0 END AS DOUBLE) AS action, CAST(generic AS DOUBLE) AS generic FROM s""")
def role_supports(spark, sf_dir):
    """Supports of a query's roles by each document's tokens."""
    some = lambda *w: F.array(*map(F.lit, w))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    found = scoring.supports(F.col("t"), some("inen", "thing"), some("de", "er"), some("and"), some("on"), some("of", "that", "in"), some("the", "hand"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tokens.alias("t")).select("doc_id", *[F.round(v, 6).alias(k) for k, v in found.items()])


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?:^|[^a-z])hand(?:$|[^a-z])') THEN 100 ELSE 0 END + CASE WHEN contains(t, 'ing') THEN 40 ELSE 0 END + CASE WHEN contains(t, 'worthless') THEN 40 ELSE 0 END + least(len(regexp_extract_all(t, ' (?:of|de) [a-z]')), 3) * 10 + CAST(doc_id % 7 AS INT) + CAST(doc_id % 3 * 30 AS INT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def assertion_scores(spark, sf_dir):
    t = F.lower("text")
    score = scoring.assertion_score(t, "(?:^|[^a-z])hand(?:$|[^a-z])", "ing", "worthless", " (?:of|de) [a-z]", (F.col("doc_id") % 7).cast("int"), F.round(F.col("doc_id") % 3 * 0.03, 6))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", score.alias("score"))


def _pool(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), o.alias("id"), (o % 5).alias("source"), (o % 60 * 10).alias("start"), (o % 60 * 10 + 25).alias("stop"), F.round(F.col("o_totalprice") / 1000 - 50, 3).alias("score"), "o_totalprice")
    return retrieval.top_k(rows, "query_id", [F.desc("score"), "id"], 200).drop("o_totalprice")


@query()
def diverse_selection(spark, sf_dir):
    """Greedy selection with sources spread, and why each candidate fell; tests hold it against a plain loop."""
    o = F.col("id")
    rows = _pool(spark, sf_dir).withColumns({"useful": o % 6 > 0, "scoped": o % 4 > 0, "pair": o % 9 == 0, "movement": o % 3 == 0, "spread": F.lit(True)})
    return selection.select_diverse(rows, 5).select("query_id", "id", "reason", "place")


@query()
def seat_allocation(spark, sf_dir):
    """Seats for a lexical reserve, qualified, then other rows; tests hold it against its rules."""
    o = F.col("id")
    rows = _pool(spark, sf_dir).withColumns({"lexical": o % 2 == 0, "lexical_rank": o % 31, "qualified": o % 3 > 0})
    return selection.seat(rows, 8).select("query_id", "id", "seat")


@query()
def intent_merge(spark, sf_dir):
    """Rows that several intents of a query propose, seated within a budget; tests hold it against its rules."""
    o = F.col("id")
    pool = _pool(spark, sf_dir)
    facets = F.filter(F.array(F.when(o % 3 == 0, "PRIMARY_MOVEMENT"), F.when(o % 4 == 0, "ENDPOINT"), F.when(o % 5 == 0, "EPISODE")), lambda x: x.isNotNull())
    rows = pool.withColumns({"intent": F.explode(F.array(F.lit("CANONICAL"), F.concat(F.lit("I"), o % 3))), "family": o % 7, "local_rank": F.col("rank"), "facets": facets, "movement": o % 3 == 0, "qualified": o % 2 == 0, "canonical": o % 5 > 0})
    return selection.merge_intents(rows.withColumn("canonical_intent", F.col("intent") == "CANONICAL"), 6)


# Routes


@query("""WITH s AS (SELECT l_orderkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 'Unknown') AS status, count(*) AS segments, round(sum(l_extendedprice), 3) AS metres FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey, string_agg(CAST(cit AS VARCHAR), ',' ORDER BY p) AS citations FROM (SELECT l_orderkey, l_suppkey AS cit, min((l_linenumber, l_suppkey)) AS p FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY ALL) GROUP BY ALL)
SELECT l_orderkey, status, segments, metres, coalesce(citations, '') AS citations FROM s LEFT JOIN c USING (l_orderkey)""")
def path_profiles(spark, sf_dir):
    flag, cite = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", flag.alias("status"), F.col("l_extendedprice").alias("metres"), cite.alias("citation"), F.col("l_linenumber").alias("position"))
    found = routes.path_profile(rows, "l_orderkey")
    return found.withColumn("citations", F.coalesce(F.array_join("citations", ","), F.lit("")))


@query("""SELECT l_orderkey, count(*) FILTER (l_partkey % 3 > 0) AS found, count(*) FILTER (l_partkey % 3 = 0) AS missing, coalesce(round(sum(CASE WHEN l_partkey % 3 > 0 THEN l_quantity END), 3), 0) AS metres, CASE WHEN count(*) FILTER (l_partkey % 3 > 0) = 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (l_partkey % 3 = 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM lineitem GROUP BY 1""")
def leg_totals(spark, sf_dir):
    return routes.route_totals(table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity")).alias("metres")), "l_orderkey")


@query("""WITH e AS (SELECT *, CAST(l_partkey % 100 AS DOUBLE) - lag(CAST(l_partkey % 100 AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rise FROM lineitem)
SELECT l_orderkey, round(sum(l_quantity), 6) AS distance, round(sum(l_tax), 6) AS terrain, round(coalesce(sum(rise) FILTER (rise > 0), 0), 6) AS climb, round(coalesce(sum(-rise) FILTER (rise < 0), 0), 6) AS descent, min(l_discount) AS confidence, round(max(abs(rise) / l_quantity), 6) AS steepest FROM e GROUP BY 1""")
def cost_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.col("l_quantity").alias("distance"), F.col("l_tax").alias("terrain"), F.col("l_discount").alias("confidence"), (F.col("l_partkey") % 100).cast("double").alias("height"))
    return routes.cost_totals(rows, "l_orderkey", "place")


@query("""WITH p AS (SELECT l_orderkey, round(avg(CASE WHEN l_suppkey % 3 > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS land_ratio, list(l_partkey % 9 ORDER BY l_linenumber, l_partkey % 9) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, land_ratio, CASE WHEN l_orderkey % 2 = 0 THEN list_filter(p, lambda x: x IN (2, 5)) = [2, 5] ELSE true END AS order_preserved FROM p""")
def route_quality(spark, sf_dir):
    """Share of a route on land, and whether the wanted places come in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 9).alias("place"))
    wanted = rows.where("l_orderkey % 2 = 0").select("l_orderkey").distinct().withColumn("places", F.array(F.lit(2).cast("long"), F.lit(5).cast("long")))
    return routes.quality(rows, "l_orderkey", "l_linenumber", F.col("l_suppkey") % 3 > 0, wanted)


_PARALLEL = "SELECT l_suppkey % 40 AS src, l_partkey % 40 AS dst, CASE WHEN l_linenumber % 2 = 0 THEN [l_suppkey % 40, l_partkey % 40] ELSE [l_partkey % 40, l_suppkey % 40] END AS geometry FROM lineitem WHERE l_quantity < 3"


@query(f"""WITH RECURSIVE e AS ({_PARALLEL}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(n, c) AS (SELECT a, a FROM b UNION SELECT b.b, c FROM r JOIN b ON r.n = b.a), c AS (SELECT n, min(c) AS c FROM r GROUP BY n), z AS (SELECT c, count(*) AS n FROM c GROUP BY c)
SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM z) AS components, (SELECT max(n) FROM z) AS largest, (SELECT count(*) FROM e WHERE src = dst) AS self_loops, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM e GROUP BY least(src, dst), greatest(src, dst))) AS parallel,
(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM e GROUP BY least(geometry, list_reverse(geometry)))) AS duplicate_geometry""")
def graph_statistics(spark, sf_dir):
    s, d = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    edges = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(s.alias("src"), d.alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, F.array(s, d)).otherwise(F.array(d, s)).alias("geometry"))
    return routes.graph_statistics(edges, ordering.weak_components(edges))


@query("""WITH e AS (SELECT l_partkey AS n FROM lineitem UNION ALL SELECT l_suppkey + 1000000 FROM lineitem), d AS (SELECT n, count(*) AS degree FROM e GROUP BY n), c AS (SELECT degree, count(*) AS nodes FROM d GROUP BY degree) SELECT degree, nodes, round(nodes / sum(nodes) OVER (), 6) AS share FROM c""")
def degree_distribution(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))
    return routes.network_audit(edges, ordering.degrees(edges))


@query("""SELECT leg, kind, cost, id FROM (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY CASE kind WHEN 'road' THEN 1 WHEN 'terrain' THEN 2 ELSE 3 END, cost, id) AS n FROM (SELECT l_orderkey AS leg, CASE l_linenumber % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'terrain' ELSE 'mixed' END AS kind, l_extendedprice AS cost, l_linenumber AS id, l_suppkey % 4 > 0 AS ok FROM lineitem) WHERE ok) WHERE n = 1""")
def leg_candidates(spark, sf_dir):
    """The road, else the way over land, else the mixed one of each leg."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("leg"), F.when(n % 3 == 0, "road").when(n % 3 == 1, "terrain").otherwise("mixed").alias("kind"), F.col("l_extendedprice").alias("cost"), n.alias("id"), (F.col("l_suppkey") % 4 > 0).alias("ok"))
    return routes.best_candidates(rows, "leg", ("road", "terrain", "mixed")).drop("ok")


_PROFILES = (("historical", 1.0, 2.0), ("shortest", 0.0, 0.0), ("terrain", 5.0, 0.0))


@query(f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', CAST({t} AS DOUBLE), CAST({h} AS DOUBLE))" for n, t, h in _PROFILES)}) AS v(profile, tw, hw)), c AS (SELECT o_orderkey, profile, round(o_totalprice + o_custkey * tw + o_orderkey % 1000 * hw, 6) AS total_cost, round(0.5::DOUBLE * o_totalprice + 0.3::DOUBLE * o_custkey * tw + 0.2::DOUBLE * (o_orderkey % 1000) * hw, 6) AS weighted FROM orders, p)
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY weighted, total_cost, profile) AS rank FROM c""")
def route_variants(spark, sf_dir):
    """Three profiles of each route, weighed and ranked."""
    profiles = spark.createDataFrame([*_PROFILES], "profile string, terrain_weight double, history_weight double")
    legs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("distance"), F.col("o_custkey").cast("double").alias("terrain"), (F.col("o_orderkey") % 1000).cast("double").alias("history"))
    return routes.variants(legs, profiles, (0.5, 0.3, 0.2), "o_orderkey").select("o_orderkey", "profile", "total_cost", "weighted", "rank")


@query("""WITH f AS (SELECT l_orderkey, list({'o': l_linenumber, 'x': l_partkey % 100, 'y': l_suppkey % 50} ORDER BY l_linenumber, l_partkey % 100, l_suppkey % 50) FILTER (l_partkey % 5 > 0) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, '{"type":"Feature","geometry":' || CASE WHEN len(p) > 1 THEN '{"type":"LineString","coordinates":[' || array_to_string(list_transform(p, lambda q: '[' || q.x || '.0,' || q.y || '.0]'), ',') || ']}' ELSE 'null' END || ',"properties":{"id":"' || l_orderkey || '"}}' AS feature FROM f""")
def route_features(spark, sf_dir):
    """Each order's lines as a GeoJSON line; too few points have no geometry."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(k % 5 > 0, (k % 100).cast("double")).alias("lon"), (F.col("l_suppkey") % 50).cast("double").alias("lat"))
    return routes.features(rows, "l_orderkey", "l_linenumber")


@query("""WITH l AS (SELECT l_orderkey, string_agg('{"l_linenumber":' || l_linenumber || ',"mode":"' || l_returnflag || '","metres":' || CASE WHEN l_partkey % 4 > 0 THEN CAST(CAST(l_partkey AS BIGINT) AS VARCHAR) ELSE 'null' END || ',"col4":"' || CASE WHEN l_partkey % 4 > 0 THEN 'leg' ELSE 'gap' END || '"}', ',' ORDER BY l_linenumber, l_returnflag, CASE WHEN l_partkey % 4 > 0 THEN l_partkey END NULLS FIRST) AS legs FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"id":' || o_orderkey || ',"score":{"score":' || o_custkey || ',"status":"' || o_orderstatus || '"},"explanation":"' || o_orderpriority || '","legs":' || CASE WHEN legs IS NULL THEN 'null' ELSE '[' || legs || ']' END || '}' AS document FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""".replace('"col4"', '"kind"'))
def route_documents(spark, sf_dir):
    """Routes with score, explanation and legs as nested JSON; a gap has no metres."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("explanation"))
    legs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_returnflag").alias("mode"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("metres"))
    return routes.presentation(o, legs, "o_orderkey", "l_linenumber")


@query("""SELECT 'place' AS kind, CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey AS VARCHAR) AS refs, CASE WHEN s_acctbal < 0 THEN 'unresolved' ELSE '' END AS reason, CASE WHEN s_acctbal < 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status FROM supplier
UNION ALL SELECT 'edge', l_partkey || '>' || l_suppkey, CAST(l_orderkey AS VARCHAR), CASE WHEN l_tax > 0.07 THEN 'not_admitted' ELSE '' END, CASE WHEN l_tax > 0.07 THEN 'REJECTED' ELSE 'ACCEPTED' END FROM lineitem""")
def provenance_ledger(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("refs"), F.when(F.col("s_acctbal") < 0, "unresolved").alias("reason"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").cast("string").alias("refs"), F.when(F.col("l_tax") > 0.07, "not_admitted").alias("reason"))
    return routes.ledger(s, e).fillna("", ["reason"])


@query("""SELECT r_regionkey, CAST(i - 1 AS INT) AS position, names[i] AS n_name, names[i] IN (SELECT n_name FROM nation) AS known FROM (SELECT r_regionkey, ['BRAZIL', r_name, 'CHINA', 'NATION_' || r_regionkey] AS names FROM region), unnest(range(1, 5)) AS u(i)""")
def configured_chains(spark, sf_dir):
    config = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.lit("BRAZIL"), "r_name", F.lit("CHINA"), F.concat(F.lit("NATION_"), "r_regionkey")).alias("names"))
    return routes.configured_chain(config, table(spark, sf_dir, "nation"), "r_regionkey", "names", "n_name")


@query("""SELECT o_orderkey, CASE WHEN a = 'MISSING' THEN 'retrieved' WHEN b = 'MISSING' THEN 'extracted' WHEN c = 'MISSING' THEN 'admitted' ELSE 'none' END AS first_failing, a <> 'MISSING' AND b <> 'MISSING' AND c <> 'MISSING' AS passed
FROM (SELECT o_orderkey, list_value('EXACT', 'ASSERTION_EQUIVALENT_OVERLAP', 'MISSING', 'NOT_CHECKABLE')[CAST(o_orderkey % 4 AS INT) + 1] AS a, list_value('EXACT', 'ASSERTION_EQUIVALENT_OVERLAP', 'MISSING', 'NOT_CHECKABLE')[CAST(o_custkey % 4 AS INT) + 1] AS b, CASE WHEN o_orderstatus = 'F' THEN 'MISSING' ELSE 'EXACT' END AS c FROM orders)""")
def gold_funnel(spark, sf_dir):
    labels = F.array(*map(F.lit, ("EXACT", "ASSERTION_EQUIVALENT_OVERLAP", "MISSING", "NOT_CHECKABLE")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(labels, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("retrieved"), F.element_at(labels, (F.col("o_custkey") % 4 + 1).cast("int")).alias("extracted"), F.when(F.col("o_orderstatus") == "F", "MISSING").otherwise("EXACT").alias("admitted"))
    return routes.stage_funnel(rows, ["retrieved", "extracted", "admitted"]).select("o_orderkey", F.coalesce("first_failing", F.lit("none")).alias("first_failing"), "passed")


_RULES = [("sea", ["copper"]), ("river", ["steel", "tin"]), ("settlement", ["brass"])]


@query("""WITH t AS (SELECT p_partkey, p_size, string_split(lower(p_type), ' ') AS t, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN list_has_any(t, ['copper']) THEN 'sea' WHEN list_has_any(t, ['steel', 'tin']) THEN 'river' WHEN list_has_any(t, ['brass']) THEN 'settlement' ELSE 'unknown' END AS semantics, CASE WHEN p_size < 5 OR p_partkey % 7 = 0 THEN 'BLOCKED' WHEN p_size > 30 AND p_partkey % 2 = 0 THEN 'STRONG' WHEN p_size > 30 OR p_partkey % 2 = 0 THEN 'WEAK' ELSE 'NONE' END AS strength,
concat_ws(',', CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_partkey % 7 = 0 THEN 'conflict' END) AS blockers, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS canonical FROM part JOIN t USING (p_partkey, p_size)""")
def feature_semantics(spark, sf_dir):
    """Kind of feature by types, strength of the evidence with blockers, and canonical JSON."""
    size, k = F.col("p_size"), F.col("p_partkey")
    strength, blockers, _ = routes.authority_strength({"small": size < 5, "conflict": k % 7 == 0}, {"large": size > 30, "even": k % 2 == 0})
    kind = routes.feature_role(F.split(F.lower("p_type"), " "), _RULES)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("semantics"), strength.alias("strength"), F.array_join(blockers, ",").alias("blockers"), F.to_json(F.struct(F.col("p_brand").alias("brand"), size.alias("size"))).alias("canonical"))


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), '') AS k, props LIKE '{%' AS is_object FROM events""")
def json_columns(spark, sf_dir):
    """Optional keys of a JSON column, only where they are present."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.startswith("props", F.lit("{")).alias("is_object"))


# Graphs


@query("""WITH g AS (SELECT l_partkey % 50 AS src, 100 + l_suppkey AS dst, l_linenumber % 3 AS priority, l_returnflag AS authority, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS refs, count(*) AS merged FROM lineitem GROUP BY ALL)
SELECT src, dst, CAST(priority AS INT) AS priority, authority, refs, merged, CASE WHEN row_number() OVER (PARTITION BY src, dst ORDER BY priority, authority) = 1 THEN 'KEPT' ELSE 'REJECTED' END AS status FROM g""")
def edge_authorities(spark, sf_dir):
    """Of several edges between two nodes the best priority; equal authority merges references."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("src"), (100 + F.col("l_suppkey")).alias("dst"), (F.col("l_linenumber") % 3).alias("priority"), F.col("l_returnflag").alias("authority"), F.array(F.col("l_orderkey").cast("string")).alias("refs"))
    return ordering.resolve_duplicates(rows).withColumn("refs", F.array_join("refs", ","))


_ARROWS = "SELECT c_custkey % 400 AS src, c_custkey * c_custkey % 401 AS dst FROM customer WHERE c_custkey % 400 <> c_custkey * c_custkey % 401 UNION SELECT c_custkey * c_custkey % 401, c_custkey % 400 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 400 <> c_custkey * c_custkey % 401"


def _arrows(spark, sf_dir):
    k = F.col("c_custkey")
    one = table(spark, sf_dir, "customer").select("c_custkey", (k % 400).alias("src"), (k * k % 401).alias("dst")).where("src <> dst")
    return one.select("src", "dst").union(one.where("c_custkey % 3 = 0").select("dst", "src")).distinct()


@query(f"""WITH RECURSIVE e AS ({_ARROWS}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def cycle_components(spark, sf_dir):
    """Strongly connected components of several nodes."""
    return ordering.cycle_nodes(_arrows(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({_ARROWS}), f(n, l) AS (SELECT CAST(4 AS BIGINT), 0 UNION SELECT e.dst, f.l + 1 FROM f JOIN e ON f.n = e.src WHERE f.l < 4), g(n, l) AS (SELECT CAST(16 AS BIGINT), 0 UNION SELECT e.src, g.l + 1 FROM g JOIN e ON g.n = e.dst WHERE g.l < 4),
a AS (SELECT n, min(l) AS l FROM f GROUP BY n), b AS (SELECT n, min(l) AS l FROM g GROUP BY n) SELECT src, dst FROM e JOIN a ON a.n = src JOIN b ON b.n = dst WHERE a.l + b.l + 1 <= 4""")
def bounded_paths(spark, sf_dir):
    """Edges on a walk of at most four edges from node 4 to node 16."""
    node = lambda n: spark.range(n, n + 1).withColumnRenamed("id", "node")
    return ordering.between(_arrows(spark, sf_dir), node(4), node(16), 4)


@query("""WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events), h AS (SELECT user_id, event_id AS head FROM n WHERE position = 0),
o AS (SELECT *, min(CASE WHEN event_type = 'view' THEN position END) OVER (PARTITION BY user_id) AS o FROM n), d AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND position > o THEN position END) OVER (PARTITION BY user_id) AS d FROM o)
SELECT event_id AS node, head, position FROM d JOIN h USING (user_id) WHERE position BETWEEN o AND d AND user_id IN (SELECT user_id FROM n GROUP BY 1 HAVING count(*) > 1)""")
def anchored_chains(spark, sf_dir):
    """Of each user's chain the part from the first view to the next purchase."""
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id", "event_id", "ts").withColumn("o", F.col("event_id"))
    found = ordering.linear_chains(ordering.consecutive(rows, "user_id", ["ts", "o"], "event_id").select("src", "dst"))
    typed = found.join(events.select(F.col("event_id").alias("node"), "event_type"), "node")
    return ordering.anchored(typed, F.col("event_type") == "view", F.col("event_type") == "purchase").select("node", "head", "position")


@query()
def route_paths(spark, sf_dir):
    """Paths from supplier 1 to every part; tests hold their lengths and edges against Dijkstra's algorithm."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst")).agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))
    found = ordering.shortest_paths(edges, spark.range(1, 2).withColumnRenamed("id", "node"))
    targets = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("target"))
    return ordering.paths_to(found, targets).select("target", F.array_join("nodes", ">").alias("path"))
