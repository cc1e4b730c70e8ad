"""Queries of the filters and verdicts over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.operators import filters, retrieval
from lodeline.plans.registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2")
def equality_filter(spark, sf_dir):
    """Non-empty values only; an empty wanted value doesn't filter."""
    return table(spark, sf_dir, "lineitem").where(filters.equals({"l_returnflag": "R", "l_linenumber": 2, "l_linestatus": ""})).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderpriority, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'F') WHERE rank <= 10""")
def filtered_top_k(spark, sf_dir):
    """A metadata filter takes effect before the first k are taken."""
    rows = table(spark, sf_dir, "orders").where(filters.equals({"o_orderstatus": "F"}))
    return retrieval.top_k(rows, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 10).select("o_orderpriority", "o_orderkey", "rank")


@query("""SELECT doc_id, concat_ws(', ', source, lang) AS locator, md5(text[:500]) AS excerpt, round_even(1 / (1 + n_chars / 1000.0::DOUBLE), 4) AS score FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""")
def evidence_projection(spark, sf_dir):
    """Locator, excerpt and score of each document; rows without a source are skipped."""
    return retrieval.evidence(table(spark, sf_dir, "documents").where("text is not null"), ["source", "lang"], F.col("text"), F.col("n_chars") / 1000.0, "source").select("doc_id", "locator", F.md5("excerpt").alias("excerpt"), "score")


_PAGE = "CAST(page_id % 40 AS INT)"


@query(f"""SELECT kind, kind NOT IN ('front_matter', 'advertisement', 'copyright', 'toc', 'gutenberg_footer') AS indexed, count(*) AS n FROM (
  SELECT CASE WHEN contains(t, 'project gutenberg') OR contains(t, 'gutenberg-tm') THEN 'gutenberg_footer' WHEN p < 15 AND contains(t, 'contents') THEN 'toc' WHEN p < 15 AND (contains(t, 'copyright') OR contains(t, 'all rights reserved')) THEN 'copyright'
  WHEN p < 20 AND (contains(t, 'dictionary') OR contains(t, 'published by') OR contains(t, 'advertisement')) THEN 'advertisement' WHEN p < 20 THEN 'front_matter' WHEN page_id % 3 > 0 THEN 'body' ELSE 'unknown' END AS kind
  FROM (SELECT page_id, lower(html) AS t, {_PAGE} AS p FROM pages)) GROUP BY ALL""")
def page_types(spark, sf_dir):
    book = F.when(F.col("page_id") % 3 > 0, "1").otherwise("unknown")
    kind = filters.page_type(F.col("html"), (F.col("page_id") % 40).cast("int"), book)
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select("kind", (~F.col("kind").isin(*filters.NON_BODY)).alias("indexed"), "n")


@query(r"""SELECT doc_id, regexp_matches(h, '(?i)^\s*(?:index|contents|table of contents)\.?\s*$') OR s IN ('toc', 'contents', 'navigation', 'index') OR starts_with(t, 'the following is contained') OR starts_with(t, 'table of contents') OR starts_with(t, 'contents') OR starts_with(t, 'this ebook is for the use') OR regexp_matches(t, '(?i)^\s*book\s+[ivxlcdm0-9]+\.?\s+(?:[0-9]+\s+){8,}') AS navigation
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Contents. ' WHEN doc_id % 13 = 0 THEN 'Index' ELSE 'Chapter ' || doc_id END AS h, CASE WHEN doc_id % 17 = 0 THEN 'toc' ELSE 'nav' END AS s,
  lower(ltrim(CASE WHEN doc_id % 19 = 0 THEN ' Table of Contents ' || text WHEN doc_id % 23 = 0 THEN 'Book XII. 1 2 3 4 5 6 7 8 9 ' || text ELSE text END)) AS t FROM documents)""")
def navigation_texts(spark, sf_dir):
    i, t = F.col("doc_id"), F.col("text")
    heading = F.when(i % 11 == 0, "Contents. ").when(i % 13 == 0, "Index").otherwise(F.concat(F.lit("Chapter "), i))
    told = F.when(i % 19 == 0, F.concat(F.lit(" Table of Contents "), t)).when(i % 23 == 0, F.concat(F.lit("Book XII. 1 2 3 4 5 6 7 8 9 "), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", filters.is_navigation(told, F.when(i % 17 == 0, "toc").otherwise("nav"), heading).alias("navigation"))


_ASKED = ("Did he march from A to B", "Trace the route of the army", "Who was consul", "Where is the river", "Was the expedition to show the coast long", "the crossing of the Alps")
_ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_ASKED)) + ") AS q(n, asked)"


@query(rf"""SELECT o_orderkey, asked, r AS moves, r AND (NOT regexp_matches(asked, '{filters.POLAR_QUERY}') OR c) AS spread, CASE WHEN r AND c THEN 'historical_route' WHEN regexp_matches(asked, '(?i)\b(?:where|river|coast)\b') THEN 'geography_fact' ELSE 'answer' END AS output
FROM (SELECT o_orderkey, asked, regexp_matches(asked, '{filters.ROUTE_QUERY}') AS r, regexp_matches(asked, '{filters.ROUTE_CUE}') AS c FROM orders JOIN {_ASKED_SQL} ON n = o_orderkey % 6)""")
def query_modes(spark, sf_dir):
    """Movement, spread of sources and output kind of the questions asked."""
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", asked.alias("asked"))
    moves, spread = filters.query_modes(F.col("asked"))
    return rows.select("o_orderkey", "asked", moves.alias("moves"), spread.alias("spread"), filters.output_kind(F.col("asked"), r"(?i)\b(?:where|river|coast)\b").alias("output"))


@query("""SELECT l_orderkey, l_linenumber, l_tax * 5 < 0.32 AND ((l_linenumber % 2 = 0 AND (l_discount * 2 >= 0.15 OR l_quantity / 50 >= 0.65 OR l_tax >= 0.45)) OR (l_partkey % 2 = 0 AND (l_discount >= 0.08 OR l_tax >= 0.05) AND l_quantity / 50 >= 0.15)) AS qualifies FROM lineitem""")
def proposal_qualification(spark, sf_dir):
    """Thresholds of either channel; a navigation penalty rejects."""
    ranking = {"lexical_support": F.col("l_discount") * 2, "lexical_rank_relevance": F.col("l_quantity") / 50, "lexical_score_relevance": F.col("l_tax"), "semantic_relevance": F.col("l_discount"), "passage_local_support": F.col("l_tax"), "parent_semantic_prior": F.col("l_quantity") / 50, "navigation_penalty": F.col("l_tax") * 5}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filters.qualifies(F.col("l_partkey") % 2 == 0, F.col("l_linenumber") % 2 == 0, ranking).alias("qualifies"))


_KINDS = ("sea", "strait", "river", "mountain_region", "region", "island", "pass", "port", "settlement", "unknown")
_KIND_SQL = f"list_value({', '.join(repr(k) for k in _KINDS)})[CAST(p_partkey % 10 AS INT) + 1]"


@query(f"""SELECT p_partkey, kind, role, NOT strong OR (point AND role = 'exact_site') AS exact, point AND kind <> 'unknown' AND (role = 'exact_site' OR kind IN ('settlement', 'port') AND role = 'representative_point') AS simulated, kind IN ('sea', 'strait', 'river', 'mountain_region', 'pass') AS traversed
FROM (SELECT *, kind NOT IN ('sea', 'strait', 'river', 'mountain_region', 'region', 'island') AS point, CASE WHEN kind IN ('sea', 'strait') THEN 'feature_reference' WHEN kind IN ('mountain_region', 'region') THEN 'regional_centroid' WHEN kind = 'island' THEN 'feature_centroid' WHEN kind IN ('pass', 'port') THEN 'exact_site' ELSE 'representative_point' END AS role
  FROM (SELECT p_partkey, {_KIND_SQL} AS kind, p_size % 2 = 0 AS strong FROM part))""")
def anchor_eligibility(spark, sf_dir):
    """Coordinate role of each kind of feature, and what it may anchor."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", kind.alias("kind")).withColumn("role", filters.coordinate_role(F.col("kind")))
    exact, simulated, traversed = filters.anchors(F.col("kind"), F.col("role"), F.col("p_size") % 2 == 0)
    return rows.select("p_partkey", "kind", "role", exact.alias("exact"), simulated.alias("simulated"), traversed.alias("traversed"))


_BOXES = "(VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in filters.BASINS) + ") AS b(name, south, west, north, east)"


@query(f"""SELECT c_custkey, string_agg(name, ',' ORDER BY name) AS basins, count(name) AS n, lon BETWEEN -10.0 AND 30.0 AND lat BETWEEN 30.0 AND 60.0 AS in_view
FROM (SELECT c_custkey, (c_custkey * 7 % 700) / 10.0 - 10 AS lon, (c_custkey * 3 % 300) / 10.0 + 20 AS lat FROM customer) LEFT JOIN {_BOXES} ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY c_custkey, lon, lat""")
def box_membership(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", ((k * 7 % 700) / 10.0 - 10).alias("lon"), ((k * 3 % 300) / 10.0 + 20).alias("lat"))
    names = filters.basins(F.col("lat"), F.col("lon"))
    return rows.select("c_custkey", F.when(F.size(names) > 0, F.array_join(F.array_sort(names), ",")).alias("basins"), F.size(names).cast("long").alias("n"), filters.within_box(F.col("lon"), F.col("lat"), (-10.0, 30.0, 30.0, 60.0)).alias("in_view"))


@query("""WITH c AS (SELECT o_custkey AS mention, o_orderkey % 4 > 0 AS located, o_orderkey % 5 = 0 AS period, list_value('ORIGIN', 'DESTINATION', 'TRAVERSAL', 'RELATED_PLACE')[CAST(o_custkey % 4 AS INT) + 1] AS role,
  list_value('settlement', 'province', 'label', 'unlocated')[CAST(o_orderkey % 4 AS INT) + 1] AS kind, o_orderkey % 3 AS mine, o_custkey % 3 AS other FROM orders),
f AS (SELECT *, role = 'TRAVERSAL' AND kind IN ('province', 'label') OR role IN ('ORIGIN', 'DESTINATION') AND kind IN ('label', 'unlocated') OR role = 'RELATED_PLACE' AND kind = 'label' AS bad_kind, mine > 0 AND other > 0 AND mine <> other AS apart, role IN ('ORIGIN', 'DESTINATION') AND NOT located AS floating FROM c),
g AS (SELECT mention, count(*) AS n, count(*) FILTER (NOT (period OR bad_kind OR apart OR floating)) AS survivors, count(*) FILTER (located AND NOT (period OR bad_kind OR apart OR floating)) AS located, bool_or(apart) AS by_basin FROM f GROUP BY mention)
SELECT mention, CASE WHEN survivors = 1 AND located = 1 AND NOT (n >= 2 AND by_basin) THEN 'UNIQUE' WHEN survivors = 1 AND located = 0 THEN 'UNLOCATED' ELSE 'AMBIGUOUS' END AS status, survivors FROM g""")
def context_resolution(spark, sf_dir):
    """Exclusion filters on each mention's candidates, and what is left of them."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 4 + 1).cast("int"))
    box = lambda n: F.when(n > 0, F.array(F.concat(F.lit("box"), n))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select(c.alias("mention"), (o % 4 > 0).alias("located"), (o % 5 == 0).alias("period"), pick(("ORIGIN", "DESTINATION", "TRAVERSAL", "RELATED_PLACE"), c).alias("role"), F.array(pick(("settlement", "province", "label", "unlocated"), o)).alias("types"), box(o % 3).alias("mine"), F.array(box(c % 3)).alias("others"))
    failed = filters.failed_filters(*(F.col(x) for x in ("period", "role", "types", "located", "mine", "others")))
    return filters.resolve(rows.withColumn("failed", failed), "mention")


_NEEDS = ("compatibility", "assertion", "subject", "temporal")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS a, CASE l_suppkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS b, CASE l_linenumber WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS c,
  CASE WHEN l_quantity < 10 THEN false WHEN l_quantity < 15 THEN NULL ELSE true END AS d, CASE l_orderkey % 9 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS v, l_orderkey % 2 = 0 AS nc, l_orderkey % 3 = 0 AS nd FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(v, true) AND coalesce(a, false) AND coalesce(b, false) AND (NOT nc OR coalesce(c, false)) AND (NOT nd OR coalesce(d, false)) AS admitted,
  concat_ws(',', CASE WHEN NOT a THEN 'compatibility_REJECTED' WHEN a IS NULL THEN 'compatibility_UNKNOWN' END, CASE WHEN NOT b THEN 'assertion_REJECTED' WHEN b IS NULL THEN 'assertion_UNKNOWN' END, CASE WHEN nc AND NOT c THEN 'subject_REJECTED' WHEN nc AND c IS NULL THEN 'subject_UNKNOWN' END, CASE WHEN nd AND NOT d THEN 'temporal_REJECTED' WHEN nd AND d IS NULL THEN 'temporal_UNKNOWN' END) AS reasons FROM s""")
def admission(spark, sf_dir):
    """Required tri-state signals, a veto, and the codes of what failed; kept and rejected rows both come back."""
    state = lambda no, unknown: F.when(no, False).when(unknown, None).otherwise(True)
    c = F.col
    signals = {"compatibility": state(c("l_partkey") % 7 == 0, c("l_partkey") % 7 == 1), "assertion": state(c("l_suppkey") % 5 == 0, c("l_suppkey") % 5 == 1), "subject": state(c("l_linenumber") == 1, c("l_linenumber") == 2), "temporal": state(c("l_quantity") < 10, c("l_quantity") < 15), "identity": state(c("l_orderkey") % 9 == 0, c("l_orderkey") % 9 == 1)}
    required = dict(zip(_NEEDS, (F.lit(True), F.lit(True), c("l_orderkey") % 2 == 0, c("l_orderkey") % 3 == 0), strict=True))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filters.admitted(signals, required, ("identity",)).alias("admitted"), F.array_join(filters.reasons(signals, required), ",").alias("reasons"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'WRONG' WHEN o_orderkey % 4 = 0 OR o_custkey % 6 = 0 THEN 'UNKNOWN' WHEN e >= qs AND coalesce(qe, qs) >= s THEN 'MATCH' ELSE 'WRONG' END AS matches
FROM (SELECT o_orderkey, o_custkey, -(o_orderkey % 300) AS s, -(o_orderkey % 300) + o_custkey % 5 AS e, -(o_custkey % 300) AS qs, CASE WHEN o_custkey % 2 = 0 THEN -(o_custkey % 300) + 40 END AS qe FROM orders)""")
def temporal_states(spark, sf_dir):
    """Closed intervals of years against a query's: match, wrong or unknown."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.when(o % 4 > 0, -(o % 300))
    state = filters.temporal_state(start, -(o % 300) + c % 5, o % 11 == 0, F.when(c % 6 > 0, -(c % 300)), F.when(c % 2 == 0, -(c % 300) + 40))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(state.isNull(), "UNKNOWN").when(state, "MATCH").otherwise("WRONG").alias("matches"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT (a OR b OR c OR d) THEN 'disjoint' WHEN a AND b THEN 'forward' WHEN c AND d THEN 'reverse' WHEN a OR b THEN 'partial' ELSE 'fragment' END AS alignment
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4 = 1 AS a, l_suppkey % 4 = 2 AS b, l_partkey % 4 = 2 AS c, l_suppkey % 4 = 1 AS d FROM lineitem)""")
def endpoint_alignment(spark, sf_dir):
    token = lambda n: F.array(F.concat(F.lit("place"), n))
    label = filters.alignment(token(F.col("l_partkey") % 4), token(F.col("l_suppkey") % 4), token(F.lit(1)), token(F.lit(2)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("alignment"))


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS parts, count(*) FILTER (l_quantity > 45) AS branches, bool_or(l_linenumber = 1) AS o, bool_or(l_linenumber = 5) AS d FROM lineitem GROUP BY l_orderkey),
c AS (SELECT *, CASE WHEN branches > 0 OR parts > 1 THEN 'PARTIAL' WHEN l_orderkey % 3 > 0 OR (o AND d) THEN 'COMPLETE' ELSE 'PARTIAL' END AS completeness FROM g)
SELECT l_orderkey, completeness, CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 = 1 THEN 'ERROR' WHEN l_orderkey % 10 = 2 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'FULL_ROUTE' WHEN l_orderkey % 7 = 0 THEN 'PARTIAL' ELSE 'NO_ROUTE' END WHEN completeness = 'COMPLETE' THEN 'FULL_ROUTE' ELSE 'PARTIAL' END AS status FROM c""")
def route_completeness(spark, sf_dir):
    """Completeness of each order's components, and the status of the result."""
    k = F.col("l_orderkey")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("parts"), F.count_if(F.col("l_quantity") > 45).alias("branches"), F.bool_or(F.col("l_linenumber") == 1).alias("o"), F.bool_or(F.col("l_linenumber") == 5).alias("d"))
    g = g.withColumn("completeness", filters.completeness(F.col("parts"), F.col("branches"), k % 3 == 0, F.col("o"), F.col("d")))
    status = filters.result_status(k % 10 != 0, k % 10 == 1, F.when(k % 10 != 2, F.col("completeness")), k % 4 == 0, k % 7 == 0)
    return g.select("l_orderkey", "completeness", status.alias("status"))


_WORDS = r"regexp_extract_all(lower({c}), '[a-z][a-z'']{{2,}}')"
_ASK, _SUBJECT = ("thing", "inen", "hand"), ("Thing", "The")


@query(rf"""WITH s AS (SELECT doc_id, i, s[i] AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\z)') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
w AS (SELECT doc_id, i, sentence, coalesce(lag(sentence) OVER p, '') || ' ' || coalesce(lead(sentence) OVER p, '') AS near FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, {_WORDS.format(c='sentence')} AS own, {_WORDS.format(c='near')} AS near, regexp_extract_all(sentence, '[A-Z][a-z]+') AS subjects, regexp_matches(sentence, '(?:^|[^A-Za-z])the(?:$|[^A-Za-z])') AS goes FROM w)
SELECT doc_id, CASE WHEN len(subjects) > 0 AND NOT list_has_any(subjects, ['Thing', 'The']) THEN 'OTHER_CAMPAIGN' WHEN list_has_any(subjects, ['Thing', 'The']) THEN 'DIRECT_SUBJECT' WHEN list_has_any(own, ['thing', 'inen', 'hand']) THEN 'DIRECT_CAMPAIGN'
  WHEN list_has_any(near, ['thing', 'inen', 'hand']) AND goes THEN 'DIRECT_SUBJECT' WHEN list_has_any(near, ['thing', 'inen', 'hand']) THEN 'DIRECT_EVENT' ELSE 'UNKNOWN' END AS relevance, count(*) AS n FROM t GROUP BY ALL""")
def relevance_labels(spark, sf_dir):
    """Each sentence's relation to a query, with the sentences beside it as its window; windows stay in the document's array."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z']{2,}"), 0)
    found = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^.!?\n]+(?:[.!?]+|\z)"), 0).alias("s"))
    near = lambda i: F.concat(F.coalesce(F.get("s", i - 1), F.lit("")), F.lit(" "), F.coalesce(F.get("s", i + 1), F.lit("")))
    rows = found.select("doc_id", F.explode(F.transform("s", lambda x, i: F.struct(x.alias("sentence"), near(i).alias("near")))).alias("x")).select("doc_id", "x.*")
    asked, subject = (F.array(*map(F.lit, x)) for x in (_ASK, _SUBJECT))
    label = filters.relevance(words(F.col("sentence")), F.regexp_extract_all("sentence", F.lit("[A-Z][a-z]+"), 0), asked, subject, words(F.col("near")), F.col("sentence").rlike("(?:^|[^A-Za-z])the(?:$|[^A-Za-z])"))
    return rows.groupBy("doc_id", label.alias("relevance")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT o_custkey, o_orderkey AS id, o_orderstatus AS work, o_orderpriority AS locator, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3),
c AS (SELECT o_custkey, o_orderkey AS id, o_orderkey % 5 = 0 AS wrong FROM orders)
SELECT c.o_custkey, c.id, CASE WHEN e.id IS NULL THEN 'UNKNOWN_CITATION' WHEN wrong THEN 'MISMATCHED_CITATION' ELSE 'OK' END AS verdict FROM c LEFT JOIN e ON c.o_custkey = e.o_custkey AND c.id = e.id""")
def citation_validation(spark, sf_dir):
    """Cited orders against the first three that a customer's answer shows; white space and case don't matter."""
    orders = table(spark, sf_dir, "orders")
    evidence = orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("work"), F.col("o_orderpriority").alias("locator"), "o_totalprice")
    claims = orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.lower("o_orderstatus")).alias("work"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  ")).alias("locator"))
    return filters.cited(claims, evidence, "o_custkey", [F.desc("o_totalprice"), "id"], ["work", "locator"], 3).select("o_custkey", "id", "verdict")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra""")
def journal_consistency(spark, sf_dir):
    """Ids of the documents against those of the labels."""
    return filters.consistent(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))
