"""All registered queries of the engine over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.functions import geo, text
from lodeline.operators import chunks, extraction, ordering, retrieval, spatial
from lodeline.plans import facts, predicates, registry, relations  # noqa: F401
from lodeline.plans.registry import Query, query, table
from lodeline.sources import readers
from lodeline.streaming import ingest

# Retrieval

#: (query, term, weight): core terms weigh 1, generic ones a quarter.
TERMS = [(1, "thing", 1.0), (1, "the", 0.25), (1, "hand", 1.0), (2, "inen", 1.0), (2, "of", 0.25), (2, "eration", 1.0), (3, "worthless", 1.0), (3, "that", 0.25), (3, "clown", 1.0), (4, "de", 0.25), (4, "der", 1.0), (4, "den", 1.0)]
_TERMS = "(VALUES " + ", ".join(f"({q}, '{t}', CAST({w} AS DOUBLE))" for q, t, w in TERMS) + ") AS t(query_id, term, weight)"
_PASSAGES = r"""
sentences AS (
  SELECT doc_id, i - 1 AS idx, s[i] AS sentence
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\z)') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)
  WHERE trim(s[i]) <> ''
), pairs AS (
  SELECT *, lag(sentence) OVER (PARTITION BY doc_id ORDER BY idx) || sentence AS both_text FROM sentences
), passages AS (
  SELECT doc_id, idx, CASE WHEN length(both_text) <= 1200 THEN both_text ELSE sentence END AS text FROM pairs
)"""
_LEXICAL = f"""
{_PASSAGES}, postings AS (
  SELECT DISTINCT doc_id, idx, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM passages
), terms AS (SELECT * FROM {_TERMS}), df AS (
  SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM terms) GROUP BY term
), idf AS (
  SELECT term, ln(1 + ((SELECT count(*) FROM passages) + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df
), scores AS (
  SELECT query_id, doc_id, idx, round(sum(weight * idf), 6) AS score
  FROM postings JOIN terms USING (term) JOIN idf USING (term) GROUP BY ALL
)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame(TERMS, "query_id int, term string, weight double")
    return retrieval.lexical_scores(retrieval.passages(table(spark, sf_dir, "documents")), terms)


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, CAST(idx AS INT) AS idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, idx) AS rank FROM scores) WHERE rank <= 30")
def lexical_search(spark, sf_dir):
    """Passage windows, inverted index, IDF, weighted scores, top 30 per query."""
    return retrieval.top_k(_scores(spark, sf_dir), "query_id", [F.desc("score"), "doc_id", "idx"], 30)


@query(f"WITH {_LEXICAL} SELECT source, count(*) AS passages, count(DISTINCT doc_id) AS documents, CAST(max(length(text)) AS BIGINT) AS longest FROM passages JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source")
def passage_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = retrieval.passages(docs).join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("doc_id").alias("documents"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""WITH {_LEXICAL}, pool AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, idx) AS n FROM scores) WHERE n <= 100
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY query_id) AS c, median(score) OVER (PARTITION BY query_id) AS m FROM pool
) SELECT query_id, doc_id, CAST(idx AS INT) AS idx, score, rank, round(0.6::DOUBLE * score / (score + m) + 0.4::DOUBLE * ((c - rank + 1) / c), 6) AS strength FROM ranked""")
def pool_ranking(spark, sf_dir):
    """Competition ranks, pool median and percentile of the first 100."""
    pool = retrieval.top_k(_scores(spark, sf_dir), "query_id", [F.desc("score"), "doc_id", "idx"], 100, "n").drop("n")
    return retrieval.pool_lexical(pool)


@query(f"""WITH {_LEXICAL}, best AS (
  SELECT query_id, doc_id, max(score) AS score FROM scores GROUP BY ALL
), ranked AS (
  SELECT query_id, best.doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best.doc_id) AS rank FROM best JOIN documents ON best.doc_id = documents.doc_id
), passes AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 THEN 1 ELSE 2 END AS pass FROM ranked WHERE rank <= 60
) SELECT query_id, doc_id, source, rank, pass, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS place FROM passes""")
def source_diversity(spark, sf_dir):
    best = _scores(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    found = best.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    ranked = retrieval.top_k(found, "query_id", [F.desc("score"), "doc_id"], 60).select("query_id", "doc_id", "source", "rank")
    return retrieval.diversify(ranked, "source")


@query(f"""WITH {_LEXICAL}, best AS (
  SELECT query_id, doc_id, max(score) AS score FROM scores GROUP BY ALL
), lexical AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS lexical_rank FROM best QUALIFY lexical_rank <= 50
), counts AS (
  SELECT doc_id, ('0x' || right(sha256(term), 2))::INT AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL
), norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY doc_id
), wanted AS (SELECT query_id, ('0x' || right(sha256(term), 2))::INT AS bucket, count(*) AS q FROM {_TERMS} GROUP BY ALL
), semantic AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS vector_rank
  FROM (SELECT query_id, counts.doc_id, round(sum(n * q) / any_value(norm), 6) AS s FROM counts JOIN wanted USING (bucket) JOIN norms ON counts.doc_id = norms.doc_id GROUP BY ALL) QUALIFY vector_rank <= 60
) SELECT query_id, doc_id, coalesce(vector_rank, -1) AS vector_rank, coalesce(lexical_rank, -1) AS lexical_rank, row_number() OVER (PARTITION BY query_id ORDER BY vector_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, doc_id) AS merged_rank
FROM semantic FULL JOIN lexical USING (query_id, doc_id)""")
def hybrid_search(spark, sf_dir):
    """Hashed bag-of-words similarity and lexical scores, merged by a full outer join."""
    docs = table(spark, sf_dir, "documents")
    terms = spark.createDataFrame(TERMS, "query_id int, term string, weight double")
    best = _scores(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    lexical = retrieval.top_k(best, "query_id", [F.desc("score"), "doc_id"], 50, "lexical_rank").drop("score")
    words = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    counted = words.groupBy("doc_id", text.token_bucket(F.col("term")).alias("bucket")).agg(F.sum("n").alias("n"))
    wanted = terms.groupBy("query_id", text.token_bucket(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("q"))
    per_doc = counted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("v"))
    scored = per_doc.select("doc_id", "norm", F.explode("v").alias("bucket", "n")).join(retrieval.few(wanted), "bucket")
    semantic = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("n") * F.col("q")) / F.first("norm"), 6).alias("s"))
    near = retrieval.top_k(semantic, "query_id", [F.desc("s"), "doc_id"], 60, "vector_rank").drop("s")
    return retrieval.merge_channels(near, lexical, ["query_id", "doc_id"]).fillna(-1, ["vector_rank", "lexical_rank"])


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), d AS (
  SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance
  FROM q, embeddings WHERE vec_id <> query_id
) SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 10""")
def vector_search(spark, sf_dir):
    """Exact squared-L2 top 10 of the stated query set, every id divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(vectors, vectors.where("vec_id % 20 = 0"), 10)


@query()
def vector_index_search(spark, sf_dir):
    """The same neighbours through an index of cells; tests measure its recall against the exact search."""
    vectors = table(spark, sf_dir, "embeddings")
    index, centres = retrieval.index_vectors(vectors)
    return retrieval.probe_index(index, centres, vectors.where("vec_id % 20 = 0"), 10)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q, label AS want FROM embeddings WHERE vec_id % 20 = 0), d AS (
  SELECT query_id, want, vec_id, label, round(list_sum(list_transform(list_zip(q, embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance
  FROM q, embeddings WHERE vec_id <> query_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 10
), f AS (SELECT query_id, want, min(CASE WHEN label = want THEN rank END) AS first_hit FROM r GROUP BY ALL
) SELECT coalesce(want, -1) AS label, k, count(*) AS queries, round(avg(CASE WHEN first_hit <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN first_hit <= k THEN 1.0::DOUBLE / first_hit ELSE 0 END), 6) AS mrr
FROM f, (VALUES (1), (3), (5), (10)) AS v(k) GROUP BY GROUPING SETS ((k), (want, k))""")
def retrieval_metrics(spark, sf_dir):
    """hit@k and MRR by label and overall."""
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.vector_top_k(vectors, vectors.where("vec_id % 20 = 0"), 10)
    want = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    judged = found.join(vectors.select("vec_id", "label"), "vec_id").join(want, "query_id")
    first = judged.groupBy("query_id", "want").agg(F.min(F.when(F.col("label") == F.col("want"), F.col("rank"))).alias("first_hit"))
    each = first.withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))))
    hit = F.col("first_hit") <= F.col("k")
    return each.groupingSets([["k"], ["want", "k"]], "want", "k").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.when(hit, 1.0 / F.col("first_hit")).otherwise(0.0)), 6).alias("mrr")).select(F.coalesce("want", F.lit(-1)).alias("label"), "k", "queries", "hit_rate", "mrr")


@query()
def span_selection(spark, sf_dir):
    """Greedy non-overlap selection of each query's first 200 passages."""
    top = retrieval.top_k(_scores(spark, sf_dir), "query_id", [F.desc("score"), "doc_id", "idx"], 200)
    return retrieval.select_spans(top.select("query_id", F.col("doc_id").alias("source"), F.greatest(F.lit(0), F.col("idx") - 1).alias("start"), (F.col("idx") + 1).alias("stop"), "score", "rank"), 20)


# Text, chunks and audits


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '([A-Za-z])-[ ]*\n[ ]*([A-Za-z])', '\1\2', 'g'), '[ \t\r\n\f]+', ' ', 'g'))) AS cleaned,
  CASE WHEN length(trim(text)) < 40 THEN 'empty' WHEN length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]', '', 'g')) > 0.03 * length(text) THEN 'poor' ELSE 'good' END AS quality,
  CASE WHEN starts_with(text, 'passage: ') THEN text ELSE 'passage: ' || text END[:20] AS prefixed FROM documents""")
def text_cleanup(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean(t)).alias("cleaned"), text.quality(t).alias("quality"), F.substring(text.with_prefix(t, "passage: "), 1, 20).alias("prefixed"))


@query("""SELECT doc_id, md5(CASE WHEN starts_with(text, 'passage: ') THEN text ELSE 'passage: ' || text END) AS prefixed FROM documents""")
def prefixed_texts(spark, sf_dir):
    """The whole prefixed text's digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.with_prefix(F.col("text"), "passage: ")).alias("prefixed"))


@query(r"""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 3400)) AS start FROM documents WHERE length(text) > 0), c AS (
  SELECT doc_id, start, least(length(text), start + 4000) AS stop, regexp_replace(text[start + 1:start + 4000], '^\s+|\s+$', '', 'g') AS t FROM s
) SELECT doc_id, start, stop AS "end", t AS text, sha256(doc_id || ':' || start || ':' || t)[:24] AS chunk_id FROM c WHERE t <> ''""")
def fixed_chunks(spark, sf_dir):
    return chunks.chunks(table(spark, sf_dir, "documents"))


@query(r"""WITH s AS (SELECT source, doc_id, text, unnest(range(0, length(text), 300)) AS start FROM documents WHERE length(text) > 0), c AS (
  SELECT source, doc_id, start, least(length(text), start + 400) AS stop, regexp_replace(text[start + 1:start + 400], '^\s+|\s+$', '', 'g') AS t FROM s
), n AS (SELECT source, length(t) AS n, sha256(doc_id || ':' || start || ':' || t)[:24] AS id FROM c WHERE t <> '')
SELECT source, count(*) AS chunks, min(n) AS shortest, list_sort(list(n))[round_even((count(*) - 1) * 0.5, 0)::INT + 1] AS middle, list_sort(list(n))[round_even((count(*) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS p95, max(n) AS longest,
  CAST(sum(CASE WHEN n > 4000 THEN 1 ELSE 0 END) AS BIGINT) AS oversized, count(*) - count(DISTINCT id) AS duplicate_ids FROM n GROUP BY source""")
def chunk_profile(spark, sf_dir):
    """Nearest-rank percentiles of chunk lengths by source."""
    docs = table(spark, sf_dir, "documents")
    parts = chunks.chunks(docs, 400, 100).join(docs.select("doc_id", "source"), "doc_id")
    return chunks.profile(parts, "source")


@query("""SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, round(avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0::DOUBLE ELSE 0 END), 4) AS with_digits,
  round(avg(CASE WHEN regexp_matches(text, '^[a-z]') THEN 1.0::DOUBLE ELSE 0 END), 4) AS lower_start, round(avg(CASE WHEN regexp_matches(text, '[^.!?]$') THEN 1.0::DOUBLE ELSE 0 END), 4) AS open_end,
  count(*) - count(DISTINCT text) AS exact_copies, round(quantile_cont(n_chars, 0.95), 4) AS p95_chars, round(median(n_chars), 4) AS median_chars FROM documents GROUP BY lang""")
def corpus_audit(spark, sf_dir):
    """Copies by two hashes of each text; percentiles from counts per length, so that no group's rows meet in one task."""
    docs = table(spark, sf_dir, "documents")
    share = lambda p: F.round(F.avg(F.when(F.col("text").rlike(p), 1.0).otherwise(0.0)), 4)
    main = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), share("[0-9]").alias("with_digits"), share("^[a-z]").alias("lower_start"), share(r"[^.!?]\z").alias("open_end"))
    texts = docs.where("text is not null").select("lang", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")).groupBy("lang", "h", "c").agg(F.count(F.lit(1)).alias("n"))
    copies = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("distinct"))
    lengths = docs.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.round(F.percentile("n_chars", 0.95, F.col("n")), 4).alias("p95_chars"), F.round(F.percentile("n_chars", 0.5, F.col("n")), 4).alias("median_chars"))
    return main.join(copies, "lang").join(lengths, "lang").withColumn("exact_copies", F.col("documents") - F.col("distinct")).drop("distinct")


@query("""SELECT source, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id)
GROUP BY GROUPING SETS ((), (source), (lang), (quality, toxic))""")
def label_histograms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.groupingSets([[], ["source"], ["lang"], ["quality", "toxic"]], "source", "lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).fillna(-1, ["quality", "toxic"])


@query("""WITH g AS (SELECT item_id, i, w[i:i + 7] AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[^ \\t\\n]+') AS w FROM benchmark), unnest(range(1, len(w) - 6)) AS u(i)),
d AS (SELECT DISTINCT doc_id, w[i:i + 7] AS gram FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n]+') AS w FROM documents), unnest(range(1, len(w) - 6)) AS u(i))
SELECT item_id, doc_id, count(*) AS shared FROM (SELECT DISTINCT item_id, gram FROM g) JOIN d USING (gram) GROUP BY ALL""".replace("\\\\", "\\"))
def passage_overlap(spark, sf_dir):
    """Shared 8-word windows of benchmark items and documents, by two 64-bit hashes of each window; the items' are broadcast only if few."""
    def grams(df, key):
        words = df.select(key, F.explode(F.array(F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t\n]+"), 0))).alias("w")).where(F.size("w") >= 8)
        windows = F.arrays_zip(*[F.slice("w", k + 1, F.size("w") - 7).alias(f"w{k}") for k in range(8)])  # a slice in a lambda would copy the array each time
        hashed = F.transform(windows, lambda z: F.struct(F.xxhash64(*[z[f"w{k}"] for k in range(8)]).alias("h"), F.hash(*[z[f"w{k}"] for k in range(8)]).alias("c")))
        return words.select(key, F.explode(hashed).alias("g")).select(key, "g.h", "g.c")

    items = grams(table(spark, sf_dir, "benchmark"), "item_id").distinct()
    hits = grams(table(spark, sf_dir, "documents"), "doc_id").join(retrieval.few(items), ["h", "c"]).distinct()
    return hits.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))


@query()
def html_block_counts(spark, sf_dir):
    """Blocks of raw pages by kind."""
    return readers.html_blocks(table(spark, sf_dir, "pages")).groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("page_id").alias("pages"))


@query("""SELECT key, count(*) AS n, sum(CASE WHEN value IS NULL OR value = '' THEN 1 ELSE 0 END)::BIGINT AS missing, count(DISTINCT value) AS kinds
FROM (SELECT unnest([{'key': 'event_type', 'value': event_type}, {'key': 'props', 'value': props}, {'key': 'user_id', 'value': user_id::VARCHAR}], recursive := true) FROM events) GROUP BY key""")
def schema_profile(spark, sf_dir):
    pair = lambda k: F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(*map(pair, ("event_type", "props", "user_id")))).alias("p")).select("p.*")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value").isNull() | (F.col("value") == ""), 1).otherwise(0)).alias("missing"), F.count_distinct("value").alias("kinds"))


# Joins, resolution and windows


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("""WITH names AS (SELECT lower(trim(c_mktsegment)) AS name, c_nationkey AS place FROM customer UNION ALL SELECT lower(s_name), s_nationkey FROM supplier),
wanted AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS name FROM customer UNION SELECT lower(s_name) FROM supplier UNION SELECT 'nowhere')
SELECT name, CASE WHEN count(DISTINCT place) = 0 THEN 'NOT_FOUND' WHEN count(DISTINCT place) = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, count(DISTINCT place) AS places
FROM wanted LEFT JOIN names USING (name) GROUP BY name""")
def place_resolution(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    names = c.select(text.name_key(F.col("c_mktsegment")).alias("name"), F.col("c_nationkey").alias("place")).unionAll(s.select(text.name_key(F.col("s_name")), "s_nationkey")).distinct()
    wanted = names.select("name").distinct().unionAll(spark.range(1).select(F.lit("nowhere")))
    n = F.count_distinct("place")
    return wanted.join(names, "name", "left").groupBy("name").agg(F.when(n == 0, "NOT_FOUND").when(n == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("status"), n.alias("places"))


@query("""SELECT c_custkey, coalesce(n_name, s_name, 'UNKNOWN') AS found, CASE WHEN n_name IS NOT NULL THEN 'curated' WHEN s_name IS NOT NULL THEN 'gazetteer' ELSE 'none' END AS origin
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) n ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey""")
def precedence_lookup(spark, sf_dir):
    """A curated name first, then the gazetteer's, else UNKNOWN."""
    curated = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("k"), "n_name")
    gazetteer = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("s_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")).join(curated, "k", "left").join(gazetteer, "k", "left")
    return rows.select("c_custkey", F.coalesce("n_name", "s_name", F.lit("UNKNOWN")).alias("found"), F.when(F.col("n_name").isNotNull(), "curated").when(F.col("s_name").isNotNull(), "gazetteer").otherwise("none").alias("origin"))


@query("""SELECT 'lineitem_without_order' AS fault, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'duplicate_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def referential_integrity(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    anti = lambda name, a, x, b, y: t(a).join(t(b).select(F.col(y).alias(x)), x, "left_anti").agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n"))
    out = anti("lineitem_without_order", "lineitem", "l_orderkey", "orders", "o_orderkey").unionAll(anti("order_without_customer", "orders", "o_custkey", "customer", "c_custkey")).unionAll(anti("label_without_document", "labels", "doc_id", "documents", "doc_id"))
    return out.unionAll(t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("duplicate_line").alias("fault"), F.count(F.lit(1)).alias("n")))


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS b FROM events)
SELECT x.event_id AS earlier, y.event_id AS later, least(x.b, y.b) - greatest(x.a, y.a) AS overlap_us FROM s x JOIN s y ON x.user_id = y.user_id AND (x.a < y.a OR x.a = y.a AND x.event_id < y.event_id) AND greatest(x.a, y.a) < least(x.b, y.b)""")
def interval_overlap(spark, sf_dir):
    """Half-open intervals of one user that overlap. The join is on user and day; a pair that shares several days is met in the first of them."""
    day = 86_400_000_000
    s = table(spark, sf_dir, "events").select("user_id", "event_id", _micros().alias("a"), (_micros() + F.floor("value") * 60_000_000).alias("b"))
    s = s.withColumn("from_day", F.floor(F.col("a") / day)).withColumn("day", F.explode(F.sequence("from_day", F.greatest("from_day", F.floor((F.col("b") - 1) / day)))))
    x, y = s.alias("x"), s.alias("y")
    first = (F.col("x.a") < F.col("y.a")) | ((F.col("x.a") == F.col("y.a")) & (F.col("x.event_id") < F.col("y.event_id")))
    a, b = F.greatest("x.a", "y.a"), F.least("x.b", "y.b")
    once = F.col("x.day") == F.greatest("x.from_day", "y.from_day")
    met = x.join(y, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.day") == F.col("y.day")) & once & first & (a < b))
    return met.select(F.col("x.event_id").alias("earlier"), F.col("y.event_id").alias("later"), (b - a).alias("overlap_us"))


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS anchor_id FROM events""")
def last_known_anchor(spark, sf_dir):
    """As-of join by position: the last purchase of the user before each event, -1 if none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w), F.lit(-1).cast("long")).alias("anchor_id"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 * 6 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(event_id) AS first_event, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM i GROUP BY ALL""")
def event_islands(spark, sf_dir):
    """Gaps and islands: runs of a user's events without a gap of six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.when(_micros() - F.lag(_micros()).over(w) > 6 * 3_600_000_000, 1).otherwise(0)
    rows = table(spark, sf_dir, "events").withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ">")
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), path.alias("path"))


@query("""WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS b, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS c FROM events GROUP BY 1)
SELECT CASE WHEN a = 0 THEN 'view' WHEN b = 0 THEN 'click' WHEN c = 0 THEN 'purchase' ELSE 'none' END AS first_failing, a + CASE WHEN a = 1 THEN b ELSE 0 END + CASE WHEN a = 1 AND b = 1 THEN c ELSE 0 END AS deepest, count(*) AS users FROM s GROUP BY ALL""")
def stage_funnel(spark, sf_dir):
    has = lambda k: F.max(F.when(F.col("event_type") == k, 1).otherwise(0))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(has("view").alias("a"), has("click").alias("b"), has("purchase").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return s.groupBy(F.when(a == 0, "view").when(b == 0, "click").when(c == 0, "purchase").otherwise("none").alias("first_failing"), (a + a * b + a * b * c).alias("deepest")).agg(F.count(F.lit(1)).alias("users"))


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(0.5 * o_totalprice + 100 * (o_custkey % 7), 6), o_totalprice, o_orderkey) AS rank FROM orders QUALIFY rank <= 20""")
def weighted_ranking(spark, sf_dir):
    cost = F.round(0.5 * F.col("o_totalprice") + 100 * (F.col("o_custkey") % 7), 6)
    return retrieval.top_k(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", cost.alias("c")), "o_orderpriority", ["c", "o_totalprice", "o_orderkey"], 20).drop("c")


@query("""WITH p AS (SELECT l_partkey AS k, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem), a AS (SELECT k, l_suppkey, sum(q) AS q FROM p GROUP BY ALL)
SELECT k AS partkey, count(*) AS suppliers, round(max(q) / sum(q), 6) AS concentration, arg_max(l_suppkey, (q, -l_suppkey)) AS leading FROM a GROUP BY k""")
def concentration(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("partkey"), "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return a.groupBy("partkey").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.max("q") / F.sum("q"), 6).alias("concentration"), F.max_by("l_suppkey", F.struct("q", -F.col("l_suppkey"))).alias("leading"))


# Ordering graphs

_EDGES = "SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, CAST(l_linenumber % 3 AS INT) AS priority FROM lineitem"
_STEPS = "SELECT user_id, src, dst FROM (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), (F.col("l_linenumber") % 3).alias("priority"))


@query(f"SELECT src, dst, min(priority) AS priority, count(*) AS n FROM ({_EDGES}) GROUP BY ALL")
def best_edges(spark, sf_dir):
    return ordering.best_edges(_edges(spark, sf_dir))


@query(f"""WITH s AS ({_STEPS}), e AS (SELECT user_id || ':' || src AS src, user_id || ':' || dst AS dst, min(length(src)) AS priority FROM s GROUP BY ALL)
SELECT e.src, e.dst, CAST(e.priority AS INT) AS priority FROM e LEFT JOIN e r ON e.src = r.dst AND e.dst = r.src WHERE r.src IS NULL OR e.priority < r.priority""")
def reverse_conflicts(spark, sf_dir):
    """Of opposite edges the better one stays, none if equal."""
    steps = ordering.consecutive(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_type")
    node = lambda c: F.concat_ws(":", "user_id", c)
    edges = steps.select(node("src").alias("a"), node("dst").alias("b"), F.length("src").alias("p")).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("p").alias("priority"))
    return ordering.drop_reversed(edges)


@query(f"SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ({_EDGES}) UNION ALL SELECT dst, 0, 1 FROM ({_EDGES})) GROUP BY node")
def edge_degrees(spark, sf_dir):
    return ordering.degrees(_edges(spark, sf_dir))


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM ({_EDGES})) SELECT e.src, e.dst FROM e JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) a ON e.src = a.src JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) b ON e.dst = b.dst WHERE o > 1 OR i > 1""")
def branch_edges(spark, sf_dir):
    return ordering.branch_edges(_edges(spark, sf_dir).select("src", "dst").distinct())


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey * -1 AS b FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, c) AS (SELECT a, a FROM b UNION SELECT b.b, c FROM r JOIN b ON r.n = b.a)
SELECT n AS node, min(c) AS component FROM r GROUP BY n""")
def weak_components(spark, sf_dir):
    """Customers and their urgent orders."""
    edges = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey")).alias("dst"))
    return ordering.weak_components(edges)


@query()
def weak_components_all_orders(spark, sf_dir):
    """Customers and all their orders; tests hold it against union-find."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey")).alias("dst"))
    return ordering.weak_components(edges)


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT n.event_id AS node, f.event_id AS head, r - 1 AS position FROM n JOIN (SELECT user_id, event_id FROM n WHERE r = 1) f USING (user_id) WHERE user_id IN (SELECT user_id FROM n GROUP BY 1 HAVING count(*) > 1)""")
def linear_chains(spark, sf_dir):
    """Each user's events as a maximal chain, by pointer doubling."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("o", F.col("event_id"))
    return ordering.linear_chains(ordering.consecutive(rows, "user_id", ["ts", "o"], "event_id").select("src", "dst"))


@query()
def cycle_edges(spark, sf_dir):
    """Steps between event types that lie on or between cycles."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return ordering.trim_to_cycles(ordering.consecutive(rows, "user_id", ["ts", "event_id"], "event_type").select("src", "dst"))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS a, 100000 + l_partkey % 97 AS b, min(CAST(l_quantity AS BIGINT)) AS c FROM lineitem GROUP BY ALL), b AS (SELECT a, b, c FROM e UNION ALL SELECT b, a, c FROM e),
r(n, d, k) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), 0 UNION SELECT b, min(d), k + 1 FROM (SELECT b.b, d + c AS d, k FROM r JOIN b ON n = b.a WHERE k < 12) GROUP BY b, k)
SELECT CAST(1 AS BIGINT) AS source, n AS node, CAST(min(d) AS DOUBLE) AS distance FROM r GROUP BY n""")
def shortest_paths(spark, sf_dir):
    """Distances from supplier 1 over a supplier and part-class graph."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (100_000 + F.col("l_partkey") % 97).alias("dst")).agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))
    return ordering.shortest_distances(edges, spark.range(1, 2).withColumnRenamed("id", "node"))


@query()
def shortest_paths_all_parts(spark, sf_dir):
    """Distances from supplier 1 over suppliers and parts (negative), of any number of hops; tests hold it against Dijkstra's algorithm."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst")).agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))
    return ordering.shortest_distances(edges, spark.range(1, 2).withColumnRenamed("id", "node"))


# Space

_LON, _LAT = "((({k} * 37) % 3600) / 10.0 - 180)", "((({k} * 53) % 1700) / 10.0 - 85)"
_HAVERSINE = "2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _points(spark, sf_dir, name, key):
    at = lambda pattern: F.expr(pattern.format(k=key).replace("10.0", "10.0D"))  # noqa: E731  # the SQL divides doubles too, where Spark would take decimals
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), at(_LON).alias("lon"), at(_LAT).alias("lat"))


def _points_sql(name, key):
    return f"(SELECT {key} AS id, CAST({_LON.format(k=key)} AS DOUBLE) AS lon, CAST({_LAT.format(k=key)} AS DOUBLE) AS lat FROM {name})"


@query(f"SELECT a.id AS point_id, b.id AS target_id, round({_HAVERSINE}, 3) AS distance FROM {_points_sql('customer', 'c_custkey')} a, {_points_sql('supplier', 's_suppkey')} b WHERE {_HAVERSINE} <= 500000")
def radius_join(spark, sf_dir):
    found = spatial.within(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), 500_000.0)
    return found.select("point_id", "target_id", F.round("distance", 3).alias("distance"))


@query(f"SELECT point_id, target_id, round(d, 3) AS distance FROM (SELECT a.id AS point_id, b.id AS target_id, {_HAVERSINE} AS d, row_number() OVER (PARTITION BY a.id ORDER BY round({_HAVERSINE}, 6), b.id) AS n FROM {_points_sql('customer', 'c_custkey')} a, {_points_sql('supplier', 's_suppkey')} b) WHERE n = 1")
def nearest_neighbour(spark, sf_dir):
    found = spatial.nearest(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"))
    return found.select("point_id", "target_id", F.round("distance", 3).alias("distance"))


@query(f"""WITH p AS (SELECT c_nationkey AS n, id, lon, lat, row_number() OVER (PARTITION BY c_nationkey ORDER BY id) AS r FROM customer JOIN {_points_sql('customer', 'c_custkey')} ON id = c_custkey)
SELECT CAST(a.n AS BIGINT) AS route, count(*) AS legs, round(sum({_HAVERSINE}), 1) AS metres FROM p a JOIN p b ON a.n = b.n AND b.r = a.r + 1 GROUP BY 1""")
def route_lengths(spark, sf_dir):
    """Great-circle length of each nation's chain of customers."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("route")).join(_points(spark, sf_dir, "customer", "c_custkey"), "id")
    return spatial.leg_lengths(rows.withColumnRenamed("id", "pos"), "route").select("route", "legs", F.round("metres", 1).alias("metres"))


@query("""WITH RECURSIVE m AS (SELECT p_partkey, exp(-p_retailprice * 900 / 6378137.0::DOUBLE) AS t FROM part), r(p_partkey, t, phi, n) AS (SELECT p_partkey, t, pi() / 2 - 2 * atan(t), 0 FROM m
UNION ALL SELECT p_partkey, t, pi() / 2 - 2 * atan(t * pow((1 - 0.0818191908426215::DOUBLE * sin(phi)) / (1 + 0.0818191908426215::DOUBLE * sin(phi)), 0.0818191908426215::DOUBLE / 2)), n + 1 FROM r WHERE n < 8)
SELECT p_partkey, round(degrees(x / 6378137.0::DOUBLE), 6) AS lon, round(degrees(phi), 6) AS lat, CASE WHEN rise <= 0.05 THEN 0 WHEN rise <= 0.15 THEN 1.5 * d ELSE 5 * d END AS cost, round(0.32 * s * s * (3 - 2 * s), 6) AS bonus
FROM (SELECT p_partkey, p_retailprice * 1000 AS x, CAST(p_size AS DOUBLE) AS d, (p_partkey % 20)::DOUBLE / p_size AS rise, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((p_partkey % 100) / 100.0::DOUBLE - 0.75::DOUBLE) / 0.03::DOUBLE)) AS s FROM part) JOIN (SELECT p_partkey, phi FROM r WHERE n = 8) USING (p_partkey)""")
def cost_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lon, lat = geo.mercator_to_degrees(F.col("p_retailprice") * 1000, F.col("p_retailprice") * 900)
    cost = geo.slope_cost(F.col("p_size").cast("double"), (F.col("p_partkey") % 20).cast("double"))
    return p.select("p_partkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), cost.alias("cost"), F.round(geo.smoothstep_bonus((F.col("p_partkey") % 100) / 100.0), 6).alias("bonus"))


@query()
def grid_routes(spark, sf_dir):
    """A* on a 24 x 24 grid for every nation, blocked and weighted by a hash."""
    legs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("leg_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(23).alias("x1"), F.lit(23).alias("y1"))
    axis = F.explode(F.sequence(F.lit(0), F.lit(23)))
    cells = legs.select("leg_id", axis.alias("x")).withColumn("y", axis).withColumn("r", F.pmod(F.crc32(F.concat_ws(",", "leg_id", "x", "y").cast("binary")), F.lit(100)))
    corner = (F.col("x") + F.col("y")).isin(0, 46)
    return spatial.grid_paths(cells.select("leg_id", "x", "y", (1 + F.col("r") / 50).alias("multiplier"), ((F.col("r") < 25) & ~corner).alias("blocked")), legs)


# Extraction: the test tables' prose is invented, so the queries pass cue words of their own

_SENTENCES = r"SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\z)')) AS sentence FROM documents"
_SEA, _LAND, _UNASSERTED = "hand|thing", "clown|worthless|inen", "the|of"
_TOLD = (("PREVENTED", r"(?:hand|thing)\b"), ("PLANNED", r"(?:of|the)\s+[a-z]+er\b"), ("NEGATED", r"(?:inen|eration)\b"))


def _sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


# In the SQL, whose word characters are ASCII alone, letters beyond ASCII become "_".
_PLAIN = rf"SELECT doc_id, regexp_replace(sentence, '[^\P{{L}}A-Za-z]', '_', 'g') AS sentence FROM ({_SENTENCES})"


@query(rf"""WITH s AS ({_PLAIN}), a AS (SELECT doc_id, regexp_replace(sentence, '(?i)\b(?:{_UNASSERTED})\s+(?:{_SEA}|{_LAND})\b', ' ', 'g') AS t FROM s),
f AS (SELECT doc_id, regexp_matches(t, '(?i)\b(?:{_SEA})\b') AS wet, regexp_matches(t, '(?i)\b(?:{_LAND})\b') AS dry FROM a)
SELECT doc_id, CASE WHEN wet AND NOT dry THEN 'SEA' WHEN dry AND NOT wet THEN 'LAND' ELSE 'UNKNOWN' END AS mode, count(*) AS n FROM f GROUP BY ALL""")
def travel_modes(spark, sf_dir):
    mode = extraction.travel_mode(F.col("sentence"), _SEA, _LAND, _UNASSERTED)
    return _sentences(spark, sf_dir).groupBy("doc_id", mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH s AS ({_PLAIN}), f AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(sentence, '(?i){chr(92)}b{p}') THEN '{n}'" for n, p in _TOLD)} END AS outcome
FROM s WHERE regexp_matches(sentence, '(?i)\b(?:[a-z]+ing|der)\b') AND NOT regexp_matches(sentence, '(?i)\b(?:clown)\b'))
SELECT doc_id, outcome, count(*) AS n FROM f WHERE outcome IS NOT NULL GROUP BY ALL""")
def movement_outcomes(spark, sf_dir):
    told = extraction.outcome(F.col("sentence"), "[a-z]+ing|der", "clown", _TOLD)
    return _sentences(spark, sf_dir).select("doc_id", told.alias("outcome")).where("outcome is not null").groupBy("doc_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


_NAMED = r"(?:^|[^A-Za-z])({prepositions})\s+([A-Za-z]+)"
_CUES, _CUE_ROLES = "the|of|de|der", {"the": "ORIGIN", "of": "DESTINATION"}
_MENTIONS = f"""SELECT doc_id, i - 1 AS ordinal, p[i] AS place, CASE lower(w[i]) WHEN 'the' THEN 'ORIGIN' WHEN 'of' THEN 'DESTINATION' ELSE 'RELATED_PLACE' END AS role
FROM (SELECT doc_id, regexp_extract_all(text, '{_NAMED.format(prepositions=_CUES)}', 1) AS w, regexp_extract_all(text, '{_NAMED.format(prepositions=_CUES)}', 2) AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i)"""


@query(f"SELECT doc_id, place, CAST(min(ordinal) AS INTEGER) AS first, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM ({_MENTIONS}) GROUP BY doc_id, place")
def place_inventory(spark, sf_dir):
    found = extraction.place_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", _CUES, _CUE_ROLES, _NAMED)
    return extraction.mention_inventory(found, "doc_id")


@query("""WITH d AS (SELECT conv_id, turn, text, nullif(regexp_extract(text, '[A-Za-z]+', 0), '') AS destination FROM conversations),
o AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z])(?:of|that|der)(?:$|[^A-Za-z])') THEN lag(destination) OVER (PARTITION BY conv_id ORDER BY turn) END AS origin FROM d)
SELECT conv_id, turn, origin FROM o WHERE origin IS NOT NULL""")
def turn_continuation(spark, sf_dir):
    """After a cue the first word of the turn before is carried on."""
    named = table(spark, sf_dir, "conversations").withColumn("destination", F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")))
    return extraction.continuation(named, "conv_id", "turn", "destination", F.col("text").rlike("(?:^|[^A-Za-z])(?:of|that|der)(?:$|[^A-Za-z])")).where("origin is not null").select("conv_id", "turn", "origin")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS p, count(DISTINCT l_linestatus) AS d, count(DISTINCT l_linenumber) AS q, string_agg(CAST(l_partkey AS VARCHAR), '>' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN p > 1 THEN 'PERIOD_CONFLICT' WHEN d > 1 THEN 'DESCRIPTION_CONFLICT' WHEN q < n THEN 'SEQUENCE_CONFLICT' ELSE 'OK' END AS status, n, CASE WHEN p = 1 AND d = 1 AND q = n THEN steps END AS steps FROM g""")
def declared_orders(spark, sf_dir):
    return extraction.declared_events(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")


@query("""WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS phrase FROM conversations)
SELECT conv_id, phrase FROM w WHERE role = 'assistant' EXCEPT SELECT conv_id, phrase FROM w WHERE role <> 'assistant'""")
def unsupported_phrases(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("phrase"))
    return extraction.unsupported(words.where("role = 'assistant'"), words.where("role <> 'assistant'"), ["conv_id", "phrase"])


@query(f"""WITH l AS (SELECT o_custkey AS place, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 50 + o_orderkey % 2 END AS lon, o_orderkey % 5 = 0 AS representative FROM orders),
g AS (SELECT place, count(DISTINCT lon) AS points, coalesce(bool_or(representative) FILTER (lon IS NOT NULL), false) AS any_rep FROM l GROUP BY place)
SELECT place, points, CASE WHEN points = 0 THEN 'NON_POINT_GEOMETRY' WHEN points >= 3 THEN 'MULTI_LOCATION_CONFLICT' WHEN any_rep THEN 'REPRESENTATIVE_ONLY' WHEN points >= 2 THEN 'MULTI_LOCATION_CONFLICT' ELSE 'SOURCE_POINT_UNCERTAIN' END AS authority FROM g""")
def coordinate_authority(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.when(key % 7 > 0, F.col("o_custkey") % 50 + key % 2).alias("lon"), F.lit(0).alias("lat"), (key % 5 == 0).alias("representative"))
    return extraction.authority_class(rows, "place")


_CORNERS = ((0, 0), (40, 0), (20, 30))


@query(f"""WITH c AS {_points_sql('nation', 'n_nationkey')}, e AS ({' UNION ALL '.join(f"SELECT id AS polygon_id, lon + {a} AS x1, lat + {b} AS y1, lon + {x} AS x2, lat + {y} AS y2 FROM c" for (a, b), (x, y) in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True))}),
t AS (SELECT p.id AS point_id, polygon_id, (x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) AS edge,
CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END AS crossing FROM {_points_sql('customer', 'c_custkey')} p, e)
SELECT point_id, polygon_id, CASE WHEN bool_or(edge) THEN 'boundary' ELSE 'interior' END AS relation FROM t GROUP BY ALL HAVING bool_or(edge) OR sum(crossing) % 2 = 1""")
def points_in_polygons(spark, sf_dir):
    """Customers within a triangle for each nation."""
    return spatial.point_in_polygon(_points(spark, sf_dir, "customer", "c_custkey"), _triangles(spark, sf_dir))


_TURNS = "[a-z]+ing|der|que"
_KINDS = (("CLOWN", "clown|worthless"), ("MOVEMENT", None), ("THING", "thing|hand"))
_BACK = r"\b(?:of|de)\s+(?:the|la)\b[^,;:.]*[,;:]?\s*"
_OPENED = "that|les|would"


def _moves_sql(sentence, more=""):
    return rf"len(list_filter(regexp_split_to_array({sentence}, '(?i){extraction.CLAUSES}'), lambda c: regexp_matches(regexp_replace(c, '(?i){extraction.negated(_TURNS).replace(chr(39), chr(39) * 2)}', ' ', 'g'), '(?i)\b(?:{_TURNS})\b'){more})) > 0"


# In the SQL, whose word characters are ASCII alone, letters beyond ASCII become "_".
@query(rf"""WITH s AS (SELECT doc_id, regexp_replace(sentence, '[^\P{{L}}A-Za-z]', '_', 'g') AS sentence FROM ({_SENTENCES})), m AS (SELECT doc_id, sentence, regexp_replace(sentence, '(?i){_BACK}', '', 'g') AS main FROM s)
SELECT doc_id, CASE WHEN regexp_matches(main, '(?i)\b(?:clown|worthless)\b') THEN 'CLOWN' WHEN {_moves_sql('main')} THEN 'MOVEMENT' WHEN regexp_matches(main, '(?i)\b(?:thing|hand)\b') THEN 'THING' ELSE 'UNKNOWN' END AS kind,
count(*) AS n, count(*) FILTER ({_moves_sql('sentence', rf" AND NOT regexp_matches(c, '(?i)\b(?:{_OPENED})\b.*\b(?:{_TURNS})\b')")}) AS completed FROM m GROUP BY ALL""")
def event_kinds(spark, sf_dir):
    """Sentences by kind, and how many of them assert a completed movement."""
    sentence = F.col("sentence")
    kind, done = extraction.event_kind(sentence, _KINDS, _BACK, _TURNS), extraction.moves(sentence, _TURNS, True, _OPENED)
    return _sentences(spark, sf_dir).groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("completed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IS NULL OR l_returnflag = l_linestatus OR l_partkey % 5 = 0 OR l_partkey % 7 = 0 THEN 'DENIED' WHEN l_linenumber <= 3 THEN 'ALLOWED' ELSE 'UNKNOWN' END AS eligibility FROM lineitem""")
def mode_transitions(spark, sf_dir):
    part, evidence = F.col("l_partkey"), F.when(F.col("l_linenumber") <= 3, "SUPPORTED").otherwise("NONE")
    allowed = extraction.transition(F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_linestatus"), part % 5 > 0, part % 7 > 0, evidence)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", allowed.alias("eligibility"))


def _triangles(spark, sf_dir):
    centre = _points(spark, sf_dir, "nation", "n_nationkey")
    sides = F.array(*[F.struct(*[(F.col(c) + d).alias(n) for c, d, n in (("lon", a, "x1"), ("lat", b, "y1"), ("lon", x, "x2"), ("lat", y, "y2"))]) for (a, b), (x, y) in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True)])
    return centre.select(F.col("id").alias("polygon_id"), F.explode(sides).alias("e")).select("polygon_id", "e.*")


@query(f"""WITH c AS {_points_sql('nation', 'n_nationkey')}, e AS ({' UNION ALL '.join(f"SELECT lon + {a} AS x1, lat + {b} AS y1, lon + {x} AS x2, lat + {y} AS y2 FROM c" for (a, b), (x, y) in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True))}),
s AS (SELECT id, lon AS sx1, lat AS sy1, lon + 3 AS sx2, lat + 2 AS sy2 FROM {_points_sql('customer', 'c_custkey')} p),
t AS (SELECT id, sign((x2 - x1) * (sy1 - y1) - (y2 - y1) * (sx1 - x1)) * sign((x2 - x1) * (sy2 - y1) - (y2 - y1) * (sx2 - x1)) AS a,
sign((sx2 - sx1) * (y1 - sy1) - (sy2 - sy1) * (x1 - sx1)) * sign((sx2 - sx1) * (y2 - sy1) - (sy2 - sy1) * (x2 - sx1)) AS b FROM s, e
WHERE greatest(sx1, sx2) >= least(x1, x2) AND greatest(x1, x2) >= least(sx1, sx2) AND greatest(sy1, sy2) >= least(y1, y2) AND greatest(y1, y2) >= least(sy1, sy2))
SELECT id AS segment_id, CASE WHEN bool_or(a < 0 AND b < 0) THEN 'land_intersection' ELSE 'boundary_ambiguous' END AS relation FROM t WHERE a <= 0 AND b <= 0 GROUP BY id""")
def segments_on_land(spark, sf_dir):
    """A short segment from each customer against the sides of the nations' triangles."""
    from_there = _points(spark, sf_dir, "customer", "c_custkey").select("id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + 3).alias("x2"), (F.col("lat") + 2).alias("y2"))
    return spatial.segments_by_polygon(from_there, _triangles(spark, sf_dir))


@query()
def sea_legs(spark, sf_dir):
    """A leg from each supplier past the nations' triangles, sampled every 5 km."""
    legs = _points(spark, sf_dir, "supplier", "s_suppkey").select("id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), (F.col("lon") * 0.9).alias("lon2"), (F.col("lat") * 0.8).alias("lat2"))
    return spatial.sea_legs(legs, _triangles(spark, sf_dir))


# Streams (the windows are an extension)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_windows(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Query]:
    return dict(registry.found)


def oracle_sql() -> dict[str, str]:
    return dict(registry.oracle)
