"""Dates, sentences, selection, graphs, sinks and ingestion against cases and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import dates, geo, text
from lodeline.operators import chunks, filters, ordering, relations, retrieval, routes, selection
from lodeline.plans import catalog
from lodeline.sources import sinks
from lodeline.streaming import ingest


def test_date_cases(spark):
    cases = {
        "133 BCE": ("RESOLVED", -133, -133, "YEAR"),
        "in B.C. 133 he": ("RESOLVED", -133, -133, "YEAR"),
        "公元前133年": ("RESOLVED", -133, -133, "YEAR"),
        "公元14年": ("RESOLVED", 14, 14, "YEAR"),
        "14 CE": ("RESOLVED", 14, 14, "YEAR"),
        "0 BCE": ("UNRESOLVED", None, None, "UNKNOWN"),
        "133–121 BCE": ("RESOLVED", -133, -121, "YEAR_RANGE"),
        "from 9 through 5 BC": ("RESOLVED", -9, -5, "YEAR_RANGE"),
        "30 BC to 27 BC": ("RESOLVED", -30, -27, "YEAR_RANGE"),
        "circa 133 BC": ("RESOLVED", -133, -133, "APPROXIMATE"),
        "公元前2世纪": ("CENTURY_UNRESOLVED", None, None, "UNKNOWN"),
        "Book XXVIII": ("UNRESOLVED", None, None, "UNKNOWN"),
        "500 iugera": ("UNRESOLVED", None, None, "UNKNOWN"),
        "133 BC, not 121 BC": ("CONFLICT", None, None, "UNKNOWN"),
        "133 BC and again 133 BC": ("RESOLVED", -133, -133, "YEAR"),
        "133/132 BC": ("UNRESOLVED", None, None, "UNKNOWN"),
        None: ("UNRESOLVED", None, None, "UNKNOWN"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", dates.verdict(dates.readings(F.col("t")), F.col("t")).alias("v")).collect():
        assert (r.v.status, r.v.start, r.v.end, r.v.precision) == cases[r.t], r.t
    both = df.where("t = '133 BC, not 121 BC'").select(dates.readings(F.col("t")).alias("r")).first().r
    assert {(x.start, x.end) for x in both} == {(-133, -133), (-121, -121)}


def test_sentence_boundaries_and_windows(spark):
    said = 'He left in 44 B.C. and Mr. Smith, cons. IV. of Rome, came. "Why?" He slept! End'
    parts = [said[a:b] for a, b in zip([0, *chunks.sentence_boundaries(said)], chunks.sentence_boundaries(said))]
    assert parts == ["He left in 44 B.C. and Mr. Smith, cons. IV. of Rome, came. ", '"Why?" ', "He slept! ", "End"]
    rnd = random.Random(4)
    prose = " ".join("word " * rnd.randrange(3, 60) + rnd.choice(["end.", "stop!", "so; then", "B.C. again"]) for _ in range(600))
    for size in (400, 4000):
        spans = [*chunks.sentence_windows(prose, size)]
        assert "".join(prose[a:b] for a, b, _ in spans) == prose and all(a < b for a, b, _ in spans)
        assert all(b - a <= 1.25 * size for a, b, _ in spans) and (size == 400 or all(0.65 * size <= b - a for a, b, _ in spans[:-1]))
    assert [*chunks.sentence_windows("", 10)] == [] and [*chunks.sentence_windows("x" * 25, 10)] == [(0, 10, "raw"), (10, 20, "raw"), (20, 25, "")]
    df = spark.createDataFrame([("d", "s", 0, prose), ("d", "s", 1, ""), ("e", None, 0, None)], "document_id string, spine_item string, section_index int, text string")
    found = chunks.section_chunks(df, 400).collect()
    assert all(prose[r.start : r.end] == r.text == r.text.strip() and r.document_id == "d" and r.section_index == 0 for r in found) and len({r.chunk_id for r in found}) == len(found)
    fixed = chunks.section_chunks(df, 4000, 600, False).collect()
    assert sorted(r.start for r in fixed)[1] == 3400


def test_diverse_selection_equals_a_plain_loop(spark, sf_dir):
    pool = {}
    for r in catalog.queries()["diverse_selection"](spark, sf_dir).collect():
        pool.setdefault(r.query_id, {})[r.id] = (r.reason, r.place)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice").collect()
    seen = set()
    for customer, got in pool.items():
        rows = sorted(((-round(o.o_totalprice / 1000 - 50, 3), o.o_orderkey) for o in orders if o.o_custkey == customer))
        spans, eligible, why = set(), [], {}
        for minus, k in rows:
            span = (k % 5, k % 60 * 10, k % 60 * 10 + 25)
            if span in spans:
                why[k] = "EXACT_DUPLICATE"
                continue
            spans.add(span)
            if -minus <= 0:
                why[k] = "LOW_RERANK_SCORE"
            elif any(s == span[0] and max(a, span[1]) < min(b, span[2]) for s, a, b in (x[1] for x in eligible)):
                why[k] = "OVERLAP_EVICTION"
            else:
                eligible.append((k, span))
        out = []
        for test in (lambda k: k % 6 and k % 4 and k % 9 == 0,):
            used = set()
            out += [k for k, s in eligible if test(k) and s[0] not in used and not used.add(s[0])]
        used = set()
        for test in (lambda k: k % 6 and k % 4 and k % 3 == 0, lambda k: k % 6):
            out += [k for k, s in eligible if test(k) and s[0] not in used and not used.add(s[0])]
        order = [*dict.fromkeys([*out, *(k for k, _ in eligible)])][:5]
        for k, _ in eligible:
            why[k] = "SELECTED" if k in order else "DIVERSITY_EVICTION" if k in [e[0] for e in eligible[:5]] else "TOP_K_TRUNCATION"
        assert got == {k: (v, order.index(k) + 1 if k in order else -1) for k, v in why.items()}
        seen |= set(why.values())
    assert {"SELECTED", "DIVERSITY_EVICTION", "LOW_RERANK_SCORE"} <= seen


def test_seats_and_intents_keep_their_rules(spark):
    rnd = random.Random(2)
    rows = [(1, i, rnd.randrange(6), s := rnd.randrange(300), s + 25, 1.0, i, i % 2 == 0, rnd.randrange(50), rnd.random() < 0.6) for i in range(150)]
    df = spark.createDataFrame(rows, "query_id int, id int, source int, start int, stop int, score double, rank int, lexical boolean, lexical_rank int, qualified boolean")
    seated = sorted(selection.seat(df, 30).collect(), key=lambda r: r.seat)
    reserve = [r[1] for r in sorted((r for r in rows if r[7] and r[9]), key=lambda r: (r[8], r[1]))[:10]]
    assert [r.id for r in seated[:10]] == reserve and [r.seat for r in seated] == [*range(1, len(seated) + 1)] and len(seated) <= 30
    later = seated[10:]
    assert all(not (a.source == b.source and max(a.start, b.start) < min(a.stop, b.stop)) for a in later for b in seated if a.id != b.id)
    assert len(selection.seat(df.limit(20), 30).collect()) == 20
    more = [(1, intent, i, i % 5, i * 10, i * 10 + 15, i % 7, i, i, [f for f in ("M", "E") if i % 3 == ord(f) % 3], i % 3 == 0, True, i % 2 == 0, intent == "C") for i in range(60) for intent in ("C", f"I{i % 3}")]
    merged = sorted(selection.merge_intents(spark.createDataFrame(more, "query_id int, intent string, id int, source int, start int, stop int, family int, rank int, local_rank int, facets array<string>, movement boolean, qualified boolean, canonical boolean, canonical_intent boolean"), 12).collect(), key=lambda r: r.place)
    assert len(merged) == 12 and len({r.id for r in merged}) == 12 and merged[0].reason == "intent_movement_coverage" and merged[-1].reason == "global_rank_fill"
    spans = [(r.id % 5, r.id * 10, r.id * 10 + 15) for r in merged]
    assert all(not (a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])) for a in spans for b in spans if a != b)


def test_chains_and_cycles_of_any_graph(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (12, 14), (20, 20), (30, 31), (31, 32), (32, 30), (32, 40), (40, 41), (41, 40), (41, 50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    chain = {r.node: (r.head, r.position) for r in ordering.linear_chains(df).collect()}
    assert chain[12] == (10, 2) and chain[11] == (10, 1) and chain[13] == (13, 0) and chain[1] == (1, 0) and chain[2] == (2, 0)
    assert {r.node: r.component for r in ordering.cycle_nodes(df).collect()} == {1: 1, 2: 1, 3: 1, 20: 20, 30: 30, 31: 30, 32: 30, 40: 40, 41: 40}
    assert ordering.cycle_nodes(df.where("src = 10")).count() == 0
    node = lambda n: spark.createDataFrame([(n,)], "node long")
    assert {tuple(r) for r in ordering.between(df, node(10), node(14), 3).collect()} == {(10, 11), (11, 12), (12, 14)}
    assert ordering.between(df, node(10), node(14), 2).count() == 0


def test_route_paths_are_shortest(spark, sf_dir):
    cost = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity").collect():
        for e in ((r.l_suppkey, -r.l_partkey), (-r.l_partkey, r.l_suppkey)):
            cost[e] = min(int(r.l_quantity), cost.get(e, 10**9))
    best = {int(r.node): r.distance for r in catalog.queries()["shortest_paths_all_parts"](spark, sf_dir).collect()}
    found = catalog.queries()["route_paths"](spark, sf_dir).collect()
    assert len(found) == sum(1 for n in best if n <= 0)
    for r in found:
        nodes = [int(x) for x in r.path.split(">")]
        assert nodes[0] == 1 and nodes[-1] == r.target and sum(cost[e] for e in zip(nodes, nodes[1:])) == best[r.target]


def test_vector_index_recall(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    exact, near = ({(r.query_id, r.vec_id) for r in catalog.queries()[q](spark, folder).collect()} for q in ("vector_search", "vector_index_search"))
    assert len(exact & near) >= 0.9 * len(exact)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert retrieval.index_vectors(vectors)[0].count() == vectors.count()
    empty, centres = retrieval.index_vectors(vectors.limit(0))
    assert len(centres) == 0 and empty.count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id long, text string, source_id string")
    path = str(tmp_path / "store")
    assert sinks.upsert(rows, path, "id").count() == 3
    again = sinks.upsert(spark.createDataFrame([(3, "new", "y"), (4, "d", "y")], rows.schema), path, "id")
    assert {r.id: r.text for r in again.collect()} == {1: "a", 2: "b", 3: "new", 4: "d"}
    sinks.replace_all(rows, path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_json_lines(rows, rows.limit(2), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/metadata")).first().asDict() == {"pages": 3, "chunks": 2}
    sinks.write_registry(rows.withColumn("source_locator", F.col("text")), str(tmp_path / "registry"))
    assert {(r.source_id, r.records) for r in spark.read.json(str(tmp_path / "registry/source_manifest")).collect()} == {("x", 2), ("y", 1)}
    points = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0), (2, 0, None, 1.0)], "route long, n int, lon double, lat double")
    features = routes.features(points, "route", "n")
    sinks.write_features(features, str(tmp_path / "features"))
    assert {r.value for r in spark.read.text(str(tmp_path / "features")).collect()} == {'{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]},"properties":{"id":"1"}}', '{"type":"Feature","geometry":null,"properties":{"id":"2"}}'}


def test_journal_and_states(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {r.id for r in ingest.pending_ids(ids(1, 2, 3, 4), ids(1, 2), ids(2, 1)).collect()} == {3, 4}
    with pytest.raises(RuntimeError):
        ingest.pending_ids(ids(1, 2), ids(1), ids(1, 2))
    seen = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert {(r.id, r.t) for r in ingest.accumulate(seen, spark.createDataFrame([(2, "c"), (3, "d")], seen.schema)).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rows = [(1, 0, "pending"), (1, 1, "stopped"), (1, 2, "in_progress"), (1, 3, "failed"), (1, 4, "in_progress"), (1, 5, "completed"), (2, 0, "completed"), (3, 0, "pending"), (3, 1, "in_progress"), (3, 2, "completed"), (3, 3, "in_progress")]
    bad = ingest.illegal_changes(spark.createDataFrame(rows, "id int, n int, state string"), "id", ["n"]).collect()
    assert sorted((r.id, r.state) for r in bad) == [(2, "completed"), (3, "in_progress")]


def test_filters_and_keys(spark):
    row = spark.range(1).select(
        filters.page_type(F.lit("Table of Contents"), F.lit(3), F.lit("unknown")).alias("a"),
        filters.page_type(F.lit("prose"), F.lit(30), F.lit("unknown")).alias("b"),
        F.array_sort(text.folded_tokens(F.lit("Césàr æon"))).alias("c"),
        text.surface_key(F.lit("  Caius  Cæsàr ")).alias("d"),
        text.distinct_words(F.lit("The the Cat THE cat sat")).alias("e"),
        text.name_forms(F.lit("Roma, Rome (city)")).alias("f"),
        geo.simulation_mode(F.lit("UNKNOWN"), F.lit(100.0), F.lit(75.0)).alias("g"),
        filters.result_status(F.lit(True), F.lit(False), F.lit(None).cast("string"), F.lit(False), F.lit(True)).alias("h"),
    ).first()
    assert tuple(row) == ("toc", "unknown", ["aeon", "ce", "r", "sa"], "gaius caesar", "The Cat sat", ["Roma", "Rome"], "LAND_SEA_MIXED", "PARTIAL")
    levels = spark.createDataFrame([(1, 1, "I", None), (1, 2, None, "a"), (1, 3, None, None), (1, 4, "II", None), (1, 5, None, None)], "d int, n int, book string, chapter string")
    got = [(r.carried_book, r.carried_chapter) for r in relations.carry_forward(levels, "d", "n", ["book", "chapter"]).orderBy("n").collect()]
    assert got == [("I", None), ("I", "a"), ("I", "a"), ("II", None), ("II", None)]
