import heapq
import inspect
import json
import math
import random
import struct
import zipfile

from pyspark.sql import functions as F

from lodeline.functions import geo, text
from lodeline.operators import ordering, retrieval, spatial
from lodeline.plans import catalog
from lodeline.sources import readers
from lodeline.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_years_and_romans(spark):
    df = spark.createDataFrame([("XIV",), ("IIII",), ("",), ("mcmxc",), ("MMXXVI",)], "s string")
    assert [r[0] for r in df.select(text.roman_value(F.col("s"))).collect()] == [14, None, None, 1990, 2026]
    got = one(spark, text.signed_year(F.lit(44), F.lit("BC")), text.signed_year(F.lit(0), F.lit("AD")), text.shift_year(F.lit(-1), 1), text.shift_year(F.lit(1), -1), text.shift_year(F.lit(-5), 2))
    assert tuple(got) == (-44, None, 1, -1, -3)


def test_text_columns(spark):
    df = spark.createDataFrame([("hyphen-\n ated  word \n x",), (None,), ("",), ("a" * 50 + "\x01" * 5,)], "t string")
    assert [r[0] for r in df.select(text.clean(F.col("t"))).collect()][:1] == ["hyphenated word x"]
    assert [r[0] for r in df.select(text.quality(F.col("t"))).collect()] == ["empty", "empty", "empty", "poor"]


def test_geodesy(spark):
    lon, lat = geo.destination(F.lit(10.0), F.lit(40.0), F.lit(90.0), F.lit(100_000.0))
    assert abs(one(spark, geo.haversine(F.lit(10.0), F.lit(40.0), lon, lat))[0] - 100_000) < 1e-3
    x, y = geo.mercator_to_degrees(F.lit(geo.AXIS), F.lit(0.0))
    assert abs(one(spark, x)[0] - math.degrees(1)) < 1e-9 and abs(one(spark, y)[0]) < 1e-9


def test_selection_reasons(spark):
    rows = [(1, "a", 0, 2, 0.9, 1), (1, "a", 0, 2, 0.8, 2), (1, "a", 1, 3, 0.7, 3), (1, "b", 1, 3, 0.0, 4), (1, "c", 0, 1, 0.5, 5), (1, "d", 0, 1, 0.4, 6)]
    got = retrieval.select_spans(spark.createDataFrame(rows, "query_id int, source string, start int, stop int, score double, rank long"), 2)
    assert [r.reason for r in got.orderBy("rank").collect()] == ["SELECTED", "EXACT_DUPLICATE", "OVERLAP_EVICTION", "LOW_RERANK_SCORE", "SELECTED", "TOP_K_TRUNCATION"]


def test_graphs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (5, 100)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in ordering.trim_to_cycles(df).collect()} == {(100, 101), (101, 102), (102, 100)}
    chain = {r.node: (r.head, r.position) for r in ordering.linear_chains(df.where("src < 20 and dst < 50")).collect()}
    assert chain == {i: (0, i) for i in range(21)}
    rnd = random.Random(1)
    weighted = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(1, 9)) for _ in range(90)]
    near = {}
    for a, b, c in weighted:
        near.setdefault(a, []).append((b, c)), near.setdefault(b, []).append((a, c))
    best, heap = {}, [(0, 0)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, c in near.get(n, []):
                heapq.heappush(heap, (d + c, m))
    got = ordering.shortest_distances(spark.createDataFrame(weighted, "src long, dst long, cost long"), spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.distance for r in got.collect()} == best


def test_astar_is_optimal():
    rnd = random.Random(3)
    for _ in range(20):
        cells = {(x, y): rnd.choice([1.0, 2.0, 5.0]) for x in range(9) for y in range(9) if rnd.random() > 0.2 or (x, y) in ((0, 0), (8, 8))}
        best, heap = {}, [(0.0, (0, 0))]
        while heap:
            d, c = heapq.heappop(heap)
            if c in best:
                continue
            best[c] = d
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    t = (c[0] + dx, c[1] + dy)
                    if t != c and t in cells:
                        heapq.heappush(heap, (d + math.hypot(dx, dy) * (cells[c] + cells[t]) / 2, t))
        found = spatial.astar(cells, (0, 0), (8, 8))
        assert (found is None) == ((8, 8) not in best) and (found is None or abs(found[1] - best[8, 8]) < 1e-9)


def test_radius_near_poles_and_date_line(spark):
    rnd = random.Random(4)
    points = [(i, rnd.choice([rnd.uniform(-180, 180), 179.99, -179.99]), rnd.choice([rnd.uniform(-89, 89), 88.9, 0.0])) for i in range(150)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")

    def far(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.RADIUS * math.asin(min(1, math.sqrt(h)))

    got = {(r.point_id, r.target_id) for r in spatial.within(df, df, 300_000.0).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if far(a, b) <= 300_000}


def test_sources(spark, tmp_path):
    roads = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "x"}, "geometry": {"type": t, "coordinates": c}} for t, c in (("LineString", [[0, 1], [2, 3]]), ("MultiLineString", [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]))]}
    (tmp_path / "r.json").write_text(json.dumps(roads, indent=1))
    got = readers.geojson_roads(spark, str(tmp_path / "r.json")).collect()
    assert sorted(len(r.points) for r in got) == [2, 2, 3]
    side = 3
    (tmp_path / "N41E012.hgt").write_bytes(struct.pack(">9h", 1, 2, 3, 4, -32768, 6, 7, 8, 9))
    points = spark.createDataFrame([(1, 12.0, 41.999), (2, 12.5, 41.5), (3, 50.0, 1.0), (4, 12.999, 41.0)], "id long, lon double, lat double")
    found = {r.id: (r.elevation, r.status) for r in readers.sample_elevation(points, readers.elevation_tiles(spark, str(tmp_path))).collect()}
    assert side and found == {1: (1, "VALID"), 2: (None, "NODATA"), 3: (None, "MISSING"), 4: (9, "VALID")}
    pages = spark.createDataFrame([(1, "<body><h1>T &amp; U</h1><script>no</script><p>one <b>two</b></p>tail</body>"), (2, None)], "page_id long, html string")
    assert [(r.kind, r.text) for r in readers.html_blocks(pages).orderBy("block").collect()] == [("heading", "T & U"), ("paragraph", "one two"), ("paragraph", "tail")]
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="p"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p>A</p>"), z.writestr("o/b.xhtml", "<p>B</p>")
    assert [(r.spine, r.name) for r in readers.epub_documents(spark, str(tmp_path)).orderBy("spine").collect()] == [(0, "o/b.xhtml"), (1, "o/a.xhtml")]


def test_ingestion_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "v": k}) for i in range(k, k + 3)))
    for _ in range(2):
        ingest.upsert_stream(spark, source, "id long, v long", target, state).awaitTermination()
    (tmp_path / "in" / "9.json").write_text(json.dumps({"id": 0, "v": 9}))
    ingest.upsert_stream(spark, source, "id long, v long", target, state).awaitTermination()
    got = {r.id: r.v for r in ingest.latest(spark, target).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0] == 9
    states = spark.createDataFrame([(1, 0, "pending"), (1, 1, "in_progress"), (1, 2, "completed"), (2, 0, "pending"), (2, 1, "completed")], "id int, n int, state string")
    assert [(r.id, r.state) for r in ingest.illegal_changes(states, "id", ["n"]).collect()] == [(2, "completed")]


def test_components_over_all_orders(spark, sf_dir):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        x, y = find(a), find(-b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in catalog.queries()["weak_components_all_orders"](spark, sf_dir).collect()}
    assert got == {n: find(n) for n in [*root]}


def test_shortest_paths_over_all_parts(spark, sf_dir):
    near, best, queue = {}, {}, [(0.0, 1)]
    for s, p, q in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity").collect():
        for a, b in ((s, -p), (-p, s)):
            near.setdefault(a, []).append((b, int(q)))
    while queue:
        d, n = heapq.heappop(queue)
        if n not in best:
            best[n] = d
            for other, cost in near.get(n, ()):
                heapq.heappush(queue, (d + cost, other))
    got = {(r.source, r.node): r.distance for r in catalog.queries()["shortest_paths_all_parts"](spark, sf_dir).collect()}
    assert got == {(1, n): d for n, d in best.items()} and len(got) > 97


def test_sea_legs_query_samples_at_the_default(spark, sf_dir, monkeypatch):
    bound, plain = [], inspect.signature(spatial.sea_legs)
    real = spatial.sea_legs

    def spy(*args, **kwargs):
        call = plain.bind(*args, **kwargs)
        call.apply_defaults()
        bound.append(call.arguments["metres"])
        return real(*args, **kwargs)

    monkeypatch.setattr(spatial, "sea_legs", spy)
    assert catalog.queries()["sea_legs"](spark, sf_dir).count() > 0 and bound == [5_000.0]
