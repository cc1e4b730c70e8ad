"""Extraction columns on sentences of known meaning, and polygons against a plain ray cast."""

import random
import re

from pyspark.sql import functions as F

from lodeline.operators import extraction, spatial


def test_modes_and_outcomes(spark):
    cases = [
        ("They sailed to Utica.", "SEA", None),
        ("He marched and rode on.", "LAND", None),
        ("He marched, then sailed.", "UNKNOWN", None),
        ("He never sailed but marched.", "LAND", None),
        ("They planned to march home.", "UNKNOWN", "PLANNED"),
        ("He was prevented from entering the town.", "UNKNOWN", "PREVENTED"),
        ("He stopped before marching.", "LAND", "ABORTED"),
        ("He did not reach it.", "UNKNOWN", "NEGATED"),
        ("He could not reach it and never marched.", "UNKNOWN", None),
        ("", "UNKNOWN", None),
        (None, "UNKNOWN", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = df.select("i", extraction.travel_mode(F.col("s")), extraction.outcome(F.col("s"))).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [c[1:] for c in cases]


def test_mentions_and_inventory(spark):
    df = spark.createDataFrame([(1, "He went from Rome to Capua, to Rome near Ostia at Pisa."), (2, None), (3, "")], "id long, text string")
    found = extraction.place_mentions(df, "id", "text")
    assert [(r.place, r.role) for r in found.orderBy("ordinal").collect()] == [("Rome", "ORIGIN"), ("Capua", "DESTINATION"), ("Rome", "DESTINATION"), ("Ostia", "RELATED_PLACE"), ("Pisa", "EVENT_SITE")]
    held = {r.place: (r["first"], r.n, r.roles) for r in extraction.mention_inventory(found, "id").collect()}
    assert held["Rome"] == (0, 2, "DESTINATION,ORIGIN") and held["Pisa"] == (4, 1, "EVENT_SITE")


def test_declared_events_and_support(spark):
    rows = [("a", 2, "p", None, "y"), ("a", 1, "p", None, "x"), ("b", 1, "p", "d", "x"), ("b", 2, "q", "d", "y"), ("c", 1, "p", "d", "x"), ("c", 1, "p", "d", "y"), ("d", 1, "p", "d", "x"), ("d", 2, "p", None, "x")]
    df = spark.createDataFrame(rows, "event string, at int, period string, description string, step string")
    got = {r.event: (r.status, r.steps) for r in extraction.declared_events(df, "event", "at", "period", "description", "step").collect()}
    assert got == {"a": ("OK", "x>y"), "b": ("PERIOD_CONFLICT", None), "c": ("SEQUENCE_CONFLICT", None), "d": ("DESCRIPTION_CONFLICT", None)}
    phrases = spark.createDataFrame([(1, "Rome"), (1, "Gaul"), (1, "Gaul"), (2, "Rome")], "id int, phrase string")
    assert {tuple(r) for r in extraction.unsupported(phrases, phrases.where("phrase = 'Rome' and id = 1"), ["id", "phrase"]).collect()} == {(1, "Gaul"), (2, "Rome")}


def test_authority(spark):
    rows = [("a", 1.0, 1.0, False)] * 5 + [("b", 1.0, 1.0, True), ("c", None, 1.0, True), ("d", 1.0, 1.0, False), ("d", 2.0, 1.0, False), ("e", 1.0, 1.0, True), ("e", 2.0, 1.0, False), ("f", 1.0, 1.0, True), ("f", 2.0, 1.0, False), ("f", 3.0, 1.0, False)]
    df = spark.createDataFrame(rows, "place string, lon double, lat double, representative boolean")
    got = {r.place: r.authority for r in extraction.authority_class(df, "place").collect()}
    assert got == {"a": "SOURCE_POINT_UNCERTAIN", "b": "REPRESENTATIVE_ONLY", "c": "NON_POINT_GEOMETRY", "d": "MULTI_LOCATION_CONFLICT", "e": "REPRESENTATIVE_ONLY", "f": "MULTI_LOCATION_CONFLICT"}


def test_polygons(spark):
    rnd = random.Random(4)
    rings = {0: [(0, 0), (20, 0), (20, 20), (0, 20)], 1: [(-30, -7), (10, 12), (-4, 33), (-11, 3)]}
    edges = [(k, *map(float, (*a, *b))) for k, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1])]
    points = [(i, rnd.uniform(-40, 30), rnd.uniform(-20, 40)) for i in range(300)] + [(1000, 20.0, 5.0), (1001, 7.0, 20.0), (1002, 0.0, 0.0), (1003, 7.0, 0.0), (1004, 20.0, 20.0)]

    def inside(x, y, ring):
        hits = 0
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            hits += (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a
        return hits % 2 == 1

    want = {(i, k, "interior") for i, x, y in points[:300] for k, ring in rings.items() if inside(x, y, ring)}
    want |= {(i, 0, "boundary") for i in range(1000, 1005)} | {(1002, 1, "interior") for _ in "x" if inside(0.0, 0.0, rings[1])} | {(i, 1, "interior") for i, x, y in points[300:] if inside(x, y, rings[1])}
    got = spatial.point_in_polygon(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(edges, "polygon_id long, x1 double, y1 double, x2 double, y2 double"))
    assert {tuple(r) for r in got.collect()} == want


def test_movement_polarity_and_kinds(spark):
    cases = [
        ("He marched to Rome.", True, True, "MOVEMENT"),
        ("He did not at once march.", False, False, "UNKNOWN"),
        ("He never marched, but sailed.", True, True, "MOVEMENT"),
        ("He would have marched.", True, False, "MOVEMENT"),
        ("They prevented him from having crossed it.", True, False, "MOVEMENT"),
        ("After the battle of Cannae, they concluded peace.", False, False, "TREATY"),
        ("The army didn't go and no longer advanced.", False, False, "MILITARY"),
        ("He besieged the town, then left.", True, True, "SIEGE"),
        ("", False, False, "UNKNOWN"),
        (None, False, False, "UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    s = F.col("s")
    got = df.select("i", extraction.moves(s), extraction.moves(s, completed=True), extraction.event_kind(s)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]


def test_transitions(spark):
    rows = [("p", "LAND", "SEA", True, True, "CONFIRMED"), ("p", "LAND", "SEA", True, True, None), ("p", "SEA", "SEA", True, True, "SUPPORTED"), (None, "LAND", "SEA", True, True, "SUPPORTED"), ("p", "LAND", "SEA", None, True, "SUPPORTED")]
    df = spark.createDataFrame(rows, "port string, a string, b string, land boolean, sea boolean, e string")
    assert [r[0] for r in df.select(extraction.transition(*[F.col(c) for c in df.columns])).collect()] == ["ALLOWED", "UNKNOWN", "DENIED", "DENIED", "DENIED"]


def test_sea_legs(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    land = spark.createDataFrame([(1, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)], "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    legs = [
        (1, -5.0, 5.0, -5.0, 9.0, "direct_water_validated"),
        (2, -5.0, 5.0, 15.0, 5.0, "sample_not_ocean_interior"),
        (3, 5.0, 5.0, 15.0, 5.0, "endpoint_not_ocean_interior"),
        (4, -5.0, 5.0, -5.0, 5.0, "zero_length_leg"),
        (5, None, 5.0, -5.0, 5.0, "invalid_coordinate"),
        (6, -0.012, 9.985, 0.01, 10.007, "land_intersection"),
        (7, 179.0, 40.0, -179.0, 40.0, "direct_water_validated"),
        (8, -5.0, 95.0, -5.0, 5.0, "invalid_coordinate"),
    ]
    df = spark.createDataFrame([r[:5] for r in legs], "id int, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {r.id: r for r in spatial.sea_legs(df, land).collect()}
    assert {i: r.reason for i, r in got.items()} == {r[0]: r[5] for r in legs}
    assert 444_000 < got[1].metres < 446_000 and got[1].samples == 90 and got[2].samples < 120
    assert {r.reason for r in spatial.sea_legs(df, land.limit(0)).collect()} == {"direct_water_validated", "zero_length_leg", "invalid_coordinate"}


def test_sea_legs_are_dealt_by_samples(spark, monkeypatch):
    """Few bytes of long legs in one partition: their samples go to several tasks."""
    land = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0, 0.0)], "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    legs = spark.range(200).selectExpr("cast(id as int) id", "-170d lon1", "-80d lat1", "-10d lon2", "60d lat2").coalesce(1)
    found, real = [], spatial.point_in_polygon

    def spy(points, edges, *more):
        found.append(points.rdd.getNumPartitions())
        return real(points, edges, *more)

    monkeypatch.setattr(spatial, "point_in_polygon", spy)
    spatial.sea_legs(legs, land)
    assert found[0] > 1


def test_sea_legs_samples_are_not_broadcast(spark, monkeypatch):
    """Few bytes of legs make many samples: the driver gets the sides of the land, or neither side of the join."""
    corners = spark.range(25).selectExpr("id polygon_id", "id * 10d - 120 x", "id * 4d - 50 y")
    sides = corners.selectExpr("polygon_id", "explode(array(struct(x x1, y y1, x + 9 x2, y y2), struct(x + 9 x1, y y1, x x2, y + 3 y2), struct(x x1, y + 3 y1, x x2, y y2))) e")
    legs = spark.range(200).selectExpr("id", "-170d + id / 2 lon1", "-80d lat1", "-10d lon2", "60d lat2")
    results = []
    for most in (200_000, 10):
        monkeypatch.setattr(spatial, "BROADCAST_ROWS", most, raising=False)
        df = spatial.sea_legs(legs, sides.select("polygon_id", "e.*"))
        results.append(sorted(map(tuple, df.collect())))
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        joins = [line for line in plan.splitlines() if re.search(r"Join \[band#\w+, column#\w+\]", line)]
        assert len(joins) == 2 and all(("BroadcastHashJoin" in j and "BuildRight" in j) if most > 10 else "SortMergeJoin" in j for j in joins)
    assert results[0] == results[1] and len({r[1] for r in results[0]}) > 1
