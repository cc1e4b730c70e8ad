"""Route candidates, totals and presentation from tables of legs, segments and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_profile(segments: DataFrame, by: str) -> DataFrame:
    """Segments and metres by status ("Unknown" for null) of each path, and its distinct citations in order."""
    status = F.coalesce("status", F.lit("Unknown"))
    counted = segments.groupBy(by, status.alias("status")).agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("metres"), 3).alias("metres"))
    cited = segments.where("citation is not null").groupBy(by).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "citation"))), lambda x: x["citation"])).alias("citations"))
    return counted.join(cited, by, "left")


def route_totals(legs: DataFrame, by: str) -> DataFrame:
    """Legs found and not, their metres, and the route's status by them."""
    ok = F.col("metres").isNotNull()
    found = legs.groupBy(by).agg(F.count_if(ok).alias("found"), F.count_if(~ok).alias("missing"), F.coalesce(F.round(F.sum("metres"), 3), F.lit(0.0)).alias("metres"))
    return found.withColumn("status", F.when(F.col("found") == 0, "UNAVAILABLE").when(F.col("missing") > 0, "PARTIAL").otherwise("COMPLETE"))


def cost_totals(steps: DataFrame, by: str, order: str) -> DataFrame:
    """Component sums, climb and descent from the heights of consecutive steps, least confidence, steepest slope."""
    w = Window.partitionBy(by).orderBy(order)
    rise = F.col("height") - F.lag("height").over(w)
    each = steps.withColumn("rise", rise)
    return each.groupBy(by).agg(
        F.round(F.sum("distance"), 6).alias("distance"),
        F.round(F.sum("terrain"), 6).alias("terrain"),
        F.round(F.coalesce(F.sum(F.when(F.col("rise") > 0, F.col("rise"))), F.lit(0.0)), 6).alias("climb"),
        F.round(F.coalesce(F.sum(F.when(F.col("rise") < 0, -F.col("rise"))), F.lit(0.0)), 6).alias("descent"),
        F.min("confidence").alias("confidence"),
        F.round(F.max(F.when(F.col("distance") > 0, F.abs("rise") / F.col("distance"))), 6).alias("steepest"),
    )


def quality(points: DataFrame, by: str, order: str, land: Column, wanted: DataFrame) -> DataFrame:
    """(by, land_ratio, order_preserved): the share of a route's points on land, and whether the places it is
    wanted to pass (by, places) come in their order."""
    rows = points.groupBy(by).agg(F.round(F.avg(F.when(land, 1.0).otherwise(0.0)), 6).alias("land_ratio"), F.transform(F.array_sort(F.collect_list(F.struct(order, "place"))), lambda x: x["place"]).alias("__p"))
    kept = F.filter("__p", lambda x: F.array_contains("places", x))
    return rows.join(wanted, by, "left").select(by, "land_ratio", F.coalesce(kept == F.col("places"), F.lit(True)).alias("order_preserved"))


def graph_statistics(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, largest, self loops, parallel edges, and geometries that repeat in either direction."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    sizes = components.groupBy("component").count().agg(F.count(F.lit(1)).alias("components"), F.max("count").alias("largest"))
    counts = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    parallel = edges.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("parallel"))
    shape = F.least(F.col("geometry"), F.reverse("geometry"))
    repeated = edges.groupBy(shape).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_geometry"))
    one = lambda df: df.withColumn("__k", F.lit(1))  # noqa: E731  each side is a single row
    out = one(counts)
    for part in (sizes, parallel, repeated, ends.agg(F.count(F.lit(1)).alias("nodes"))):
        out = out.join(one(part), "__k")
    return out.drop("__k")


def network_audit(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(degree, nodes, share): the distribution of degrees."""
    total = Window.partitionBy(F.lit(1))
    counted = degrees.groupBy((F.col("out_degree") + F.col("in_degree")).alias("degree")).agg(F.count(F.lit(1)).alias("nodes"))
    return counted.withColumn("share", F.round(F.col("nodes") / F.sum("nodes").over(total), 6))


def best_candidates(candidates: DataFrame, by: str, kinds: tuple[str, ...]) -> DataFrame:
    """Of each leg's candidates (by, kind, ok, cost, id) the first kind in order that is ok, then the least cost and id."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    w = Window.partitionBy(by).orderBy(rank, "cost", "id")
    return candidates.where("ok").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def variants(legs: DataFrame, profiles: DataFrame, weights: tuple[float, float, float], by: str) -> DataFrame:
    """Each leg under each profile (a handful), its weighted cost, and its rank; ties by total cost, then name."""
    w_distance, w_terrain, w_history = weights
    each = legs.crossJoin(F.broadcast(profiles))  # profiles: a constant list of a few rows
    terrain = F.col("terrain") * F.col("terrain_weight")
    cost = each.withColumns({"total_cost": F.round(F.col("distance") + terrain + F.col("history") * F.col("history_weight"), 6), "weighted": F.round(w_distance * F.col("distance") + w_terrain * terrain + w_history * F.col("history") * F.col("history_weight"), 6)})
    w = Window.partitionBy(by).orderBy("weighted", "total_cost", "profile")
    return cost.withColumn("rank", F.row_number().over(w).cast("long"))


def features(points: DataFrame, by: str, order: str) -> DataFrame:
    """(by, feature): a GeoJSON LineString of a route's points in order; fewer than two points have a null geometry."""
    at = F.transform(F.array_sort(F.collect_list(F.struct(order, F.array("lon", "lat").alias("p")))), lambda x: x["p"])
    rows = points.where("lon is not null and lat is not null").groupBy(by).agg(at.alias("line"))
    every = points.select(by).distinct().join(rows, by, "left")
    geometry = F.when(F.size("line") > 1, F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(by).cast("string").alias("id")).alias("properties"))
    return every.select(by, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def presentation(routes: DataFrame, legs: DataFrame, by: str, order: str) -> DataFrame:
    """(by, document): a route with its score, explanation and legs as nested JSON; gaps are legs without geometry."""
    each = legs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "mode", "metres", F.when(F.col("metres").isNull(), "gap").otherwise("leg").alias("kind")))).alias("legs"))
    made = F.struct(F.col(by).alias("id"), F.struct("score", "status").alias("score"), F.col("explanation").alias("explanation"), F.col("legs").alias("legs"))
    return routes.join(each, by, "left").select(by, F.to_json(made, {"ignoreNullFields": "false"}).alias("document"))


def ledger(places: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each place and edge with its evidence and, where it was rejected, why."""
    a = places.select(F.lit("place").alias("kind"), F.col("id").cast("string").alias("id"), "refs", "reason")
    b = edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id"), "refs", "reason")
    return a.unionByName(b).withColumn("status", F.when(F.col("reason").isNull(), "ACCEPTED").otherwise("REJECTED"))


def configured_chain(config: DataFrame, registry: DataFrame, by: str, items: str, key: str) -> DataFrame:
    """(by, position, key, known): a configured list in its order against a registry."""
    each = config.select(by, F.posexplode(items).alias("position", key))
    return each.join(registry.select(key).distinct().withColumn("known", F.lit(True)), key, "left").select(by, "position", key, F.coalesce("known", F.lit(False)).alias("known"))


def stage_funnel(gold: DataFrame, stages: list[str]) -> DataFrame:
    """gold with the first stage that isn't passed, its label there, and whether all are. Columns hold EXACT,
    ASSERTION_EQUIVALENT_OVERLAP, MISSING or NOT_CHECKABLE; the last doesn't fail a stage."""
    failed = F.array_compact(F.array(*[F.when(F.col(s) == "MISSING", F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage"))) for i, s in enumerate(stages)]))
    return gold.withColumns({"first_failing": F.when(F.size(failed) > 0, failed[0]["stage"]), "passed": F.size(failed) == 0})


def feature_role(types: Column, rules: list[tuple[str, list[str]]], other: str = "unknown") -> Column:
    """The first kind of feature whose types meet a place's."""
    out = F.lit(other)
    for kind, names in reversed(rules):
        out = F.when(F.arrays_overlap(types, F.array(*map(F.lit, names))), kind).otherwise(out)
    return out


def authority_strength(blockers: dict[str, Column], grounds: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(strength, blockers, grounds): none with any blocker, else by the number of grounds."""
    named = lambda flags: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
    b, g = named(blockers), named(grounds)
    return F.when(F.size(b) > 0, "BLOCKED").when(F.size(g) >= 2, "STRONG").when(F.size(g) == 1, "WEAK").otherwise("NONE"), b, g
