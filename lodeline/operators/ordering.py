"""Ordering edges and graphs: conflicts, degrees, components, chains, cycles, shortest paths."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; a local session without one makes its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodeline-"))
    return df.checkpoint(eager=True)


def best_edges(edges: DataFrame) -> DataFrame:
    """Duplicate edges (src, dst, priority): the best priority stays."""
    return edges.groupBy("src", "dst").agg(F.min("priority").alias("priority"), F.count(F.lit(1)).alias("n"))


def drop_reversed(edges: DataFrame) -> DataFrame:
    """Of two opposite edges the one with the better priority stays, none if equal."""
    other = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("priority").alias("against"))
    return edges.join(other, ["src", "dst"], "left").where("against is null or priority < against").drop("against")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def branch_edges(edges: DataFrame) -> DataFrame:
    """Edges whose source has several ways out or whose target several ways in."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    return edges.join(out, "src").join(into, "dst").where("o > 1 or i > 1").drop("o", "i")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component = least node): least labels spread along the edges and through the labels' own labels."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["src"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = least.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = cut(least.join(jump, "new").select("node", "label", F.least("new", "far").alias("new")))
        labels = moved.select("node", F.col("new").alias("label"))
        if not moved.where("new <> label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))


def trim_to_cycles(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a way in or out are removed again and again: those on or between cycles."""
    left, n = cut(edges.select("src", "dst").distinct()), -1
    while True:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = cut(kept)
        if (now := kept.count()) == n:
            return kept
        left, n = kept, now


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node, component): nodes of strongly connected components of several nodes, and those with an edge
    to themselves; component is the least node. Trimmed to what lies on or between cycles first, then
    the least labels that spread forward and backward peel off one component for each pair of roots a round."""
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left, done = trim_to_cycles(edges.where("src <> dst")), None
    while left.limit(1).count():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        ahead, back = _spread(left, nodes), _spread(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)
        both = cut(ahead.withColumnRenamed("label", "f").join(back.withColumnRenamed("label", "b"), "node"))
        found = both.where("f = b").select("node", F.col("f").alias("component"))
        done = found if done is None else done.union(found)
        # a component lies within one pair of labels; those of equal labels are complete
        inside = left.join(both.select(F.col("node").alias("src"), F.struct("f", "b").alias("p")), "src").join(both.select(F.col("node").alias("dst"), F.struct("f", "b").alias("q")), "dst")
        left = trim_to_cycles(inside.where("p = q and p.f <> p.b").select("src", "dst"))
    if done is None:
        return own.withColumn("component", F.col("node"))
    several = done.join(done.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component")
    return cut(several.union(own.join(several, "node", "left_anti").withColumn("component", F.col("node"))))


def _spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node from which each can be reached."""
    labels = cut(nodes.withColumn("label", F.col("node")))
    while True:
        come = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("new"))
        moved = cut(labels.join(come, labels["node"] == come["dst"], "left").select("node", "label", F.least("label", "new").alias("best")))
        labels = moved.select("node", F.col("best").alias("label"))
        if not moved.where("best <> label").limit(1).count():
            return labels


def linear_chains(edges: DataFrame) -> DataFrame:
    """(node, head, position) along the maximal chains of any graph: edges at branches (several ways out of the source or
    into the target) and edges of cycles don't chain. Pointer doubling: the rounds are logarithmic in a chain's length."""
    single = branch_free(edges.select("src", "dst").distinct()).where("src <> dst")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    start = nodes.join(single.select(F.col("dst").alias("node"), F.col("src").alias("head")), "node", "left")
    state = cut(start.select("node", F.coalesce("head", "node").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("position")))
    rounds, most = 0, max(1, state.count()).bit_length() + 1
    while True:
        up = state.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("position").alias("more"))
        moved = cut(state.join(up, "head").select("node", F.col("next").alias("head"), (F.col("position") + F.col("more")).alias("position"), (F.col("more") > 0).alias("changed")))
        state, rounds = moved.drop("changed"), rounds + 1
        if not moved.where("changed").limit(1).count():
            return state
        if rounds >= most:  # what still moves goes round: each of its nodes is a chain of its own
            return cut(moved.select("node", F.when(F.col("changed"), F.col("node")).otherwise(F.col("head")).alias("head"), F.when(F.col("changed"), 0).otherwise(F.col("position")).cast("long").alias("position")))


def branch_free(edges: DataFrame) -> DataFrame:
    """Edges that are the only way out of their source and the only one into their target."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    return edges.join(out, "src").join(into, "dst").where("o = 1 and i = 1").select("src", "dst")


def normalized(edges: DataFrame) -> DataFrame:
    """Duplicates resolved, opposite edges resolved: the edges (src, dst, priority) that an order may use."""
    return drop_reversed(best_edges(edges).drop("n"))


def resolve_duplicates(edges: DataFrame) -> DataFrame:
    """(src, dst, priority, authority, refs, merged, status): of the edges between two nodes the best priority is
    kept; of equal priority the same authority merges its references, another one is rejected."""
    same = edges.groupBy("src", "dst", "priority", "authority").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), F.count(F.lit(1)).alias("merged"))
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("priority", "authority"))
    return same.withColumn("status", F.when(first == 1, "KEPT").otherwise("REJECTED"))


def between(edges: DataFrame, origin, destination, steps: int) -> DataFrame:
    """Edges on some walk of at most `steps` edges from an origin to a destination: forward and backward levels meet."""
    def levels(pairs, start):
        known = cut(start.withColumn("level", F.lit(0)))
        for level in range(1, steps + 1):
            new = pairs.join(known.where(F.col("level") == level - 1), pairs["src"] == known["node"]).select(F.col("dst").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
            known = cut(known.union(new.withColumn("level", F.lit(level))))
        return known

    pairs = cut(edges.select("src", "dst").distinct())
    ahead, back = levels(pairs, origin), levels(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), destination)
    out = pairs.join(ahead.withColumnRenamed("node", "src").withColumnRenamed("level", "a"), "src").join(back.withColumnRenamed("node", "dst").withColumnRenamed("level", "b"), "dst")
    return out.where(F.col("a") + F.col("b") + 1 <= steps).select("src", "dst")


def anchored(chains: DataFrame, origin, destination) -> DataFrame:
    """(node, head, position) of chains between the first origin and the next destination after it."""
    w = Window.partitionBy("head")
    a = chains.withColumn("__o", F.min(F.when(origin, F.col("position"))).over(w))
    b = a.withColumn("__d", F.min(F.when(destination & (F.col("position") > F.col("__o")), F.col("position"))).over(w))
    return b.where("position between __o and __d").drop("__o", "__d")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance, via): distances over undirected edges and the node before; of equally short ways that
    by the least node. Walk `via` back for the path."""
    both = cut(edges.select("src", "dst", "cost").union(edges.select("dst", "src", "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    best = cut(shortest_distances(edges, sources))
    near = best.select("source", F.col("node").alias("src"), F.col("distance").alias("d")).join(both, "src")
    via = near.groupBy("source", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("d") + F.col("cost")).alias("t"), "src")).alias("m"))
    return best.join(via, ["source", "node"], "left").select("source", "node", "distance", F.when((F.col("distance") > 0) & (F.abs(F.col("m.t") - F.col("distance")) < 1e-6), F.col("m.src")).alias("via"))


def paths_to(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, nodes): the way back along `via`, a step for all targets a round."""
    walk = cut(targets.join(found, targets["target"] == found["node"]).select("source", "target", F.col("node").alias("at"), F.array("node").alias("nodes"), "via"))
    while walk.where("via is not null").limit(1).count():
        step = walk.join(found.select("source", F.col("node").alias("via"), F.col("via").alias("next")), ["source", "via"], "left")
        walk = cut(step.select("source", "target", F.coalesce("via", "at").alias("at"), F.when(F.col("via").isNotNull(), F.concat(F.array("via"), "nodes")).otherwise(F.col("nodes")).alias("nodes"), F.col("next").alias("via")))
    return walk.select("source", "target", "nodes")


def shortest_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance) over undirected weighted edges (src, dst, cost): frontier
    relaxation, in which only nodes that improved send again."""
    both = cut(edges.select("src", "dst", "cost").union(edges.select("dst", "src", "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    best = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")))
    frontier = best
    while frontier.limit(1).count():
        sent = frontier.join(both, frontier["node"] == both["src"]).groupBy("source", "dst").agg(F.min(F.col("distance") + F.col("cost")).alias("new"))
        merged = cut(best.join(sent.withColumnRenamed("dst", "node"), ["source", "node"], "full_outer").select("source", "node", F.least("distance", "new").alias("distance"), (F.col("new") < F.coalesce("distance", F.lit(float("inf")))).alias("better")))
        best, frontier = merged.drop("better"), merged.where("better").drop("better")
    return best


def consecutive(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Edges from each row to the next one of its group."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("dst", F.lead(value).over(w)).where("dst is not null").withColumnRenamed(value, "src")
