"""Operators on import graphs ``edges(src, dst)``: joins and grouped aggregates, never an adjacency map."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillon.operators import strong

# Fixed value: edges that one task walks, in some hundred bytes each.
LOCAL = 2_000_000


def merged_edges(proofs: DataFrame) -> DataFrame:
    """One row an edge: smallest line, sorted distinct symbols without ``*`` and ``default``, number of distinct proofs."""
    symbol = F.when(~F.col("symbol").isin("*", "default"), F.col("symbol"))
    return proofs.groupBy("src", "dst").agg(F.min("line").alias("line"), F.array_sort(F.collect_set(symbol)).alias("symbols"), F.countDistinct("line", "symbol").alias("proofs"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, fan_out, fan_in`` of every node, counting distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").cast("long").alias("fan_out"), F.sum("i").cast("long").alias("fan_in"))


def stats(edges: DataFrame) -> DataFrame:
    """Nodes with out-edges, edges, and edges a node to one digit."""
    e = edges.select("src", "dst").distinct().agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("edges"))
    return e.withColumn("average", F.round(F.coalesce(F.try_divide("edges", "nodes"), F.lit(0.0)), 1))


def importers(edges: DataFrame) -> DataFrame:
    """Reverse adjacency: each node's distinct importers, sorted."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("importers"))


def centrality(edges: DataFrame) -> DataFrame:
    """In-degree over the largest in-degree. The largest is one row and joins by a scalar subquery, not a global window."""
    counts = edges.groupBy("dst").agg(F.countDistinct("src").alias("n"))
    top = counts.agg(F.greatest(F.max("n"), F.lit(1)).alias("top"))
    return counts.join(F.broadcast(top)).select(F.col("dst").alias("node"), F.col("n").alias("fan_in"), (F.col("n") / F.col("top")).alias("centrality"))


def entrypoints(edges: DataFrame) -> DataFrame:
    """Nodes that import and that nothing imports."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their ``rank`` from 1; only k rows are ranked."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def unused_exports(exports: DataFrame, imported: DataFrame) -> DataFrame:
    """Exports ``file, name`` that nobody imports by name; no defaults, barrels or tests."""
    usable = (F.col("name") != "default") & ~F.col("barrel") & ~F.col("test")
    return exports.where(usable).join(imported.select("file", "name").distinct(), ["file", "name"], "left_anti")


def impact(edges: DataFrame, targets: DataFrame, most: int = 20) -> DataFrame:
    """Files that import a target directly (hop 1) or through one file (hop 2), nearest first, at most ``most`` a target."""
    e = edges.select("src", "dst").distinct()
    one = e.join(targets.select(F.col("node").alias("dst")), "dst").select(F.col("dst").alias("target"), F.col("src").alias("file"), F.lit(1).alias("hop"))
    two = one.join(e, one["file"] == e["dst"]).select("target", F.col("src").alias("file"), F.lit(2).alias("hop"))
    best = one.union(two).where("file <> target").groupBy("target", "file").agg(F.min("hop").alias("hop"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("hop", "file"))
    return best.withColumn("place", place).where(F.col("place") <= most)


def _accepted(edges: DataFrame, accept: Callable[[Column, Column], Column] | None) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    return e if accept is None else e.where(accept(F.col("src"), F.col("dst")))


def paths(edges: DataFrame, starts: DataFrame, hops: int = 3, direction: str = "out", most: int | None = None, accept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Simple paths of up to ``hops`` edges from each start, as ``start, hops, path``; ``most`` a start, shortest and smallest first. ``accept(src, dst)`` says which edges count; null is no."""
    if not 1 <= hops <= 3:
        raise ValueError("one to three hops")
    e = _accepted(edges, accept)
    if direction == "in":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction != "out":
        raise ValueError("direction is in or out")
    level = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    found = None
    for k in range(1, hops + 1):
        level = level.withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        level = level.select("start", F.concat("path", F.array("dst")).alias("path"))
        step = level.select("start", F.lit(k).alias("hops"), "path")
        found = step if found is None else found.union(step)
    if most is None:
        return found
    return found.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("hops", "path"))).where(F.col("n") <= most).drop("n")


def capped_paths(edges: DataFrame, starts: DataFrame, hops: int = 3, direction: str = "out", nodes: int = 100, most: int = 200, inspections: int = 1000, accept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """:func:`paths` in breadth-first order, neighbours by name, within bounds for each start; ``truncated`` says whether a bound was met.

    ``inspections`` bounds the edges looked at, ``nodes`` the distinct nodes entered, the start among them, ``most`` the paths. A node over its
    bound is not entered, and nothing behind it. Edges that ``accept(src, dst)`` doesn't take aren't looked at.
    """
    e = _accepted(edges, accept)
    if direction == "in":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    level = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    found = None
    for k in range(1, hops + 1):
        step = level.withColumn("src", F.element_at("path", -1)).join(e, "src").select("start", F.lit(k).alias("hops"), F.concat("path", F.array("dst")).alias("path"), (~F.array_contains("path", F.col("dst"))).alias("simple"))
        # No more than one over the bound can matter in any level.
        step = step.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("path"))).where(F.col("n") <= inspections + 1).drop("n")
        found = step if found is None else found.union(step)
        level = step.where("simple").select("start", "path")
    first = found.where("simple").groupBy("start", F.element_at("path", -1).alias("node")).agg(F.min(F.struct("hops", "path")).alias("at"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("at"))).where(F.col("n") < nodes).groupBy("start").agg(F.collect_set("node").alias("kept"))
    rows = found.join(kept, "start").withColumn("enters", F.array_contains("kept", F.element_at("path", -1)))
    rows = rows.where(F.forall(F.slice("path", 2, F.size("path") - 2), lambda x: F.array_contains("kept", x)))
    order = Window.partitionBy("start").orderBy("hops", "path")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("p", F.sum((F.col("simple") & F.col("enters")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("i") > inspections) | (F.col("simple") & ((F.col("p") > most) | ~F.col("enters")))
    rows = rows.withColumn("truncated", F.max(over).over(Window.partitionBy("start")))
    return rows.where(F.col("simple") & F.col("enters") & (F.col("i") <= inspections) & (F.col("p") <= most)).select("start", "hops", "path", "truncated")


def _least(edges: DataFrame, keep) -> DataFrame:
    """``node, least``: the smallest node from which each node is reached, itself included; one round for each step that it is away."""
    label = keep(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("least", F.col("node")), "least")
    while True:
        came = edges.join(label, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("least").alias("via"))
        new = keep(label.join(came, F.col("node") == F.col("dst"), "left").select("node", F.least("least", "via").alias("least"), (F.col("via") < F.col("least")).alias("moved")), "least")
        label = new.select("node", "least")
        if new.where("moved").isEmpty():
            return label


def cycle_groups(edges: DataFrame, keep, local: int = LOCAL) -> DataFrame:
    """``node, group`` of every node that lies on a cycle of any length; the group is the smallest node that it can reach and be reached from.

    Strongly connected components. Up to ``local`` edges are walked in one task, whose rounds would cost a job each (:mod:`quillon.operators.strong`). More are first
    parted: each node takes the smallest node that reaches it and the smallest that it reaches. Where both are one node, that is its group; an edge whose ends
    differ in either lies on no cycle and goes. ``keep(df, name)`` writes a round's table to shared storage and reads it back.
    """
    left = keep(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    kind = left.schema["src"].dataType
    found = []
    while left.count() > local:
        up, down = _least(left, keep), _least(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), keep)
        both = keep(up.select("node", F.col("least").alias("up")).join(down.select("node", F.col("least").alias("down")), "node"), "both")
        tied = both.where("up = down AND node <> up").select("node", F.col("up").alias("group"))
        found += [tied, tied.select(F.col("group").alias("node"), "group").distinct()]
        open_ = both.where("up <> down")
        ends = left.join(open_.select(F.col("node").alias("src"), "up", "down"), "src").join(open_.select(F.col("node").alias("dst"), F.col("up").alias("up_"), F.col("down").alias("down_")), "dst")
        left = keep(ends.where("up = up_ AND down = down_").select("src", "dst"), "edges")
    rest = left.coalesce(1).mapInArrow(strong.groups, StructType([StructField("node", kind), StructField("group", kind)]))
    return reduce(DataFrame.union, found, rest)


def stats_or_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """:func:`stats`; where no node has an edge out, ``nodes`` are the distinct files."""
    n = files.agg(F.countDistinct("path").alias("files"))
    return stats(edges).join(F.broadcast(n)).select(F.coalesce(F.nullif("nodes", F.lit(0)), "files").alias("nodes"), "edges", "average")  # one row each


def pending(edges: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose target is indexed, with its ``fingerprint``, and those whose target isn't, each ``(src, line, specifier)`` once."""
    now = current.select(F.col("path").alias("dst"), "fingerprint")
    return edges.join(now, "dst"), edges.join(now, "dst", "left_anti").dropDuplicates(["src", "line", "specifier"])


def short_cycles(edges: DataFrame) -> DataFrame:
    """All simple cycles of two or three nodes, each once, from its smallest node: ``nodes, length``."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    up = e.where("src < dst")
    two = up.join(e.select(F.col("src").alias("b"), F.col("dst").alias("a")), (F.col("dst") == F.col("b")) & (F.col("src") == F.col("a"))).select(F.array("src", "dst").alias("nodes"))
    mid = up.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("c > a")
    three = mid.join(e.select(F.col("src").alias("c"), F.col("dst").alias("a")), ["c", "a"]).select(F.array("a", "b", "c").alias("nodes"))
    return two.union(three).withColumn("length", F.size("nodes"))


def layer_hubs(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """The most imported node of each layer ``(node, layer)``, smallest on ties."""
    fan = edges.groupBy("dst").agg(F.countDistinct("src").alias("fan_in"))
    known = fan.join(layers, fan["dst"] == layers["node"]).groupBy("layer")
    return known.agg(F.max_by("node", F.struct("fan_in", -F.col("node"))).alias("hub"), F.max("fan_in").alias("fan_in"), F.count("*").alias("files"))


def corroborated(anchors: DataFrame, edges: DataFrame, companions: DataFrame) -> DataFrame:
    """Anchors that import a companion: anchor, and how many companions."""
    hit = edges.join(anchors.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(companions.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    return hit.groupBy("src").agg(F.countDistinct("dst").alias("companions"))


def caller_coverage(edges: DataFrame, results: DataFrame) -> DataFrame:
    """How many distinct importers the results have, and how many of these are results."""
    callers = edges.join(results.select(F.col("node").alias("dst")), "dst", "left_semi").select("src").distinct()
    covered = callers.join(results.select(F.col("node").alias("src"), F.lit(1).alias("own")).distinct(), "src", "left")
    return covered.agg(F.count("*").alias("total"), F.count("own").alias("covered"))
