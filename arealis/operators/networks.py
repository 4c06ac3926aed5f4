"""Graphs as edge tables: least spanning forests by rounds, components, the band that connects, digests of weights.

Nothing here holds a graph in one place. A round is some joins and aggregates with partial results in each task, and is
written to the shared folder, so that plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written
from .resample import draw


def _apart(df: DataFrame) -> DataFrame:
    """df for a join by shuffles: tables that grow with the graph never go through the driver as broadcasts, however small a round makes them."""
    return df.hint("merge")


def spanning_forest(nodes: DataFrame, key: str, edges: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(tree, labels): the least spanning forest of undirected edges (src, dst, w), and (key, component) of every node.

    Rounds after Borůvka: each component takes its least edge to another, told apart by weight and ends, so that no
    cycle can come about; components that hang together are named by their smallest node, found by doubling of parents. Each round
    halves the number of components that can still grow. Edges to a node itself and ends that are no nodes are left out.
    """
    labels = written(nodes.select(F.col(key).alias("node"), F.col(key).alias("component")).distinct(), "labels")
    ends = lambda e: e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src < dst")
    left = ends(edges).groupBy("src", "dst").agg(F.min("w").alias("w"))
    of = lambda c: _apart(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c")))
    left = written(left.join(of("src"), "src").join(of("dst"), "dst"), "edges")
    tree = None
    for _ in range(most_rounds):
        least = F.min(F.struct("w", "src", "dst", "other")).alias("e")
        both = left.select(F.col("src_c").alias("c"), F.col("dst_c").alias("other"), "w", "src", "dst").union(left.select(F.col("dst_c"), F.col("src_c"), "w", "src", "dst"))
        taken = written(both.groupBy("c").agg(least).select("c", "e.*"), "taken")
        if taken.isEmpty():
            break
        found = taken.select("src", "dst", "w").distinct()
        tree = found if tree is None else tree.unionByName(found)
        # two components that take the same edge point at each other: the smaller becomes the root
        back = taken.select(F.col("c").alias("other"), F.col("other").alias("c_back"))
        parent = taken.join(_apart(back), "other").select(F.col("c").alias("node"), F.when((F.col("c_back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("parent"))
        parent = written(parent, "parents")
        while True:  # each doubling halves the distance to the root
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            further = written(parent.join(_apart(up), "parent").select("node", F.col("above").alias("parent")), "parents")
            moved = not further.join(_apart(parent.withColumnRenamed("parent", "before")), "node").where("parent <> before").isEmpty()
            parent = further
            if not moved:
                break
        # name each new component by its smallest member
        names = parent.groupBy("parent").agg(F.least(F.min("node"), F.col("parent")).alias("name")).select(F.col("parent"), "name")
        renamed = written(parent.join(_apart(names), "parent").select(F.col("node").alias("component"), "name"), "renamed")
        labels = written(labels.join(_apart(renamed), "component", "left").select("node", F.coalesce("name", "component").alias("component")), "labels")
        again = lambda c: _apart(renamed.select(F.col("component").alias(f"{c}_c"), F.col("name").alias(f"{c}_n")))
        left = left.join(again("src"), "src_c").join(again("dst"), "dst_c").where("src_n <> dst_n")
        # between two components only the least edge can be taken
        pair = F.least("src_n", "dst_n").alias("p"), F.greatest("src_n", "dst_n").alias("q")
        left = left.groupBy(*pair).agg(F.min(F.struct("w", "src", "dst", "src_n", "dst_n")).alias("e"))
        left = written(left.select("e.src", "e.dst", "e.w", F.col("e.src_n").alias("src_c"), F.col("e.dst_n").alias("dst_c")), "edges")
    else:
        raise RuntimeError(f"a spanning forest did not settle in {most_rounds} rounds")
    if tree is None:
        tree = left.select("src", "dst", "w")
    return tree, labels.select(F.col("node").alias(key), "component")


def components(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, component): the smallest node that edges (src, dst) reach."""
    return spanning_forest(nodes, key, edges.select("src", "dst", F.lit(0.0).alias("w")))[1]


def connectivity(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """One row: nodes, components, size of the largest, islands (nodes without an edge), connected."""
    sizes = components(nodes, key, edges).groupBy("component").agg(F.count("*").alias("n"))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(F.col("n") == 1).alias("islands"))
    return out.withColumn("connected", F.col("components") == 1)


def connecting_tree(points: DataFrame, key: str, x: str, y: str, start: float | None = None, most_rounds: int = 60) -> DataFrame:
    """(src, dst, w): the least spanning tree of points by distance; points in one place are never joined to each other.

    Distances are looked at in bands, each twice as wide as the one before, as Kruskal's algorithm would: within a band
    only pairs of different components count, and one of both must lie outside the largest. A band's pairs come from a
    grid of cells of its width. The first is the mean distance of points spread evenly over the bounds. If all points lie
    in one place, or there is one point, the tree has no edges.
    """
    at = written(points.select(F.col(key).alias("node"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    size = at.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count_distinct("x", "y").alias("places")).first()
    if not size.n or size.places < 2:
        return at.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("x").alias("w")).where("false")
    widest = (size.w**2 + size.h**2) ** 0.5
    # an even share of the bounds for each point, or of their longer side where all lie on a line
    band = start or max((size.w * size.h / size.n) ** 0.5, max(size.w, size.h) / size.n)
    labels, trees = at.select("node", F.col("node").alias("component")), []
    for _ in range(most_rounds):
        here = at.join(_apart(labels), "node")
        largest = labels.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "component")).alias("m")).select(F.col("m.component").alias("largest"))
        cell = lambda c: F.floor(F.col(c) / band)
        outside = here.join(F.broadcast(largest)).where("component <> largest").select(F.col("node").alias("src"), F.col("component").alias("src_c"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        outside = outside.withColumn("cx", F.explode(F.sequence(cell("ax") - 1, cell("ax") + 1))).withColumn("cy", F.explode(F.sequence(cell("ay") - 1, cell("ay") + 1)))
        near = here.withColumns({"cx": cell("x"), "cy": cell("y")})
        d = F.sqrt((F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")))
        pairs = outside.join(_apart(near), ["cx", "cy"]).where("src_c <> component").withColumn("w", d).where((F.col("w") <= band) & (F.col("w") > 0))
        # of each two components the least distance, kept with its ends
        least = pairs.groupBy(F.least("src_c", "component").alias("a"), F.greatest("src_c", "component").alias("b")).agg(F.min(F.struct("w", F.least("src", "node").alias("s"), F.greatest("src", "node").alias("d"))).alias("e"))
        between = written(least.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("e.w").alias("w"), "e.s", "e.d"), "band")
        if not between.isEmpty():
            tree, joined = spanning_forest(labels.select("component").distinct(), "component", between)
            trees.append(written(tree.join(_apart(between), ["src", "dst", "w"]).select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"), "tree"))
            joined = joined.toDF("component", "name")
            labels = written(labels.join(_apart(joined), "component").select("node", F.col("name").alias("component")), "labels")
        if band >= widest or labels.select("component").distinct().limit(2).count() < 2:
            break
        band *= 2
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out


def connecting_band(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: threshold, the least distance at which all points hang together, and the tree's edges; null threshold if they never do."""
    tree = connecting_tree(points, key, x, y)
    return tree.agg(F.max("w").alias("longest"), F.count("*").alias("edges")).join(F.broadcast(points.agg(F.count("*").alias("points")))).select(F.when(F.col("edges") == F.col("points") - 1, F.col("longest")).alias("threshold"), "edges", "points")


def weights_checksum(weights: DataFrame) -> DataFrame:
    """One row: edges, and a sum of hashes of (src, dst, weight to 12 digits), the same whatever the order of rows."""
    text = F.format_string("%.12f", F.col("w"))
    return weights.agg(F.count("*").alias("edges"), F.coalesce(F.sum(draw(0, F.col("src"), F.col("dst"), text)), F.lit(0)).alias("checksum"))
