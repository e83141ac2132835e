"""Connected components of a distributed edge list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotcurve.scratch import stored

MAX_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) of the nodes of edges (a, b).

    Alternates large-star and small-star contraction; both keep the components
    and bring every node closer to its smallest. The rounds needed grow with
    the logarithm of the longest chain. A round is two aggregations by node, of
    which the smallest neighbour is pre-aggregated; no list of neighbours is
    built. Each round's edges are stored, so a lost executor costs one round."""
    edges = stored(_ordered(edges.select("a", "b")), "component-edges")
    for _ in range(MAX_ROUNDS):
        large = stored(_ordered(_large_star(edges)), "component-edges")
        small = stored(_ordered(_small_star(large)), "component-edges")
        # stars: a star centre is never the larger end of an edge
        roots = small.select("b").join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        again = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        edges = small
        if roots.isEmpty() and again.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(centres)


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with a > b."""
    return edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    # every larger neighbour of a node joins the node's smallest neighbour
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return edges.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # a node and its smaller neighbours join the smallest of them
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b")))
