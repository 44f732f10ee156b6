"""Connected components of a pair table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.skew import lookup_join
from shelfmark.session import shared_folder

#: Up to so many edges stay in one partition, and their minima are broadcast, so a round needs no shuffle.
FEW = 50_000


def _held(rows: DataFrame, few: bool) -> DataFrame:
    return rows.coalesce(1) if few else rows


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(node, smallest) over each node and its neighbours, map-side combined."""
    return (edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            .withColumn("m", F.least("m", "u")))


def _with_minimum(edges: DataFrame, lowest: DataFrame, few: bool) -> DataFrame:
    if few:
        return edges.join(F.broadcast(lowest), "u")
    return lookup_join(edges, lowest, ["u"], "n", "inner", salt_on=["u", "v"])


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = _held(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    joined = _with_minimum(both, _neighbour_minimum(both), few)
    return (joined.filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _neighbour_minimum(down)
    joined = _with_minimum(down, lowest, few)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lowest.select("u", F.col("m").alias("v"))
    return _held(moved.unionByName(own), few).filter("u <> v").distinct()


def connected_components(pairs: DataFrame, left: str, right: str,
                         max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``pairs``; root is the smallest node reached.

    Each round is a few shuffles over the edges and roughly halves long chains,
    so chains settle in a logarithmic number of rounds. Up to ``FEW`` edges take
    the same rounds in one partition, without shuffles: a round has a dozen of them, each of
    which leaves files for every pair of partitions, however few the edges. Each round is cut with a
    reliable checkpoint; the stop test brings one row of two numbers to the driver.
    """
    shared_folder(pairs.sparkSession)
    nodes = (pairs.select(F.col(left).alias("node"))
             .unionByName(pairs.select(F.col(right).alias("node"))).distinct())
    edges = (pairs.select(F.col(left).alias("u"), F.col(right).alias("v"))
             .filter("u <> v").distinct().checkpoint())
    # No round adds edges.
    few = edges.count() <= FEW
    edges, previous = _held(edges, few), None
    for _ in range(max_rounds):
        edges = _held(_small_star(_large_star(edges, few), few).checkpoint(), few)
        state = edges.agg(F.count("*").alias("n"),
                          F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2_147_483_647))).alias("h")).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select(
        "node", F.coalesce("root", "node").alias("root"))
