"""Connected components over DataFrames.

Each round maps every node to the neighbour (or itself) with the least hash and replaces the
edges by the edges between those images, until none is left. Node counts shrink by a constant
share a round, also on long chains, because the order of hashes is random in the ids. Every
round is written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.shared import run_folder, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): all nodes of ``edges`` (a, b) with a node that all of their component
    share. Loops, repeated edges and either direction do no harm; null ends are left out."""
    spark = edges.sparkSession
    folder = run_folder(spark, "components")
    left = staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                  .where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL").distinct(), folder, "edges-0")
    maps: list[DataFrame] = []
    while True:
        k = len(maps)
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("p"))
        both = left.select(F.col("a").alias("node"), rank("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), rank("a").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("to"))
        step = staged(least.select("node", F.least("to", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("p")))["p"]
                                   .alias("image")), folder, f"map-{k}")
        maps.append(step)
        left = staged(
            left.join(step.select(F.col("node").alias("a"), F.col("image").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("image").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            folder, f"edges-{k + 1}")
        if left.isEmpty():
            break

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        on = later.select(F.col("node").alias("image"), "root")
        return earlier.join(on, "image", "left").select("node", F.coalesce("root", "image").alias("root"))

    return reduce(compose, reversed(maps[:-1]), maps[-1].select("node", F.col("image").alias("root")))
