"""Connected components of a link table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.session import stage

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for every linked node the smallest node it can reach.

    ``links`` has two long columns u and v; order, repeats, self links and nulls do not matter.
    Alternating star contraction: each round points the neighbours of a node at the smallest of them,
    first upwards (larger neighbours), then downwards. Minima combine before the shuffle, so a node
    with very many links costs one row per task. Every round is a written table in the shared folder.
    Nodes without a link to another node are not returned.
    """
    edges = stage(links.filter(F.col("u") != F.col("v"))
                  .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), name)
    before = _digest(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join below has a plain shuffle on either side and the links of a node with very many can be split.
        lowest = stage(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), name)
        large = (both.join(lowest, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(lower, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(lower.select("a", F.col("low").alias("b"))).distinct())
        edges = stage(small, name)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
