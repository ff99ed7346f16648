"""Building blocks that keep work spread when one key holds a large share of the rows.

Lookups (many rows to a table with one row per key) are plain joins: small tables are broadcast by their
measured size, and adaptive execution splits the partition of a hot key and copies its one matching row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def pick_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """Keep the first (or last) whole row per key; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def take_smallest(df: DataFrame, size: Column, major: str, *minor: str) -> DataFrame:
    """The ``size`` smallest rows by (major, minor) without sorting everything in one place.

    ``major`` is a bounded integer hash. A histogram over it finds the value at which the
    quota is reached; only the rows of that single value are ranked.
    """
    histogram = df.groupBy(major).agg(F.count("*").alias("_n"))
    running = histogram.select(
        F.col(major).alias("_cut"), "_n",
        F.sum("_n").over(Window.orderBy(major)).alias("_upto"))
    edge = (running.filter(F.col("_upto") >= size)
            .agg(F.min(F.struct("_cut", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_edge")))
    found = edge.select("_edge").scalar()
    cut = F.coalesce(found["_cut"], F.lit(2**62))
    before = F.coalesce(found["_before"], F.lit(0))
    below = df.filter(F.col(major) < cut)
    at_cut = (df.filter(F.col(major) == cut)
              .withColumn("_rank", F.row_number().over(Window.partitionBy(major).orderBy(*minor)))
              .filter(F.col("_rank") <= size - before).drop("_rank"))
    return below.unionByName(at_cut)


def shuffle_hash(seed: int, *ids: Column) -> Column:
    """Stand-in for a random draw from ids of any type: reproducible and bounded below 1,000,003."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in ids]))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(1_000_003))
