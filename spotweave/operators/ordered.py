"""Order-dependent steps (lag, running counts, islands) over groups of any length.

A plain window over a group would put the whole group into one task. Here each group is cut
into chunks along its order; windows run per chunk, and only one summary row per chunk
takes part in the group-wide step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunks(df: DataFrame, group: Sequence[str], summary: Sequence[Column]) -> DataFrame:
    return df.groupBy(*group, "_chunk").agg(*summary)


def with_previous(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str],
                  carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<col>`` for every carried column: its value in the preceding row."""
    rows = df.withColumn("_chunk", chunk)
    carried = F.struct(*[F.col(c) for c in carry])
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    tails = _chunks(rows, group, [F.max_by(carried, F.struct(*order)).alias("_tail")])
    heads = tails.select(
        *group, "_chunk",
        F.lag("_tail").over(Window.partitionBy(*group).orderBy("_chunk")).alias("_before"))
    joined = (rows.withColumn("_prev", F.lag(carried).over(inside))
              .join(heads, [*group, "_chunk"], "left")
              .withColumn("_prev", F.coalesce("_prev", "_before")))
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in carry])


def running_total(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str],
                  value: Column, name: str) -> DataFrame:
    """Add the running sum of an integer expression over the group's order."""
    return running_totals(df, group, chunk, order, {name: value})


def running_totals(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str],
                   values: Mapping[str, Column]) -> DataFrame:
    """Add several running sums at once, by the name of their column."""
    rows = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = (Window.partitionBy(*group, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = (Window.partitionBy(*group).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = _chunks(rows, group, [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values]).select(
        *group, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values])
    joined = (rows.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
              .join(offsets, [*group, "_chunk"], "left"))
    return joined.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def running_max_before(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[str],
                       value: str, name: str) -> DataFrame:
    """Add the largest value among all preceding rows of the group (NULL for the first)."""
    rows = df.withColumn("_chunk", chunk)
    inside = (Window.partitionBy(*group, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = (Window.partitionBy(*group).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    tops = _chunks(rows, group, [F.max(value).alias("_max")]).select(
        *group, "_chunk", F.max("_max").over(earlier).alias("_before"))
    joined = (rows.withColumn("_inside", F.max(value).over(inside))
              .join(tops, [*group, "_chunk"], "left"))
    return joined.select(*df.columns, F.greatest("_inside", "_before").alias(name))


def span_chunk(col: str, width: int) -> Column:
    """Chunk number of an integer position."""
    return F.floor(F.col(col) / F.lit(width)).cast("long")
