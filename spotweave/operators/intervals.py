"""Range joins inside a group on levels of bucket widths.

A span lives on the level whose buckets are about as wide as it is long, so it is copied a few times however long it is, and
joins hash on (group, level, bucket). A point or a shorter span looks at its bucket on each coarser level that occurs on the other
side of its group; where that side has no spans it is dropped before it is copied. Adaptive execution splits a crowded bucket like any hot key of a plain join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_MS = 30_000  # buckets of the lowest level
GROWTH = 4  # buckets of a level are so many times as wide as those below
LONGEST = 4  # a span is at most so many buckets of its level long


def _level(start: str, end: str, bucket_ms: int) -> Column:
    ratio = (F.col(end) - F.col(start)) / F.lit(float(LONGEST * bucket_ms))
    return F.greatest(F.lit(0), F.ceil(F.log(float(GROWTH), F.greatest(ratio, F.lit(1.0))))).cast("int")


def _bucket(at: str, level: Column, bucket_ms: int) -> Column:
    return F.floor(F.col(at) / (F.lit(bucket_ms) * F.pow(F.lit(GROWTH), level))).cast("long")


def _levelled(spans: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    return spans.filter(F.col(end) >= F.col(start)).withColumn("_own", _level(start, end, bucket_ms))


def _levels(levelled: DataFrame, on: Sequence[str]) -> DataFrame:
    """The levels that occur in each group: a handful, as each covers spans four times as long as the one below."""
    return levelled.groupBy(*on).agg(F.collect_set("_own").alias("_levels"))


def _copied(side: DataFrame) -> DataFrame:
    """A side whose rows are copies: its size is estimated without them, so it must not be broadcast by way of the driver."""
    return side.hint("merge")


def points_in(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str,
              end_open: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs with ``start <= at <= end`` (or ``< end``). Columns of both sides, names disjoint."""
    placed = _levelled(spans, start, end, bucket_ms)
    left = (points.join(_levels(placed, on), list(on)).withColumn("_own", F.explode("_levels")).drop("_levels")
            .withColumn("_bucket", _bucket(at, F.col("_own"), bucket_ms)))
    right = placed.withColumn("_bucket", F.explode(F.sequence(
        _bucket(start, F.col("_own"), bucket_ms), _bucket(end, F.col("_own"), bucket_ms))))
    inside = F.col(at) < F.col(end) if end_open else F.col(at) <= F.col(end)
    return (left.join(_copied(right), [*on, "_own", "_bucket"])
            .filter((F.col(at) >= F.col(start)) & inside).drop("_own", "_bucket"))


def overlapping(a: DataFrame, b: DataFrame, on: Sequence[str], a_span: tuple[str, str],
                b_span: tuple[str, str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of open-ended overlap: ``a.end > b.start and a.start < b.end``.

    A pair meets on the level of its longer span, and is reported in the first bucket the two share there. ``_at`` holds the level and
    which side is longer (b where both are on one level), so that short spans never meet each other on a coarse level.
    """
    (a_start, a_end), (b_start, b_end) = a_span, b_span
    left, right = _levelled(a, a_start, a_end, bucket_ms), _levelled(b, b_start, b_end, bucket_ms)

    def bucket(at: str) -> Column:
        return _bucket(at, F.floor(F.col("_at") / 2), bucket_ms)

    def spread(df: DataFrame, others: DataFrame, start: str, end: str, side: int) -> DataFrame:
        """Copies on its own level as the longer one, where the other side has shorter ones, and on the coarser levels of the other side as the shorter one."""
        def shorter(n: Column) -> Column:
            return n <= F.col("_own") if side else n < F.col("_own")

        own = F.when(F.exists("_levels", shorter), F.array(F.col("_own") * 2 + side)).otherwise(F.array().cast("array<int>"))
        coarser = F.transform(F.filter("_levels", lambda n: ~shorter(n)), lambda n: n * 2 + (1 - side))
        copies = df.join(_levels(others, on), list(on)).withColumn("_at", F.explode(F.concat(own, coarser))).drop("_levels", "_own")
        return copies.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))

    met = spread(left, right, a_start, a_end, 0).join(
        _copied(spread(right, left, b_start, b_end, 1)), [*on, "_at", "_bucket"])
    return (met.filter((F.col(a_end) > F.col(b_start)) & (F.col(a_start) < F.col(b_end))
                       & (F.col("_bucket") == F.greatest(bucket(a_start), bucket(b_start))))
            .drop("_at", "_bucket"))
