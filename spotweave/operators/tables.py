"""Table maintenance expressed as whole-table rewrites (Parquet has no row updates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators.skew import pick_by


def timeline(frames: DataFrame, silence: DataFrame, transcript: DataFrame,
             job_ids: Sequence[int] | None = None) -> DataFrame:
    """Everything known about the jobs' timelines, in seconds, in time order; blank speech dropped."""
    def seconds(col: str) -> str:
        return f"round({col} / 1000D, 3)"

    parts = (frames.selectExpr("job_id", "'frame' AS kind", f"{seconds('ts_ms')} AS start_sec",
                               f"{seconds('ts_ms')} AS end_sec", "objects AS label")
             .unionByName(silence.selectExpr("job_id", "'silence' AS kind", f"{seconds('start_ms')} AS start_sec",
                                             f"{seconds('end_ms')} AS end_sec", "'' AS label"))
             .unionByName(transcript.filter("trim(text) <> ''").selectExpr(
                 "job_id", "'speech' AS kind", f"{seconds('start_ms')} AS start_sec",
                 f"{seconds('end_ms')} AS end_sec", "trim(text) AS label")))
    if job_ids is not None:
        parts = parts.filter(F.col("job_id").isin(list(job_ids)))
    return parts.orderBy("job_id", "start_sec")


def replace_jobs(target: DataFrame, batch: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Target after deleting the rows of the rerun jobs and inserting the batch.

    ``jobs`` lists them when a rerun may have produced nothing.
    """
    rerun = (batch if jobs is None else jobs).select("job_id").distinct()
    return target.join(rerun, "job_id", "left_anti").unionByName(batch)


def insert_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Target plus the first batch row of every natural key it does not hold yet."""
    first = pick_by(batch, keys, order)
    return target.unionByName(first.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column],
           keep: Sequence[str] = ()) -> DataFrame:
    """Target with the batch applied in ``order``: the last batch row of a key wins.

    Columns in ``keep`` retain the target's value when the key already existed.
    """
    latest = pick_by(batch, keys, order, last=True).withColumn("_new", F.lit(True))
    merged = target.withColumn("_old", F.lit(True)).alias("t").join(latest.alias("b"), list(keys), "full")

    def pick(name: str) -> Column:
        old, new = F.col(f"t.{name}"), F.col(f"b.{name}")
        if name in keep:
            return F.when(F.col("t._old"), old).otherwise(new).alias(name)
        return F.when(F.col("b._new"), new).otherwise(old).alias(name)

    return merged.select(*[F.col(c) if c in keys else pick(c) for c in target.columns])


def update_cols(target: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Target with ``cols`` overwritten (also by NULL) where the patch has the key."""
    hit = patch.select(*keys, F.struct(*cols).alias("_patch"))
    joined = target.join(hit, list(keys), "left")
    return joined.select(*[F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{c}")).otherwise(F.col(c)).alias(c)
                           if c in cols else F.col(c) for c in target.columns])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the lowest id per natural key."""
    return pick_by(df, keys, [F.col(c) for c in order])


def pending_jobs(jobs: DataFrame, outputs: DataFrame, done: str | None = None) -> DataFrame:
    """Jobs without any output row (or without one for which ``done`` holds)."""
    finished = outputs.filter(done) if done else outputs
    return jobs.join(finished.select("job_id").distinct(), "job_id", "left_anti")


def pending_rows(rows: DataFrame, key: str, filled: str, force: bool = False, start: int | str | None = None) -> DataFrame:
    """Rows to work on, in key order: those whose ``filled`` column is NULL or empty; with ``force`` all rows, from ``start`` on."""
    if not force:
        rows = rows.filter(F.col(filled).isNull() | (F.col(filled) == ""))
    elif start is not None:
        rows = rows.filter(F.col(key) >= start)
    return rows.orderBy(key)
