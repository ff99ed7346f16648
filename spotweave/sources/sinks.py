"""Writers: training export, evaluation report, runs that replace their jobs' rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.settings import TRAINING_COLUMNS


def export_training(features: DataFrame, path: str, min_count: int = 30) -> dict[int, int] | None:
    """Write the training table as CSV with header unless there are too few rows.

    Returns the label distribution, or None when nothing was written.
    """
    counts = features.groupBy("label").agg(F.count("*").alias("n")).filter("label IN (-1, 0, 1)").collect()
    found = {row["label"]: row["n"] for row in counts}
    if sum(found.values()) < min_count:
        return None
    features.select(*TRAINING_COLUMNS).write.mode("overwrite").csv(path, header=True)
    return {label: found.get(label, 0) for label in (-1, 0, 1)}


def write_report(metrics: DataFrame, path: str) -> None:
    """Write evaluation metrics (a handful of rows) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


RUN_PARTS = 64


def write_run(rows: DataFrame, jobs: DataFrame, path: str, run: int, parts: int = RUN_PARTS) -> None:
    """Record the rows of a run and the jobs it was for, also those that got no row; writing a run again replaces it.

    ``run`` numbers grow. Every call writes folders of its own and touches none that are there: the rows, dealt into ``parts`` by a
    hash of the job, the list of jobs, and last one file with a single row that makes the call count. A call that fails before
    leaves what readers see as it was. Of several calls for one run the last one counts (by the clock of the writer).
    """
    place = f"run={run}/commit={time.time_ns()}"
    part = F.pmod(F.xxhash64("job_id"), F.lit(parts)).cast("int")
    # Rows of one part come together, but for those of a crowded one, which adaptive execution splits.
    rows.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/rows/{place}")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/rows/{place}/part=-1")  # the columns, for a run without rows
    jobs.select("job_id").distinct().withColumn("part", part).write.parquet(f"{path}/jobs/{place}")
    rows.sparkSession.range(1, numPartitions=1).select(F.lit(parts).alias("parts")).write.parquet(f"{path}/commits/{place}")


def read_runs(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """The rows of each job's latest run: nothing where that run gave the job nothing.

    With ``only`` (job_id) just those jobs; the folders of other parts are not read.
    """
    def table(name: str) -> DataFrame:
        return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")

    commits = table("commits").groupBy("run").agg(F.max("commit").alias("commit"))
    listed = table("jobs").join(commits, ["run", "commit"], "left_semi")
    if only is not None:
        listed = listed.join(only.select("job_id").distinct(), "job_id", "left_semi")
    latest = listed.groupBy("job_id", "part").agg(F.max(F.struct("run", "commit")).alias("at")).select("job_id", "part", "at.*")
    return table("rows").join(latest, ["job_id", "run", "commit", "part"], "left_semi").drop("run", "commit", "part")
