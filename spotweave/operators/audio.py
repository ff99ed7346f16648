"""Loudness per hop and silence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.ordered import running_total, span_chunk, with_previous


def rms_levels(samples: DataFrame, sample_rate: int, window_ms: int = 25, hop_ms: int = 10) -> DataFrame:
    """RMS per hop of centred windows over (job_id, i, x); the signal counts as zero outside."""
    length, hop = sample_rate * window_ms // 1000, sample_rate * hop_ms // 1000
    half = length // 2
    sizes = samples.groupBy("job_id").agg((F.max("i") + 1).alias("_n"))
    rows = samples.join(sizes, "job_id")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") + half - length + 1) / hop).cast("long"))
    last = F.least(F.floor(F.col("_n") / hop).cast("long"), F.floor((F.col("i") + half) / hop).cast("long"))
    ticks = rows.select("job_id", "x", first.alias("_first"), last.alias("_last")).filter("_first <= _last")
    ticks = ticks.select("job_id", "x", F.explode(F.sequence("_first", "_last")).alias("tick"))
    return ticks.groupBy("job_id", "tick").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / length).alias("rms"))


def silence_intervals(levels: DataFrame, tracks: DataFrame, hop_ms: int = 10, threshold_db: float = -40.0,
                      min_ms: int = 1000, floor: float = 1e-5, chunk_ticks: int = 60_000) -> DataFrame:
    """Runs of hops quieter than the threshold relative to the job's loudest hop.

    ``levels``: job_id, tick (contiguous from 0), rms. ``tracks``: job_id, track_ms. A run still
    open at the last hop lasts to the end of the track.
    """
    stats = levels.groupBy("job_id").agg(F.max("rms").alias("_loudest"), F.max("tick").alias("_last_tick"))
    rows = levels.join(stats, "job_id")
    limit = F.greatest(F.col("_loudest"), F.lit(floor)) * (10.0 ** (threshold_db / 20.0))
    silent = rows.filter(F.greatest(F.col("rms"), F.lit(floor)) < limit).select("job_id", "tick", "_last_tick")
    chunk = span_chunk("tick", chunk_ticks)
    marked = with_previous(silent, ["job_id"], chunk, ["tick"], ["tick"])
    opens = F.coalesce(F.col("tick") - F.col("prev_tick") > 1, F.lit(True)).cast("long")
    islands = running_total(marked, ["job_id"], chunk, ["tick"], opens, "island")
    runs = islands.groupBy("job_id", "island").agg(
        F.min("tick").alias("_from"), F.max("tick").alias("_to"), F.max("_last_tick").alias("_last_tick"))
    runs = runs.join(tracks, "job_id", "left")
    end = F.when(F.col("_to") == F.col("_last_tick"), F.col("track_ms")).otherwise((F.col("_to") + 1) * hop_ms)
    return (runs.select("job_id", (F.col("_from") * hop_ms).alias("start_ms"), end.cast("long").alias("end_ms"))
            .filter(F.col("end_ms") - F.col("start_ms") >= min_ms))
