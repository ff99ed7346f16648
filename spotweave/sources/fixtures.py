"""Domain tables derived from the generic warehouse tables by integer arithmetic.

Every function takes ``(spark, sf_dir)`` and returns a lazy table; the shapes are the ones a
deployment would read from its own Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.operators.skew import pick_by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(spark: SparkSession, d: str, name: str) -> Column:
    """Number of rows of a table, as a scalar of the plan."""
    return table(spark, d, name).agg(F.count("*").alias("n")).select("n").scalar()


def _stretch(job: str) -> str:
    return f"CASE {job} % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END"


_EVENT_MS = ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', "
             "CAST(ts AS TIMESTAMP_NTZ)) DIV 3600000")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the users, and those of the customers of one market segment, most of which have no event."""
    silent = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    return (table(spark, d, "events").select(F.col("user_id").alias("job_id")).unionByName(silent).distinct()
            .selectExpr("job_id", f"720000L * {_stretch('job_id')} AS duration_ms",
                        "1280 AS width", "720 AS height", "1 AS fps"))


def transcript(spark: SparkSession, d: str) -> DataFrame:
    vec = (F.col("seg_id") % size_of(spark, d, "embeddings")).alias("vec_id")
    return transcript_of(table(spark, d, "events")).select("job_id", "seg_id", "start_ms", "end_ms", vec, "text")


def transcript_of(events: DataFrame) -> DataFrame:
    """Transcript segments without their vectors, from the events table or a stream of it."""
    return (events
            .selectExpr("user_id AS job_id", "event_id AS seg_id",
                        f"({_EVENT_MS}) * {_stretch('user_id')} AS start_ms", "event_type AS text")
            .selectExpr("job_id", "seg_id", "start_ms",
                        "start_ms + 1000 + (seg_id * 37) % 7000 AS end_ms", "text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def frames_raw(spark: SparkSession, d: str) -> DataFrame:
    frame = f"(l_partkey % 720) * {_stretch('l_suppkey')}"
    return table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS job_id", f"{frame} AS frame_index", f"{frame} * 1000 AS ts_ms",
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        "CAST((l_orderkey % 2) * 640 AS INT) AS safe_x",
        "86 + (CAST(l_quantity AS INT) % 5) * 80 AS safe_y",
        "320 + (l_linenumber % 4) * 107 AS safe_w",
        "576 - (CAST(l_quantity AS INT) % 5) * 80 AS safe_h",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) * 800 END AS density_e4",
        "CASE l_returnflag WHEN 'A' THEN 'bottle, cup' WHEN 'R' THEN 'tv' ELSE '' END AS objects")


FRAME_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def frames(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every frame by its first line item: job_id, frame_index, ts_ms and ``columns``, or all; no others are moved."""
    columns = columns or ("safe_x", "safe_y", "safe_w", "safe_h", "density_e4", "objects")
    first = frames_raw(spark, d).groupBy("job_id", "frame_index").agg(
        F.min_by(F.struct(*columns), F.struct(*FRAME_ORDER)).alias("_row"))
    return first.select("job_id", "frame_index", (F.col("frame_index") * 1000).alias("ts_ms"), "_row.*")


def frame_times(spark: SparkSession, d: str) -> DataFrame:
    """job_id, frame_index and ts_ms of every frame."""
    return frames_raw(spark, d).select("job_id", "frame_index", "ts_ms").distinct()


def silence(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "orders")
            .selectExpr("o_custkey AS job_id", "o_orderkey",
                        f"((o_orderkey * 7919) % 720000) * {_stretch('o_custkey')} AS start_ms")
            .selectExpr("job_id", "start_ms", "start_ms + 500 + o_orderkey % 5000 AS end_ms"))


def ads(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "part").withColumn("vec", F.col("p_partkey") % size_of(spark, d, "embeddings")).selectExpr(
        "concat('ad_', CAST(p_partkey AS STRING)) AS ad_id", "p_name AS ad_name",
        "CASE WHEN p_partkey % 3 = 0 THEN 'video_clip' ELSE 'banner' END AS ad_type",
        "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 5000 + p_size * 500 "
        "ELSE 10000 END AS duration_ms",
        "p_type AS ad_category", "split(p_name, ' ') AS ad_category_path",
        "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 290 WHEN 2 THEN 340 ELSE 500 END AS width",
        "250 AS height", "vec AS tgt_vec",
        "concat('C:\\\\ads\\\\', p_name, ' ', CAST(p_partkey AS STRING), "
        "CASE WHEN p_partkey % 3 = 0 THEN '.mp4' ELSE '.jpg' END) AS resource_path"))


def category_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vector id of each ad category: the lowest ad carrying it."""
    return ads(spark, d).groupBy("ad_category").agg(F.min("tgt_vec").alias("cat_vec"))


def ce_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scored (scene, ad) pairs; ads repeat over scenes and scenes over ads. ``ad_no`` is the number in ``ad_id``."""
    ad = F.col("o_orderkey") % size_of(spark, d, "part")
    rows = table(spark, d, "orders").withColumn("ad_no", ad).selectExpr(
        "o_custkey AS scene_id", "concat('ad_', CAST(ad_no AS STRING)) AS ad_id", "ad_no", "(o_orderkey * 7919) % 101 AS score_pct",
        "(o_orderkey * 104729) % 1009 AS model_score_i", "o_orderkey")
    return pick_by(rows, ["scene_id", "ad_id"], [F.col("o_orderkey")]).drop("o_orderkey")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("ad", F.col("o_orderkey") % size_of(spark, d, "part")).selectExpr(
        "o_orderkey AS decision_id", "o_custkey AS job_id", "concat('ad_', CAST(ad AS STRING)) AS ad_id",
        f"((o_orderkey * 7919) % 720000) * {_stretch('o_custkey')} AS start_ms",
        "5000 + (o_orderkey % 11) * 1000 AS duration_ms", "20 + o_orderkey % 80 AS score",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 31) % 1000 END AS similarity_e3",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 17) % 1280 END AS x",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 29) % 720 END AS y",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey * 7) % 500 END AS w",
        "CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 100 + (o_orderkey * 11) % 400 END AS h",
        "o_orderkey % 60 * 500 + 1000 AS scene_ms", "(o_orderkey * 13) % 6000 AS density_e4")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr(
        "doc_id AS decision_id",
        "CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS label")


def playback(spark: SparkSession, d: str) -> DataFrame:
    return playback_of(table(spark, d, "events"))


def playback_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id AS viewer_id",
        "event_id % 100 AS job_id", "(event_id * 7919) % 720000 AS pos_ms")


def narratives(spark: SparkSession, d: str) -> DataFrame:
    """Context texts by narrative id (whole texts)."""
    return table(spark, d, "documents").selectExpr("doc_id AS narrative_id", "text")


def desires(spark: SparkSession, d: str) -> DataFrame:
    """Desire vector of three quarters of the context vectors."""
    wish = (F.col("ctx_vec") * 7 + 3) % size_of(spark, d, "embeddings")
    return (table(spark, d, "embeddings").select(F.col("vec_id").alias("ctx_vec")).filter("ctx_vec % 4 <> 0")
            .select("ctx_vec", wish.alias("desire_vec")))


def narrative_ids(spark: SparkSession, d: str) -> DataFrame:
    """Narrative text of every context or desire vector."""
    text = F.col("vec_id") % size_of(spark, d, "documents")
    return table(spark, d, "embeddings").select("vec_id", text.alias("narrative_id"))


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Model scores of some (context, ad) pairs; most pairs have none."""
    vec = F.col("l_orderkey") % size_of(spark, d, "embeddings")
    return (table(spark, d, "lineitem").select(
        vec.alias("ctx_vec"), F.concat(F.lit("ad_"), F.col("l_partkey").cast("string")).alias("ad_id"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1009).alias("points"))
        .groupBy("ctx_vec", "ad_id").agg((F.max("points") / 1009).alias("pair_score")))


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Detected boxes: one per line item, on its frame."""
    cls = "element_at(array(39, 41, 62, 0, 16, 2), CAST(l_partkey % 6 AS INT) + 1)"
    name = "element_at(array('bottle', 'cup', 'tv', 'person', 'dog', 'car'), CAST(l_partkey % 6 AS INT) + 1)"
    frame = f"(l_partkey % 720) * {_stretch('l_suppkey')}"
    return table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS job_id", f"{frame} AS frame_index", f"{cls} AS class_id", f"{name} AS class_name",
        "CAST(20 + (l_orderkey * 7 + l_linenumber * 13) % 80 AS INT) AS confidence_pct",
        "CAST((l_orderkey * 37) % 1300 AS INT) - 60 AS x1",
        "CAST((l_orderkey * 53) % 720 AS INT) - 40 AS y1",
        "CAST((l_orderkey * 37) % 1300 + 40 + CAST(l_quantity AS INT) * 9 AS INT) - 60 AS x2",
        "CAST((l_orderkey * 53) % 720 + 30 + CAST(l_quantity AS INT) * 7 AS INT) - 40 AS y2")


def frame_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signal of every frame that has detections, by number: one of the shared signals in turn."""
    frames = detections(spark, d).select("job_id", "frame_index").distinct()
    return frames.withColumn("signal_id", (F.col("frame_index") * 13 + F.col("job_id")) % size_of(spark, d, "embeddings"))


def shared_signals(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).selectExpr("vec_id AS signal_id", "transform(embedding, x -> x * 255D) AS signal")


def job_files(spark: SparkSession, d: str) -> DataFrame:
    """Job history: one row per order, status from the order status."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS job_id",
        "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'analysing' END AS status",
        "concat(CASE o_orderkey % 2 WHEN 0 THEN 'D:\\\\vod\\\\' ELSE '/srv/vod/' END, "
        "CASE o_orderkey % 5 WHEN 0 THEN 'SampleVideo_' ELSE 'show ' END, "
        "CAST(o_custkey AS STRING), '.E', CAST(o_orderkey AS STRING), '.mp4') AS video_path",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) AS updated_at")


FIXTURE_SAFETY_WORDS = ("reing", "attion")
FIXTURE_GATE_TAG = "ring"
FIXTURE_GATE_WORDS = ("anon",)
