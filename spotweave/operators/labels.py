"""Labelling backlog, leakage-free splits, training sets and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.ordered import running_total
from spotweave.operators.skew import shuffle_hash, take_smallest
from spotweave.session import stage


def training_features(feedback: DataFrame, decisions: DataFrame, ads: DataFrame) -> DataFrame:
    """One training row per feedback on a decision with a known similarity, oldest first."""
    known = decisions.filter("similarity_e3 IS NOT NULL")
    rows = feedback.join(known, "decision_id")
    rows = rows.join(ads.select("ad_id", "ad_type", F.col("duration_ms").alias("_ad_ms")), "ad_id")
    return rows.orderBy("created_at", "decision_id").selectExpr(
        "similarity_e3 / 1000D AS similarity_score", "score AS final_score", "scene_ms / 1000D AS scene_duration_sec",
        "_ad_ms / 1000D AS ad_duration_sec", "density_e4 / 10000D AS avg_density", "ad_type", "label")


def _eligible_labels(labels: DataFrame, ads: DataFrame) -> DataFrame:
    return labels.select("scene_id", "ad_id").join(ads.select("ad_id"), "ad_id", "left_semi").distinct()


def unlabelled_counts(scenes: DataFrame, ads: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelling backlog per scene, by subtraction: pairs are not enumerated (see sampled_pairs)."""
    done = _eligible_labels(labels, ads).groupBy("scene_id").agg(F.count("*").alias("n_labelled"))
    total = ads.agg(F.count("*").alias("n")).select("n").scalar()
    rows = scenes.select("scene_id").join(done, "scene_id", "left").withColumn(
        "n_labelled", F.coalesce("n_labelled", F.lit(0).cast("long")))
    return rows.withColumn("n_unlabelled", total - F.col("n_labelled"))


def sampled_pairs(scenes: DataFrame, ads: DataFrame, labels: DataFrame, per_scene: int, seed: int = 42) -> DataFrame:
    """``per_scene`` unlabelled ads for every scene; all of them if it is large enough.

    Ads are laid out on a ring in hash order and every scene starts at its own hashed position.
    Among the next (per_scene + labels of the scene) places at least ``per_scene`` are
    unlabelled, so only those are produced.
    """
    hashed = ads.select("ad_id", shuffle_hash(seed, F.col("ad_id")).alias("_h")).withColumn("_all", F.lit(0))
    ring = running_total(hashed, ["_all"], F.floor(F.col("_h") / 1000).cast("long"), ["_h", "ad_id"], F.lit(1), "_nth")
    ring = ring.select("ad_id", (F.col("_nth") - 1).alias("_place"))
    size = ads.agg(F.count("*").alias("n")).select("n").scalar()
    done = _eligible_labels(labels, ads)
    counts = done.groupBy("scene_id").agg(F.count("*").alias("_done"))
    starts = scenes.select("scene_id").join(counts, "scene_id", "left").withColumn("_size", size).select(
        "scene_id", "_size", F.pmod(shuffle_hash(seed, F.col("scene_id")), F.col("_size")).alias("_from"),
        F.least(F.col("_size"), F.lit(per_scene) + F.coalesce("_done", F.lit(0))).alias("_span"))
    places = (starts.filter("_span > 0")
              .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_span") - 1)))
              .select("scene_id", "_step", F.pmod(F.col("_from") + F.col("_step"), F.col("_size")).alias("_place")))
    fresh = places.join(ring, "_place").join(done, ["scene_id", "ad_id"], "left_anti")
    order = Window.partitionBy("scene_id").orderBy("_step")
    return (fresh.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= per_scene)
            .select("scene_id", "ad_id", "pick"))


def holdout_size(groups: DataFrame, ratio: float) -> Column:
    """Scalar: the share of the groups, rounded up, at least one."""
    return groups.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * ratio)).alias("n")).select("n").scalar()


def holdout(scenes: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The held-out scene ids among distinct ``scenes`` (scene_id)."""
    hashed = scenes.select("scene_id", shuffle_hash(seed, F.col("scene_id")).alias("_h"))
    return take_smallest(hashed, holdout_size(scenes, ratio), "_h", "scene_id").select("scene_id")


def assign_split(labels: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Fill missing ``split`` per scene; rows that have one keep it."""
    waiting = labels.filter("split IS NULL").select("scene_id").distinct()
    test = holdout(waiting, ratio, seed).withColumn("_test", F.lit(True))
    rows = labels.join(test, "scene_id", "left")
    return rows.withColumn("split", F.coalesce("split", F.when(F.col("_test"), F.lit("test"))
                                               .otherwise(F.lit("train")))).drop("_test")


def training_set(labels: DataFrame, neg_ratio: int = 3, hard: bool = True, seed: int = 42) -> DataFrame:
    """All positives and at most ``neg_ratio`` times as many negatives of the train split.

    ``labels``: scene_id, ad_id, score, label, split, one row per (scene, ad). With ``hard`` ambiguous rows
    up to 0.5 count as negatives. Rows are drawn, not ads: an ad may be drawn for one scene and not for another.
    """
    train = labels.filter("split = 'train'")
    positive = train.filter("label = 'positive'")
    wanted = "label IN ('negative', 'ambiguous') AND score <= 0.5D" if hard else "label = 'negative'"
    negative = train.filter(wanted).withColumn("_h", shuffle_hash(seed, F.col("scene_id"), F.col("ad_id")))
    quota = positive.agg((F.count("*") * neg_ratio).alias("n")).select("n").scalar()
    return positive.unionByName(take_smallest(negative, quota, "_h", "scene_id", "ad_id").drop("_h"))


def _both_sides(labels: DataFrame) -> DataFrame:
    """Scenes having positives and negatives, with their numbers."""
    counts = labels.groupBy("scene_id").agg(F.count(F.when(F.col("positive"), 1)).alias("n_positive"),
                                            F.count(F.when(~F.col("positive"), 1)).alias("n_negative"))
    return counts.filter("n_positive > 0 AND n_negative > 0")


def eval_groups(labels: DataFrame) -> DataFrame:
    """Members of the evaluation queries, one row per (scene, ad): a hot scene stays many rows.

    ``labels``: scene_id, ad_id, positive.
    """
    return labels.join(_both_sides(labels), "scene_id")


def valid_scenes(labels: DataFrame) -> DataFrame:
    return _both_sides(labels).select("scene_id")


def rank_metrics(scored: DataFrame, k: int = 10) -> DataFrame:
    """Mean MRR, P@k and NDCG@k per model over scenes.

    ``scored``: model, scene_id, ad_id, score, relevance, positive. Top-k lists are cut below the
    shuffle; the rank of the first positive is a count of the items ahead of it.
    """
    keys = ["model", "scene_id"]
    by_score = F.struct((-F.col("score")).alias("s"), F.col("ad_id").alias("a"))
    firsts = scored.filter("positive").groupBy(*keys).agg(F.min(by_score).alias("_first"))
    ahead = scored.join(firsts, keys).filter(by_score < F.col("_first"))
    ahead = ahead.groupBy(*keys).agg(F.count("*").alias("_ahead"))

    def top(order: list[Column], *values: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return scored.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*keys).agg(*values)

    gain = F.sum(F.col("relevance") / F.log2(F.col("_r") + 1))
    actual = top([F.desc("score"), F.col("ad_id")], gain.alias("_dcg"), F.sum(F.col("positive").cast("int")).alias("_hits"))
    ideal = top([F.desc("relevance"), F.col("ad_id")], gain.alias("_ideal"))
    scenes = (actual.join(ideal, keys).join(firsts.select(*keys, F.lit(True).alias("_any")), keys, "left")
              .join(ahead, keys, "left"))
    rr = F.when(F.col("_any"), F.lit(1.0) / (F.coalesce("_ahead", F.lit(0)) + 1)).otherwise(F.lit(0.0))
    ndcg = F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(F.lit(0.0))
    return scenes.groupBy("model").agg(
        F.round(F.avg(rr), 4).alias("mrr"), F.round(F.avg(F.col("_hits") / k), 4).alias("precision_at_k"),
        F.round(F.avg(ndcg), 4).alias("ndcg"), F.count("*").alias("n_scenes"))


def metric_deltas(metrics: DataFrame, base: str = "base", tuned: str = "tuned") -> DataFrame:
    """Improvement of the tuned over the base model per metric."""
    names = ("mrr", "precision_at_k", "ndcg")
    long = metrics.select("model", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("model", "m.*")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("model") == base, F.col("value"))).alias("base"),
                                      F.max(F.when(F.col("model") == tuned, F.col("value"))).alias("tuned"))
    return wide.withColumn("improvement", F.round(F.col("tuned") - F.col("base"), 4))


def evaluate_split(labels: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of the test split per model and their improvement, with the number of scenes that count.

    ``labels``: scene_id, ad_id, label, score (the relevance), split; ``scores``: model, scene_id, ad_id, score, one row per model
    and pair. Scenes of the test split with both positives and negatives count; a pair that a model has not scored is not ranked by it.
    """
    test = labels.filter("split = 'test' AND label IN ('positive', 'negative')").select(
        "scene_id", "ad_id", (F.col("label") == "positive").alias("positive"), F.col("score").alias("relevance"))
    members = test.join(valid_scenes(test), "scene_id", "left_semi")
    metrics = stage(rank_metrics(stage(members.join(scores, ["scene_id", "ad_id"]), "split-scores"), k), "split-metrics")
    counted = metrics.agg(F.max("n_scenes").alias("n")).select("n").scalar()
    return metric_deltas(metrics).withColumn("n_scenes", counted)


def score_histogram(labels: DataFrame) -> DataFrame:
    """Ambiguous labels per 0.1 of the score (``score_pct``, half up)."""
    bucket = F.floor((F.col("score_pct") + 5) / 10).cast("long") / 10
    return labels.filter("label = 'ambiguous'").groupBy(bucket.alias("score_bucket")).agg(F.count("*").alias("cnt"))


def relabel_band(labels: DataFrame, low_pct: int = 60, high_pct: int = 70) -> DataFrame:
    """Move ambiguous labels of the band to positive and clear their split and training mark."""
    hit = (F.col("score_pct") >= low_pct) & (F.col("score_pct") < high_pct) & (F.col("label") == "ambiguous")
    return (labels.withColumn("_hit", hit).withColumn("label", F.when(F.col("_hit"), "positive").otherwise(F.col("label")))
            .withColumn("split", F.when(~F.col("_hit"), F.col("split")))
            .withColumn("trained", F.when(~F.col("_hit"), F.col("trained"))).drop("_hit"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    total = df.agg(F.count("*").alias("n")).select("n").scalar()
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def training_run(labels: DataFrame, used: DataFrame) -> DataFrame:
    """Ledger row of a run: rows trained on, rows tested on, rows marked as trained."""
    train = used.agg(F.count("*").alias("n")).select("n").scalar()
    return labels.agg(
        F.count(F.when((F.col("split") == "test") & F.col("label").isin("positive", "negative"), 1)).alias("test_count"),
        F.count(F.when(F.col("split") == "train", 1)).alias("marked_count")).withColumn("train_count", train)


def mark_trained(labels: DataFrame, at: Column) -> DataFrame:
    return labels.withColumn("trained", F.when(F.col("split") == "train", at).otherwise(F.col("trained")))


def _per_threshold(thresholds: Sequence[float], **named: object) -> Column:
    """Array of structs, one per threshold, from functions of (index, threshold)."""
    return F.array(*[F.struct(F.lit(t).alias("threshold"), *[fn(i, t).alias(n) for n, fn in named.items()])
                     for i, t in enumerate(thresholds)])


def threshold_quality(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Recall and false-positive rate of a similarity cut against labels, in one aggregation.

    ``pairs``: similarity, label.
    """
    aggs = []
    for i, t in enumerate(thresholds):
        for label in ("positive", "negative"):
            aggs.append(F.count(F.when((F.col("label") == label) & (F.col("similarity") >= t), 1)).alias(f"{label}_{i}"))
    totals = [F.count(F.when(F.col("label") == label, 1)).alias(label) for label in ("positive", "negative")]
    one = pairs.agg(*aggs, *totals)
    rows = _per_threshold(thresholds, recall=lambda i, t: F.col(f"positive_{i}") / F.col("positive"),
                          false_positive_rate=lambda i, t: F.col(f"negative_{i}") / F.col("negative"))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def threshold_sweep(counts: DataFrame, base: float) -> DataFrame:
    """Candidates kept, mean similarity and drop rate against a base threshold.

    ``counts``: threshold, kept and sim_sum, the base threshold among them (see similarity.threshold_counts).
    """
    base_kept = counts.filter(F.col("threshold") == base).select("kept").scalar()
    share = F.when(base_kept > 0, F.col("kept") / base_kept)
    return counts.select("threshold", "kept", F.when(F.col("kept") > 0, F.col("sim_sum") / F.col("kept")).alias("avg_sim"),
                         (F.lit(1.0) - share).alias("drop_rate"))


def similarity_stats(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("n_decisions"), F.count("similarity_e3").alias("n_with_similarity"),
        F.round(F.sum("similarity_e3") / F.count("similarity_e3") / 1000, 3).alias("avg_similarity"),
        (F.min("similarity_e3") / 1000).alias("min_similarity"), (F.max("similarity_e3") / 1000).alias("max_similarity"),
        F.round(F.sum("score") / F.count("score"), 0).alias("avg_score"))


def fill_counts(ads: DataFrame, col: str) -> DataFrame:
    """Rows with and without a value in ``col``."""
    return ads.agg(F.count("*").alias("total"), F.count(col).alias("filled")).withColumn(
        "missing", F.col("total") - F.col("filled"))
