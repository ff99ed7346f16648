"""Label, split, training-set and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.text import label_band
from spotweave.operators import labels as lb
from spotweave.operators.similarity import threshold_counts
from spotweave.plans.fixture_plan import fixture_plan
from spotweave.plans.registry import query
from spotweave.session import stage
from spotweave.sources import fixtures as fx


def _scored_labels(spark, d):
    score = F.expr("score_pct / 100D")
    return fx.ce_labels(spark, d).select("scene_id", "ad_id", "ad_no", "score_pct", "model_score_i", score.alias("score"),
                                         label_band(score).alias("label"))


def _split_labels(spark, d):
    rows = _scored_labels(spark, d).withColumn("split", F.expr("CASE WHEN scene_id % 7 = 0 THEN 'train' END"))
    return lb.assign_split(rows)


@query("training_features")
def q_features(spark, d):
    feedback = fx.feedback(spark, d).withColumn("created_at", F.col("decision_id"))
    return lb.training_features(feedback, fx.decisions(spark, d), fx.ads(spark, d))


def _label_scenes(spark, d):
    """Scenes whose narrative and desire are filled."""
    rows = fx.table(spark, d, "customer").selectExpr(
        "c_custkey AS scene_id", "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 4 THEN '' ELSE c_mktsegment END AS narrative")
    return rows.filter("narrative <> ''").select("scene_id")


def _label_ads(spark, d):
    rows = fx.table(spark, d, "part").selectExpr(
        "concat('ad_', CAST(p_partkey AS STRING)) AS ad_id", "CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 5 THEN '' ELSE p_name END AS narrative")
    return rows.filter("narrative <> ''").select("ad_id")


@query("unlabelled_pairs")
def q_unlabelled(spark, d):
    return lb.unlabelled_counts(_label_scenes(spark, d), _label_ads(spark, d), fx.ce_labels(spark, d))


@query("sampled_pairs")
def q_sampled(spark, d):
    return lb.sampled_pairs(_label_scenes(spark, d), _label_ads(spark, d), fx.ce_labels(spark, d), 3)


@query("scene_split")
def q_split(spark, d):
    return _split_labels(spark, d).select("scene_id", "ad_id", "label", "split")


@query("training_set")
def q_training_set(spark, d):
    return lb.training_set(_split_labels(spark, d)).select("scene_id", "ad_id", "label", F.round("score", 6).alias("score"))


def _eval_labels(spark, d):
    return _scored_labels(spark, d).filter("label IN ('positive', 'negative')").withColumn(
        "positive", F.col("label") == "positive")


@query("eval_groups")
def q_eval_groups(spark, d):
    """Evaluation groups of the test split."""
    test = _split_labels(spark, d).filter("split = 'test' AND label IN ('positive', 'negative')")
    return lb.eval_groups(test.select("scene_id", "ad_id", (F.col("label") == "positive").alias("positive")))


@query("eval_holdout")
def q_holdout(spark, d):
    return lb.holdout(lb.valid_scenes(_eval_labels(spark, d)))


def _model_scores(rows):
    """Score of each pair by either model: (model, scene_id, ad_id, score)."""
    models = F.array(F.struct(F.lit("base").alias("model"), (F.col("model_score_i") / 1009).alias("s")),
                     F.struct(F.lit("tuned").alias("model"),
                              ((F.col("score_pct") * 5 + F.col("model_score_i")) / 1514).alias("s")))
    return rows.select("scene_id", "ad_id", F.explode(models).alias("m")).select("m.model", "scene_id", "ad_id", F.col("m.s").alias("score"))


@query("rank_metrics")
def q_metrics(spark, d):
    """Base and tuned model on the held-out scenes, with the improvement."""
    labels = _eval_labels(spark, d)
    held = labels.join(lb.holdout(lb.valid_scenes(labels)), "scene_id", "left_semi")
    scored = held.select("scene_id", "ad_id", "positive", F.col("score").alias("relevance")).join(_model_scores(held), ["scene_id", "ad_id"])
    return lb.metric_deltas(lb.rank_metrics(stage(scored, "model-scores")))


@query("score_histogram")
def q_histogram(spark, d):
    return lb.score_histogram(_scored_labels(spark, d))


@query("relabel_band")
def q_relabel(spark, d):
    rows = _split_labels(spark, d).withColumn("trained", F.expr("CASE WHEN ad_no % 2 = 0 THEN 1 END"))
    return lb.relabel_band(rows).select("scene_id", "ad_id", "label", "split", "trained")


@query("label_distribution")
def q_distribution(spark, d):
    """Shares of feedback labels and of label bands."""
    feedback = lb.label_distribution(fx.feedback(spark, d)).selectExpr("'feedback' AS kind", "CAST(label AS STRING) AS label", "n", "share")
    bands = lb.label_distribution(_scored_labels(spark, d)).selectExpr("'band' AS kind", "label", "n", "share")
    return feedback.unionByName(bands).withColumn("share", F.round("share", 6))


@query("training_run")
def q_run(spark, d):
    rows = _split_labels(spark, d)
    return lb.training_run(rows, lb.training_set(rows))


@query("trained_marks")
def q_marks(spark, d):
    """Labels after a run, whose number marks the rows of the train split."""
    rows = _split_labels(spark, d).withColumn("trained", F.expr("CASE WHEN ad_no % 2 = 0 THEN 1L END"))
    return lb.mark_trained(rows, F.lit(2).cast("long")).select("scene_id", "ad_id", "split", "trained")


@query("test_evaluation")
def q_test_evaluation(spark, d):
    """Base and tuned model on the test split, from the split to the improvement in one plan; scores come as a table of their own."""
    scores = _model_scores(fx.ce_labels(spark, d))
    return lb.evaluate_split(_split_labels(spark, d), scores)


@query("threshold_quality")
def q_quality(spark, d):
    pairs = _scored_labels(spark, d).select((F.col("model_score_i") / 1009).alias("similarity"), "label")
    rows = lb.threshold_quality(pairs, (0.25, 0.30, 0.35, 0.40))
    return rows.select("threshold", F.round("recall", 6).alias("recall"),
                       F.round("false_positive_rate", 6).alias("false_positive_rate"))


@query("threshold_sweep")
def q_sweep(spark, d):
    """Scene x ad pairs above each threshold, counted inside the block product."""
    plan = fixture_plan(spark, d)
    weights = plan.scenes().groupBy("ctx_vec", "desire_vec").agg(F.count("*").alias("weight"))
    counts = threshold_counts(plan.contexts().join(weights, ["ctx_vec", "desire_vec"]), plan.weighted_targets(), (0.10, 0.12, 0.15, 0.20))
    rows = lb.threshold_sweep(stage(counts, "threshold-counts"), 0.12)
    return rows.select("threshold", "kept", F.round("avg_sim", 6).alias("avg_sim"), F.round("drop_rate", 6).alias("drop_rate"))


@query("similarity_stats")
def q_stats(spark, d):
    """Decision similarity and narrative fill counts."""
    stats = lb.similarity_stats(fx.decisions(spark, d))
    ads = fx.ads(spark, d).withColumn("target_narrative", F.expr("CASE WHEN tgt_vec % 3 <> 0 THEN ad_name END"))
    fill = lb.fill_counts(ads, "target_narrative")
    return stats.select("*", *[fill.select(c).scalar().alias(f"ads_{c}") for c in ("total", "filled", "missing")])
