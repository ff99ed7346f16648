"""Sources, table maintenance and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions import text as tx
from spotweave.operators import tables as tb
from spotweave.plans.registry import query
from spotweave.sources import catalog
from spotweave.sources import fixtures as fx


@query("timeline_scan")
def q_timeline(spark, d):
    return tb.timeline(fx.frames(spark, d), fx.silence(spark, d), fx.transcript(spark, d))


@query("asset_catalog")
def q_assets(spark, d):
    parts = fx.table(spark, d, "part")
    files = parts.selectExpr(
        "concat(CASE p_partkey % 2 WHEN 0 THEN 'D:\\\\ads\\\\' ELSE '/srv/ads/' END, p_name, ' ', "
        "CAST(p_partkey DIV 2 AS STRING), CASE p_size % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.jpg' "
        "WHEN 2 THEN '.png' ELSE '.txt' END) AS path", "p_size * 0.5D AS probed_sec")
    existing = parts.selectExpr("concat(p_name, ' ', CAST(p_partkey DIV 4 AS STRING)) AS ad_id").distinct()
    return catalog.asset_catalog(files, existing)


@query("lineup_items")
def q_lineup(spark, d):
    """One JSON lineup per channel (nation); some channels have none and fall back to jobs."""
    customers = fx.table(spark, d, "customer")
    item = ("named_struct('id', CAST(c_custkey AS STRING), 'title', c_name, 'filename', concat(c_name, '.E01'), "
            "'poster', concat('posters/', c_name, '.jpg'), 'preview', 'previews/', "
            "'thumbnail', concat('thumbnails/', c_mktsegment, '.jpg'), 'job_id', '')")
    docs = (customers.selectExpr("c_nationkey AS channel", "c_custkey DIV 8 AS page", f"{item} AS item")
            .groupBy("channel", "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
            .selectExpr("channel", "CASE WHEN channel % 5 = 0 THEN to_json(named_struct('week_label', 'none')) "
                        "ELSE to_json(named_struct('week_label', CAST(page AS STRING), 'items', items)) END AS body"))
    done = (fx.job_files(spark, d).filter("status = 'complete'")
            .select((F.col("job_id") % 25).cast("int").alias("channel"), "job_id",
                    tx.basename(F.col("video_path")).alias("filename")))
    return catalog.lineup(docs, done)


@query("replace_by_job")
def q_replace(spark, d):
    target = fx.decisions(spark, d).select("decision_id", "job_id", "ad_id", "score")
    rerun = target.filter("job_id % 3 = 0 AND score >= 50").withColumn("score", F.col("score") + 1000)
    return tb.replace_jobs(target, rerun, target.filter("job_id % 3 = 0").select("job_id"))


@query("insert_if_absent")
def q_insert(spark, d):
    rows = fx.silence(spark, d)
    stored = rows.filter("start_ms % 2 = 0").distinct().withColumn("batch", F.lit("stored"))
    arriving = rows.withColumn("batch", F.lit("new"))
    return tb.insert_new(stored, arriving, ["job_id", "start_ms", "end_ms"], [F.col("batch")])


@query("upsert_latest")
def q_upsert(spark, d):
    """Relabelled pairs replace score and label, the stored context stays; new pairs come in. Every label is in the target, the batch or both."""
    labels = fx.ce_labels(spark, d)
    target = labels.filter("ad_no % 3 <> 0").selectExpr(
        "scene_id", "ad_id", "'stored' AS context", "score_pct", "0L AS revision")
    batch = (labels.filter("ad_no % 2 = 0 OR ad_no % 3 = 0")
             .withColumn("revision", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ad_no") % 3 + 1)))
             .selectExpr("scene_id", "ad_id", "'new' AS context", "(score_pct + revision * 7) % 101 AS score_pct", "revision"))
    return tb.upsert(target, batch, ["scene_id", "ad_id"], [F.col("revision")], keep=["context"])


@query("scene_context_update")
def q_update(spark, d):
    target = fx.decisions(spark, d).selectExpr("decision_id", "job_id", "ad_id", "score")
    patch = fx.feedback(spark, d).selectExpr(
        "decision_id", "CASE WHEN label = 0 THEN NULL ELSE concat('ad_', label) END AS ad_id")
    return tb.update_cols(target, patch, ["decision_id"], ["ad_id"])


@query("dedupe_frames")
def q_dedupe(spark, d):
    return tb.dedupe_first(fx.frames_raw(spark, d), ["job_id", "frame_index"], fx.FRAME_ORDER).select(
        "job_id", "frame_index", "l_orderkey", "l_linenumber", "density_e4", "objects")


@query("pending_jobs")
def q_pending_jobs(spark, d):
    """Jobs none of whose frames has recognised objects yet."""
    jobs = fx.table(spark, d, "supplier").selectExpr("s_suppkey AS job_id").unionByName(
        fx.jobs(spark, d).select("job_id")).distinct()
    return tb.pending_jobs(jobs, fx.frames(spark, d), "objects = 'tv' AND density_e4 >= 7200")


@query("pending_scenes")
def q_pending_scenes(spark, d):
    """Orders (as scenes) without narrative, and those a forced rerun resumed at an id takes."""
    narrated = fx.table(spark, d, "labels").groupBy(F.col("doc_id").alias("scene_id")).agg(F.max(F.lit("told")).alias("narrative"))
    scenes = fx.table(spark, d, "orders").selectExpr("o_orderkey AS scene_id", "o_custkey AS job_id").join(narrated, "scene_id", "left")
    missing = tb.pending_rows(scenes, "scene_id", "narrative")
    forced = tb.pending_rows(scenes, "scene_id", "narrative", force=True, start=500)
    return missing.select("scene_id", "job_id", F.lit("missing").alias("run")).unionByName(
        forced.select("scene_id", "job_id", F.lit("forced").alias("run")))


@query("pending_ads")
def q_pending_ads(spark, d):
    """Ads without target narrative, and those a forced rerun resumed at an id takes."""
    ads = fx.ads(spark, d).withColumn("target_narrative", F.expr(
        "CASE tgt_vec % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ad_name END"))
    missing = tb.pending_rows(ads, "ad_id", "target_narrative")
    forced = tb.pending_rows(ads, "ad_id", "target_narrative", force=True, start="ad_150")
    return missing.select("ad_id", "ad_name", F.lit("missing").alias("run")).unionByName(
        forced.select("ad_id", "ad_name", F.lit("forced").alias("run")))


def _answers(spark, d):
    """Scene descriptions composed from whole documents."""
    return fx.table(spark, d, "documents").selectExpr(
        "doc_id", "concat('  상황:', source, ' ', lang, '\\n', text, '\\n감정: ', lang, "
        "CASE WHEN doc_id % 3 = 0 THEN concat('\\n욕구:  ', n_chars, '  ') ELSE '' END, "
        "CASE WHEN doc_id % 5 = 0 THEN concat('\\n 상황: ', text) ELSE '' END) AS answer")


@query("scene_sections")
def q_sections(spark, d):
    return _answers(spark, d).select("doc_id", *tx.scene_sections(F.col("answer")))


@query("clean_narrative")
def q_clean(spark, d):
    marked = F.expr("concat('## ', source, '\\n- **', lang, '** and *', lang, '*\\n', text, '\\n  12. end')")
    return fx.table(spark, d, "documents").select("doc_id", tx.clean_narrative(marked).alias("narrative"))


@query("keyword_tags")
def q_tags(spark, d):
    tags = fx.table(spark, d, "documents").select("doc_id", tx.keyword_tags(F.col("text")).alias("tags"))
    return tags.select("doc_id", F.size("tags").alias("n_tags"), F.array_join("tags", "|").alias("tags"))


def _raw_scores(spark, d):
    return fx.ce_labels(spark, d).selectExpr(
        "scene_id", "ad_id", "CASE ad_no % 7 WHEN 0 THEN concat(' ', CAST(score_pct / 100D AS STRING), '\\n') "
        "WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN concat('-0.', score_pct + 1) WHEN 4 THEN concat(score_pct, '.5') "
        "WHEN 5 THEN concat(score_pct, 'e-2') ELSE concat('0.', score_pct) END AS raw")


@query("parsed_scores")
def q_scores(spark, d):
    """Usable answers only; the rest is skipped."""
    parsed = _raw_scores(spark, d).withColumn("score", tx.parsed_score(F.col("raw")))
    return parsed.filter("score IS NOT NULL").select("scene_id", "ad_id", F.round("score", 6).alias("score"))


@query("label_bands")
def q_bands(spark, d):
    return fx.ce_labels(spark, d).select("scene_id", "ad_id", tx.label_band(F.expr("score_pct / 100D")).alias("label"))


@query("resource_urls")
def q_urls(spark, d):
    path, kind = F.col("resource_path"), F.col("ad_type")
    return fx.ads(spark, d).select(
        "ad_id", tx.ad_url("http://api", kind, path).alias("ad_url"),
        tx.source_url("http://api", path).alias("source_url"),
        tx.mounted_path(path, kind, "/mnt/videos", "/mnt/images").alias("mounted"))


@query("title_match")
def q_titles(spark, d):
    parts = fx.table(spark, d, "part")
    files = parts.selectExpr("p_partkey AS file_id", "concat(replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 "
                             "THEN concat('-', p_brand) ELSE '' END, '.E', CAST(p_partkey AS STRING), '.mp4') AS filename")
    images = parts.selectExpr("p_partkey AS list_pos", "concat(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN "
                              "concat(p_name, ' poster') WHEN 2 THEN upper(p_name) ELSE concat(p_brand, ' ', p_type) END, '.jpg') AS image")
    return catalog.match_titles(files, images).select("file_id", "list_pos", "image")
