"""Display rules, text rules, table maintenance and sinks on boundary values."""

import json
import math
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from spotweave.functions import text as tx
from spotweave.operators import serving as sv
from spotweave.operators import tables as tb
from spotweave.operators.candidates import contains_any, first_keyword, sim_threshold
from spotweave.operators import labels as lb
from spotweave.operators.labels import rank_metrics, sampled_pairs
from spotweave.operators.placement import normalized_size
from spotweave.settings import UNSAFE_KEYWORDS
from spotweave.sources import catalog, listing, sinks


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_format_time(spark):
    given = [(0.0, "0:00"), (59.0, "0:59"), (65.0, "1:05"), (65.9, "1:05"), (3600.0, "1:00:00"), (3661.0, "1:01:01"), (-10.0, "0:00")]
    assert all(got == want for got, want in values(spark, given, "s double, want string", tx.format_time(F.col("s")), "want"))


def test_active_overlays(spark):
    overlays = spark.createDataFrame([(1, 1, "a", 80, 10_000, 5_000), (1, 2, "b", 80, 12_000, 1_000), (1, 3, "c", 60, 30_000, 10_000)],
                                     "job_id long, decision_id long, ad_id string, score long, overlay_start_ms long, overlay_ms long")
    playback = spark.createDataFrame([(1, 1, 10_000, False), (2, 1, 12_000, False), (3, 1, 15_000, False), (4, 1, 20_000, False), (5, 1, 35_000, True)],
                                     "event_id long, job_id long, pos_ms long, ended boolean")
    assert {r.event_id: r.ad_id for r in sv.active_overlays(playback, overlays).collect()} == {1: "a", 2: "b"}


def test_overlay_layout(spark):
    rows = spark.createDataFrame(
        [(1, 100, 200, 300, 150, 1920, 1080), (2, None, 200, None, 150, 1920, 1080), (3, 100, 200, 0, 0, 0, 0), (4, 1900, 1060, 200, 100, 1920, 1080)],
        "decision_id long, x int, y int, w int, h int, natural_w int, natural_h int"
    ).withColumn("ad_natural_w", F.lit(None).cast("int")).withColumn("ad_natural_h", F.lit(None).cast("int"))
    got = {r.decision_id: r for r in sv.overlay_layout(rows, (("half", 960, 540),)).collect()}
    assert (got[1].box_x, got[1].box_y, got[1].box_w, got[1].box_h) == (50, 100, 150, 75)
    assert (got[2].box_x, got[2].box_w) == (0, 240)
    assert (got[3].box_x, got[3].box_y, got[3].box_w) == (100, 200, 240) and got[3].box_h == pytest.approx(118.8)
    assert (got[4].box_x, got[4].box_y) == (860, 490)


def test_thresholds_sizes_keywords(spark):
    got = values(spark, [(4_999, "tv"), (60_000, "tv"), (10_000, "tv"), (10_000, "None"), (10_000, " ")], "n long, o string",
                 sim_threshold(F.col("n"), F.col("o")))
    assert [g[0] for g in got] == [0.45, 0.35, 0.38, 0.30, 0.30]
    sizes = values(spark, [(None, 250), (0, 250), (315, 262), (345, 287), (346, 250)], "w int, h int",
                   normalized_size(F.col("w"), F.col("h"), F.lit(300), F.lit(250)))
    assert [tuple(s[0]) if s[0] else None for s in sizes] == [(300, 250), (300, 250), (315, 262), (300, 250), None]
    assert len(UNSAFE_KEYWORDS) == 23
    assert values(spark, [(f"가 {UNSAFE_KEYWORDS[3]} {UNSAFE_KEYWORDS[2]}",)], "t string", first_keyword(F.col("t"), UNSAFE_KEYWORDS)) == [(UNSAFE_KEYWORDS[2],)]


def test_long_keyword_lists(spark):
    """One pass with an automaton gives what word-by-word search gives; the first listed word wins."""
    rng = random.Random(1)
    letters = "abcdefgh가나"
    words = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(10_000)]
    words += words[:50]
    texts = [None, "", "zzz"] + ["".join(rng.choices(letters + " ", k=rng.randint(0, 60))) + rng.choice(["", rng.choice(words)]) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for listed in (words, words[:30], [*words[:200], "", *words[200:400]]):
        got = values(spark, [(t,) for t in texts], "t string", first_keyword(F.col("t"), listed), contains_any(F.col("t"), listed))
        first = [None if t is None else next((w for w in listed if w in t), None) for t in texts]
        assert got == [(w, None if t is None else w is not None) for w, t in zip(first, texts)]
    assert df.select(first_keyword(F.col("t"), words)).limit(0).count() == 0


def test_text_rules(spark):
    answer = "상황: 하나\n 감정:  둘 \n상황: 셋"
    assert values(spark, [(answer,)], "t string", *tx.scene_sections(F.col("t"))) == [("셋", "둘", "")]
    assert values(spark, [("## A\n- **b** c\n 2. d",)], "t string", tx.clean_narrative(F.col("t"))) == [("A b c d",)]
    tags = values(spark, [("Rain, rain ,a b c d\n Night drive,,",)], "t string", tx.keyword_tags(F.col("t")))
    assert tags == [(["rain", "night drive"],)]
    raw = [("0.7 \n",), ("1.5",), ("nan",), ("0.5d",), ("1",), ("",)]
    assert [v[0] for v in values(spark, raw, "t string", tx.parsed_score(F.col("t")))] == [0.7, None, None, None, 1.0, None]
    assert values(spark, [(r"D:\ads\쿠키 a*~.mp4",)], "p string", tx.source_url("u", F.col("p"))) == [
        ("u/media/source/%EC%BF%A0%ED%82%A4%20a%2A~.mp4",)]


def test_title_matching(spark):
    files = spark.createDataFrame([(1, "Big_Show-E1.x.mp4"), (2, "big.mp4"), (3, "other.mp4")], "file_id long, filename string")
    images = spark.createDataFrame([(0, "zzz.jpg"), (1, "Show.jpg"), (2, "big show.png")], "list_pos long, image string")
    assert {r.file_id: r.image for r in catalog.match_titles(files, images).collect()} == {1: "Show.jpg", 2: "big show.png", 3: None}


def test_title_matching_by_definition(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choices("ab 가", k=rng.choice([0, 1, 2, 3, 4, 5, 9, 14])))
    files = [(i, f"{name()}.E{i}.mp4" if i else None) for i in range(80)]
    images = [(i * 2, f"{name()}.jpg") for i in range(60)]
    key = lambda t: t.split(".")[0].strip().lower()
    got = {r.file_id: r.list_pos for r in catalog.match_titles(spark.createDataFrame(files, "file_id long, filename string"),
                                                              spark.createDataFrame(images, "list_pos long, image string")).collect()}
    assert got == {i: min((p for p, g in images if f is not None and (key(g) in key(f) or key(f) in key(g))), default=None) for i, f in files}
    none = catalog.match_titles(spark.createDataFrame(files[1:3], "file_id long, filename string"), spark.createDataFrame([], "list_pos long, image string"))
    assert [r.list_pos for r in none.collect()] == [None, None]


def test_lineup_of_loose_json(spark):
    docs = spark.createDataFrame([
        (1, '{"items":[{"id":5,"title":"a","job_id":null,"poster":{"x":1}},7,"text",null,{"id":"b","title":["t"]}]}'), (2, "no json"), (3, '{"items":"none"}'),
        (4, '{"items":[]}'), (5, '{"week":1}'), (6, None)], "channel int, body string")
    done = spark.createDataFrame([(c, 10 + c, f"show{c}.x.mp4") for c in range(1, 7)], "channel int, job_id long, filename string")
    rows = {(r.channel, r.pos): r for r in catalog.lineup(docs, done).collect()}
    assert set(rows) == {(1, 0), (1, 4), (2, None), (3, None), (5, None), (6, None)}
    assert (rows[1, 0].id, rows[1, 0].title, rows[1, 0].job_id, rows[1, 0].filename) == ("5", "a", None, None)
    assert rows[1, 4].id == "b" and rows[2, None].title == "show2.x"
    bad = {(r.channel, r.pos, r.bad) for r in catalog.lineup_entries(docs).collect() if r.bad is not None}
    assert bad == {(1, 1, "7"), (1, 2, '"text"'), (1, 3, "null"), (2, None, "no json"), (3, None, '{"items":"none"}')}


def test_table_maintenance(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, c string, v long")
    batch = spark.createDataFrame([(2, "x", 5), (2, "y", 6), (3, "z", 7)], "k long, c string, v long")
    up = tb.upsert(target, batch, ["k"], [F.col("v")], keep=["c"])
    assert sorted(map(tuple, up.collect())) == [(1, "a", 1), (2, "b", 6), (3, "z", 7)]
    new = tb.insert_new(target, batch, ["k"], [F.col("v")])
    assert sorted(map(tuple, new.collect())) == [(1, "a", 1), (2, "b", 2), (3, "z", 7)]
    patched = tb.update_cols(target, batch.filter("v = 6").withColumn("c", F.lit(None).cast("string")), ["k"], ["c"])
    assert sorted(map(tuple, patched.collect()), key=lambda r: r[0]) == [(1, "a", 1), (2, None, 2)]


def test_sinks(spark, tmp_path):
    from spotweave.settings import TRAINING_COLUMNS
    rows = [(0.5, 40 + i, 10.0, None, 0.2, "banner", i % 3 - 1) for i in range(30)]
    features = spark.createDataFrame(rows, "similarity_score double, final_score long, scene_duration_sec double, "
                                     "ad_duration_sec double, avg_density double, ad_type string, label int")
    out = str(tmp_path / "train")
    assert sinks.export_training(features, out, min_count=31) is None
    assert sinks.export_training(features, out) == {-1: 10, 0: 10, 1: 10}
    back = spark.read.csv(out, header=True)
    assert tuple(back.columns) == TRAINING_COLUMNS and back.count() == 30
    sinks.write_report(features.limit(1), str(tmp_path / "report"))
    line = next((tmp_path / "report").glob("*.json")).read_text().splitlines()[0]
    assert json.loads(line)["ad_type"] == "banner"
    table = str(tmp_path / "decisions")
    jobs = spark.createDataFrame([(1, 10), (2, 20)], "job_id long, v long")
    sinks.write_run(jobs, jobs.unionByName(spark.createDataFrame([(3, 0)], "job_id long, v long")), table, 1)
    # Job 2 is run again and gets nothing, job 3 gets a row, job 1 stays; the same run twice is one run.
    for _ in range(2):
        sinks.write_run(spark.createDataFrame([(3, 31)], "job_id long, v long"), spark.createDataFrame([(2,), (3,)], "job_id long"), table, 2)
    assert sorted((r.job_id, r.v) for r in sinks.read_runs(spark, table).collect()) == [(1, 10), (3, 31)]


def test_runs_are_committed_last(spark, tmp_path, monkeypatch):
    table, schema = str(tmp_path / "runs"), "job_id long, v long"
    jobs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], schema)
    sinks.write_run(jobs, jobs, table, 1)
    read = lambda only=None: sorted((r.job_id, r.v) for r in sinks.read_runs(spark, table, only).collect())
    # A call that dies after its rows, or after its jobs, changes nothing for readers, also when it repeats a run.
    for step in (2, 3):
        calls, write = [], DataFrameWriter.parquet

        def dying(self, path, *args, **kwargs):
            calls.append(path)
            if len(calls) > step:
                raise RuntimeError("lost")
            return write(self, path, *args, **kwargs)

        with monkeypatch.context() as patched, pytest.raises(RuntimeError):
            patched.setattr(DataFrameWriter, "parquet", dying)
            sinks.write_run(jobs.withColumn("v", F.lit(99)), jobs, table, 1)
        assert read() == [(1, 10), (2, 20), (3, 30)]
    # Run 2 is for jobs 2 and 3; written again it is for job 3 only, so job 2 has run 1 again.
    sinks.write_run(jobs.filter("job_id = 2").withColumn("v", F.lit(21)), jobs.filter("job_id > 1"), table, 2)
    assert read() == [(1, 10), (2, 21)]
    sinks.write_run(jobs.limit(0), jobs.filter("job_id = 3"), table, 2)
    assert read() == [(1, 10), (2, 20)] and read(spark.createDataFrame([(2,), (3,), (9,)], "job_id long")) == [(2, 20)]


def test_media_listing_is_a_data_source(spark, tmp_path):
    names = [f"d{i % 7}/e{i % 3}/f{i}.{('mp4', 'jpg', 'MP4', '')[i % 4]}".rstrip(".") for i in range(200)] + ["top.mp4", ".hidden", "two.parts.jpg"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    files = listing.media_files(spark, str(tmp_path), shares=5)
    rows = {r.path[len(str(tmp_path)) + 1:]: r for r in files.collect()}
    assert set(rows) == set(names) and {r.length for r in rows.values()} == {2} and files.rdd.getNumPartitions() > 1
    assert (rows["two.parts.jpg"].stem, rows["two.parts.jpg"].extension, rows[".hidden"].extension) == ("two.parts", "jpg", "")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        clips = listing.media_files(spark, str(tmp_path)).filter("extension IN ('mp4', 'jpg') AND length > 1 AND stem <> 'top'")
        assert clips.count() == len([n for n in names if n.endswith((".mp4", ".jpg")) and n != "top.mp4"])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "none").mkdir()
    assert listing.media_files(spark, str(tmp_path / "none")).count() == 0


def test_asset_listing_reads_metadata_only(spark, tmp_path):
    for name in ("b clip.mp4", "a.MKV", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    files = catalog.list_files(spark, str(tmp_path))
    assert [r.name for r in catalog.playable_files(files).collect()] == ["a.MKV", "b clip.mp4"]


def test_rank_metrics_and_sampling(spark):
    rows = [("m", 1, i, 1.0 - i / 10, [0.1, 0.9, 0.2][i], i == 1) for i in range(3)]
    df = spark.createDataFrame(rows, "model string, scene_id long, ad_id long, score double, relevance double, positive boolean")
    got = rank_metrics(df, k=2).collect()[0]
    assert (got.mrr, got.precision_at_k, got.n_scenes) == (0.5, 0.5, 1)
    assert got.ndcg == pytest.approx((0.1 + 0.9 / math.log2(3)) / (0.9 + 0.2 / math.log2(3)), abs=1e-4)
    scenes, ads = spark.range(4).withColumnRenamed("id", "scene_id"), spark.range(50).withColumnRenamed("id", "ad_id")
    labels = spark.createDataFrame([(0, a) for a in range(48)] + [(1, 3)], "scene_id long, ad_id long")
    every = sampled_pairs(scenes, ads, labels, 1000)
    assert {r.scene_id: r.n for r in every.groupBy("scene_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 49, 2: 50, 3: 50}
    few = sampled_pairs(scenes, ads, labels, 3).groupBy("scene_id").agg(F.count("*").alias("n")).collect()
    assert {r.scene_id: r.n for r in few} == {0: 2, 1: 3, 2: 3, 3: 3}


@pytest.mark.parametrize("scene,ad", [("{}", "ad_{}"), ("9223372036854775{:03d}", "{}")])
def test_label_loop_takes_any_id(spark, scene, ad):
    """Texts and the largest numbers, where arithmetic on ids would overflow."""
    rows = [(scene.format(s), ad.format(a), 0.9 if a < 3 else 0.1, "positive" if a < 3 else "negative") for s in range(60) for a in range(12)]
    kinds = "scene_id string, ad_id string, score double, label string"
    df = spark.createDataFrame(rows, kinds)
    if ad == "{}":
        df = df.withColumn("scene_id", F.col("scene_id").cast("long")).withColumn("ad_id", F.col("ad_id").cast("long") + 2**62)
    split = lb.assign_split(df.withColumn("split", F.lit(None).cast("string")))
    counts = {r.split: r.n for r in split.select("scene_id", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"test": 12, "train": 48}
    used = lb.training_set(split, neg_ratio=2).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert {r.label: r.n for r in used} == {"positive": 144, "negative": 288}
    assert lb.holdout(df.select("scene_id").distinct()).count() == 12
    picks = sampled_pairs(df.select("scene_id").distinct(), df.select("ad_id").distinct(), df.filter(F.col("score") > 0.5), 4)
    assert picks.count() == 240 and picks.join(df.filter(F.col("score") > 0.5), ["scene_id", "ad_id"]).count() == 0
    marked = lb.mark_trained(split.withColumn("trained", F.lit(1)), F.lit(2)).groupBy("split").agg(F.collect_set("trained").alias("t")).collect()
    assert {r.split: r.t for r in marked} == {"test": [1], "train": [2]}


def test_split_evaluation(spark):
    labels = [(s, a, "positive" if a == s % 3 else "negative", 1.0 if a == s % 3 else 0.0, "test" if s < 6 else "train") for s in range(9) for a in range(3)] + [
        (50, 1, "positive", 1.0, "test"), (51, 1, "ambiguous", 0.5, "test")]
    df = spark.createDataFrame(labels, "scene_id long, ad_id long, label string, score double, split string")
    scores = spark.createDataFrame([(m, s, a, (1.0 if a == s % 3 else 0.5) if m == "tuned" else float(a)) for m in ("base", "tuned") for s in range(9) for a in range(3)],
                                   "model string, scene_id long, ad_id long, score double")
    got = {r.metric: r for r in lb.evaluate_split(df, scores).collect()}
    assert got["mrr"].tuned == 1.0 and got["mrr"].base == pytest.approx((1 + 1 / 2 + 1 / 3) / 3, abs=1e-4) and got["mrr"].n_scenes == 6
