"""Streams give the same rows however the input arrives."""

import random

import pytest
from pyspark.sql import functions as F

from spotweave.operators.segments import gap_scenes
from spotweave.session import shared_dir
from spotweave.settings import SegmentationSettings
from spotweave.streaming import jobs as st

SCHEMA = "job_id long, seg_id long, start_ms long, end_ms long, text string, ended boolean"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Segments of four jobs in files that come late, out of order and twice, the end of two jobs among them."""
    rng = random.Random(11)
    rows = []
    for job in range(4):
        at = 0
        for n in range(40):
            at += rng.choice([500, 3000, 9000])
            rows.append((job, n, at, at + rng.randint(200, 4000), f"w{n}", False))
    ends = [(job, None, None, None, None, True) for job in (1, 3)]
    files = [sorted(r for r in rows if r[0] == job) for job in (2, 1, 0, 3)]
    rng.shuffle(files[1])
    files = [files[0], files[1][:25], ends[:1], files[1][20:] + files[2], files[3] + ends[1:], files[1][:5]]
    for n, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


@pytest.mark.parametrize("per_batch", [None, 1])
def test_ingest_and_gap_scenes(spark, arrivals, per_batch):
    folder, rows = arrivals
    stream = st.table_stream(spark, folder, "*.parquet", SCHEMA, per_batch)
    keys = ["job_id", "start_ms", "end_ms", "text"]
    stored = st.drain(st.ingest(stream.filter("NOT ended").select(*keys), keys), "segments")
    assert sorted(map(tuple, stored.collect())) == sorted((r[0], *r[2:5]) for r in rows)
    scenes = st.stream_gap_scenes(st.table_stream(spark, folder, "*.parquet", SCHEMA, per_batch))
    table = spark.createDataFrame([r[:4] for r in rows if r[0] in (1, 3)], "job_id long, seg_id long, start_ms long, end_ms long")
    wanted = gap_scenes(table).select("job_id", "start_ms", "end_ms", "n_segments")
    assert sorted(map(tuple, scenes.collect())) == sorted(map(tuple, wanted.collect())) and wanted.count() > 10


def test_gap_scenes_over_chunk_borders(spark, arrivals):
    folder, rows = arrivals
    scenes = st.stream_gap_scenes(st.table_stream(spark, folder, "*.parquet", SCHEMA, 2), SegmentationSettings(chunk_ms=7000))
    table = spark.createDataFrame([r[:4] for r in rows if r[0] in (1, 3)], "job_id long, seg_id long, start_ms long, end_ms long")
    wanted = gap_scenes(table).select("job_id", "start_ms", "end_ms", "n_segments")
    assert sorted(map(tuple, scenes.collect())) == sorted(map(tuple, wanted.collect()))


def test_gap_scenes_write_a_segment_once(spark, tmp_path):
    """Twenty micro-batches, each with one segment of one chunk and the one before once more with another end, which changes nothing."""
    table = [(1, n, n * 9000, n * 9000 + 1000, f"w{n}", False) for n in range(20)]
    for n, row in enumerate(table):
        again = [(*table[n - 1][:3], 10 ** 6, "again", False)] if n else [(1, None, None, None, None, True)]
        spark.createDataFrame([row, *again], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = set(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(shared_dir(spark)).select("path").collect())
    scenes = st.stream_gap_scenes(st.table_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, 1))
    assert sorted(map(tuple, scenes.collect())) == [(1, r[2], r[3], 1) for r in table]
    after = set(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(shared_dir(spark)).select("path").collect())
    assert spark.read.parquet(*[r["path"] for r in after - before]).count() == len(table) + 1


def test_training_rows_are_drawn_by_scene_and_ad(spark):
    from spotweave.operators.labels import training_set
    rows = [(s, a, 0.2, "negative", "train") for s in range(100) for a in range(20)] + [(s, 50, 0.9, "positive", "train") for s in range(50)]
    df = spark.createDataFrame(rows, "scene_id long, ad_id long, score double, label string, split string")
    got = {(r.scene_id, r.ad_id) for r in training_set(df).filter("label = 'negative'").collect()}
    assert len(got) == 150 and len({a for _, a in got}) == 20
    assert got == {(r.scene_id, r.ad_id) for r in training_set(df.orderBy(F.desc("scene_id")).repartition(7)).filter("label = 'negative'").collect()}
