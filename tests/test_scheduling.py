"""Folds against a recursive query, with items dense enough that carries and chains occur."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oracle.parts import fold_parts, with_parts
from spotweave.operators import scheduling as sched

MINUTE = 60_000


def make_items(seed, jobs=6, per_job=60, hours=6, longest=24 * MINUTE):
    """Overlays on whole seconds over a few hours."""
    rng = random.Random(seed)
    return [(job, f"{n:04d}", 1000 * second, rng.randint(1, longest), rng.randint(1, 9), f"ad{rng.randint(1, 20)}")
            for job in range(jobs) for n, second in enumerate(sorted(rng.sample(range(3600 * hours), per_job)))]


def replayed(rows, rule, gap=0):
    """Kept (job, item) of a rule, item by item in DuckDB."""
    con = duckdb.connect()
    con.register("overlays", pd.DataFrame(rows, columns=["job_id", "id", "s", "dur", "score", "ad_id"]))
    parts = fold_parts("x", f"SELECT job_id, id, s, dur, score, {gap} AS gap FROM overlays", rule)
    return set(con.sql(with_parts("SELECT job_id, id FROM x_kept", **parts)).fetchall())


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "job_id long, item_id string, overlay_start_ms long, overlay_ms long, score long, ad_id string")


def ids(df):
    return {(r.job_id, r.item_id) for r in df.select("job_id", "item_id").collect()}


@pytest.mark.parametrize("seed,longest", [(1, 24 * MINUTE), (2, 150 * MINUTE)])
def test_overlap_rules_replay(spark, seed, longest):
    rows = make_items(seed, longest=longest)
    df = frame(spark, rows)
    assert ids(sched.drop_overlaps(df)) == replayed(rows, "overlap")
    kept = ids(sched.drop_earlier(df))
    assert kept == replayed(rows, "earlier")
    # By definition: kept overlays are clear of each other, and each dropped one begins inside a kept one before it.
    span = {(r[0], r[1]): (r[2], r[2] + r[3]) for r in rows}
    for job, item in span:
        start, end = span[job, item]
        inside = [k for k in kept if k[0] == job and k[1] != item and span[k][0] <= start < span[k][1]]
        assert bool(inside) != ((job, item) in kept)


@pytest.mark.parametrize("seed,interval", [(3, 5 * MINUTE), (4, 42 * MINUTE)])
def test_spacing_replay(spark, seed, interval):
    rows = make_items(seed)
    kept = ids(sched.spaced(frame(spark, rows).withColumn("_interval", F.lit(interval))))
    assert kept == replayed(rows, "spacing", interval)
    starts = sorted((r[0], r[2]) for r in rows if (r[0], r[1]) in kept)
    assert all(a[0] != b[0] or b[1] - a[1] >= interval for a, b in zip(starts, starts[1:]))


def test_wide_overlay_in_one_job_leaves_the_others_alone(spark):
    rows = make_items(5) + [(9, "0000", 0, 600 * MINUTE, 5, "ad1"), (9, "0001", 30 * MINUTE, MINUTE, 4, "ad2"), (9, "0002", 601 * MINUTE, MINUTE, 1, "ad3")]
    assert ids(sched.drop_overlaps(frame(spark, rows))) == replayed(rows, "overlap")


def folded(rows, rule):
    """Kept (job, item) of a rule applied one item after the other."""
    kept = set()
    for job in {r[0] for r in rows}:
        last, in_hour = None, 0
        for item in sorted(r[1] for r in rows if r[0] == job):
            fate, count = (sched.FOLLOW, 1) if last is None else rule.step(last, in_hour, item)
            if fate == sched.FOLLOW and last is not None:
                kept.add((job, last.item_id))
            if fate != sched.SKIP:
                last, in_hour = item, count
        kept.add((job, last.item_id))
    return kept


@pytest.mark.parametrize("size,longest", [(7, 20), (7, 400), (40, 60)])
def test_endless_islands_are_folded_in_blocks(spark, size, longest):
    rng = random.Random(size + longest)
    rows = []
    for job in range(3):
        at = 0
        for n in range(300):
            at += rng.choice([0, 1, 2, 5, 9]) * MINUTE // 4
            # A few overlays outlast and outbid everything for many blocks.
            rows.append((job, sched.Item(at, f"{n:04d}", at + rng.randint(1, longest) * MINUTE, 100 - n % 90 if n % 97 == 0 else rng.randint(1, 9), 3 * MINUTE)))
    items = spark.createDataFrame([(job, *item) for job, item in rows], "job_id long, start_ms long, item_id string, end_ms long, score long, interval_ms long")
    hour = sched.SCHEDULE.hour_ms
    for rule, reach in ((sched.PREFER_BETTER, F.col("end_ms")), (sched.PREFER_EARLIER, F.col("end_ms")),
                        (sched.keep_apart(), F.greatest(F.col("start_ms") + F.col("interval_ms"), (F.floor(F.col("start_ms") / hour) + 1) * hour))):
        got = [(r.job_id, r.item_id) for r in sched.fold_blocks(items, rule, reach, size=size).collect()]
        assert len(got) == len(set(got)) and set(got) == folded(rows, rule)


def test_one_island_of_many_items_is_many_tasks(spark):
    rng = random.Random(2)
    rows = [(1, sched.Item(n * 1000, f"{n:06d}", n * 1000 + rng.randint(1500, 30_000), rng.randint(1, 50), None)) for n in range(60_000)]
    items = spark.createDataFrame([(job, *item) for job, item in rows], "job_id long, start_ms long, item_id string, end_ms long, score long, interval_ms long")
    blocks = sched._blocks(items, F.col("end_ms"), sched.SCHEDULE, 4000)
    assert blocks.select("island").distinct().count() == 1 and blocks.select("block").distinct().count() == 15
    got = {(r.job_id, r.item_id) for r in sched.fold_blocks(items, sched.PREFER_BETTER, F.col("end_ms"), size=4000).collect()}
    assert got == folded(rows, sched.PREFER_BETTER)


def test_interval_and_cold_tiers(spark):
    info = spark.createDataFrame([(1, 1_200_000), (2, 2_400_000), (3, 2_400_001), (4, 0)], "job_id long, duration_ms long")
    got = {r.job_id: r.i for r in info.select("job_id", sched.min_interval(F.col("duration_ms")).alias("i")).collect()}
    assert got == {1: 60_000, 2: 120_000, 3: 120_000, 4: 180_000}
    rows = [(job, f"{s}", s, 1000, 50, "a") for job in (1, 2, 3, 4, 5) for s in (29_999, 30_000, 60_000, 90_000, 1_170_001)]
    kept = ids(sched.cold_zones(frame(spark, rows), info))
    assert {s for j, s in kept if j == 1} == {"30000", "60000", "90000"}
    assert {s for j, s in kept if j == 2} == {"60000", "90000", "1170001"}
    assert {s for j, s in kept if j == 3} == {"90000", "1170001"}
    assert {s for j, s in kept if j == 5} == {"30000", "60000", "90000", "1170001"}


def test_best_per_scene_ties_and_minimum(spark):
    df = spark.createDataFrame([(1, 0, "b", 40), (1, 0, "a", 40), (1, 5, "c", 19)], "job_id long, start_ms long, ad_id string, score long")
    assert [(r.start_ms, r.ad_id) for r in sched.best_per_scene(df).collect()] == [(0, "a")]


def test_schedule_invariants(spark, sf_dir):
    from spotweave.plans.fixture_plan import fixture_plan
    rows = fixture_plan(spark, sf_dir).schedule().orderBy("job_id", "overlay_start_ms").collect()
    assert rows
    previous = None
    seen = set()
    for r in rows:
        assert (r.job_id, r.ad_id) not in seen
        seen.add((r.job_id, r.ad_id))
        assert r.score >= 20 and r.overlay_start_ms >= 30_000
        if previous is not None and previous.job_id == r.job_id:
            assert r.overlay_start_ms >= previous.overlay_start_ms + previous.overlay_ms
            assert r.overlay_start_ms - previous.overlay_start_ms >= 60_000
        previous = r
