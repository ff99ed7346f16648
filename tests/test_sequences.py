"""Order-dependent operators against their definitions, with chunks far smaller than the groups."""

import random

import numpy as np
from pyspark.sql import functions as F

from spotweave.operators import frames as fr, intervals
from spotweave.operators import placement as place
from spotweave.operators.audio import silence_intervals
from spotweave.operators.intervals import overlapping, points_in
from spotweave.operators.ordered import running_max_before, running_total, span_chunk, with_previous
from spotweave.operators.segments import gap_scenes, scene_numbers, scene_segments, scene_texts
from spotweave.operators.skew import pick_by, take_smallest
from spotweave.settings import PlacementSettings, SegmentationSettings


def test_chunked_lag_total_and_max(spark):
    rng = random.Random(5)
    rows = [(g, n, rng.randint(0, 50)) for g in (1, 2) for n in rng.sample(range(2000), 80)]
    df = spark.createDataFrame(rows, "g long, n long, v long")
    chunk = span_chunk("n", 70)
    lagged = {(r.g, r.n): r.prev_v for r in with_previous(df, ["g"], chunk, ["n"], ["v"]).collect()}
    totals = {(r.g, r.n): r.t for r in running_total(df, ["g"], chunk, ["n"], F.col("v"), "t").collect()}
    tops = {(r.g, r.n): r.m for r in running_max_before(df, ["g"], chunk, ["n"], "v", "m").collect()}
    for g in (1, 2):
        seen = []
        for _, n, v in sorted(r for r in rows if r[0] == g):
            assert lagged[g, n] == (seen[-1] if seen else None)
            assert tops[g, n] == (max(seen) if seen else None)
            seen.append(v)
            assert totals[g, n] == sum(seen)


def test_range_joins_report_each_pair_once(spark):
    rng = random.Random(6)
    a = [(1, i, s, s + rng.randint(0, 300)) for i, s in enumerate(rng.sample(range(900), 40))]
    b = [(1, i, s, s + rng.randint(0, 300)) for i, s in enumerate(rng.sample(range(900), 40))]
    left = spark.createDataFrame(a, "job_id long, i long, s1 long, e1 long")
    right = spark.createDataFrame(b, "job_id long, j long, s2 long, e2 long")
    got = sorted((r.i, r.j) for r in overlapping(left, right, ["job_id"], ("s1", "e1"), ("s2", "e2"), 50).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[3] > y[2] and x[2] < y[3])
    inside = sorted((r.i, r.j) for r in points_in(left, right, ["job_id"], "s1", "s2", "e2", bucket_ms=50).collect())
    assert inside == sorted((x[1], y[1]) for x in a for y in b if y[2] <= x[2] <= y[3])


def test_range_joins_of_mixed_lengths(spark):
    """Spans from an instant to most of the time line: a long one is copied a few times and every pair comes once."""
    rng = random.Random(7)
    span = lambda i, s: (1 + i % 2, i, s, s + rng.choice([0, 1, 40, 900, 30_000, 480_001, 36_000_000]))
    a = [span(i, rng.randint(-50_000, 2_000_000)) for i in range(150)]
    b = [span(i, rng.randint(-50_000, 2_000_000)) for i in range(150)] + [(1, 900, 5, 4), (1, 901, None, 4)]
    left = spark.createDataFrame(a, "job_id long, i long, s1 long, e1 long")
    right = spark.createDataFrame(b, "job_id long, j long, s2 long, e2 long")
    known = [y for y in b if y[2] is not None and y[2] <= y[3]]
    for bucket in (10, 1000, 30_000):
        got = sorted((r.i, r.j) for r in overlapping(left, right, ["job_id"], ("s1", "e1"), ("s2", "e2"), bucket).collect())
        assert got == sorted((x[1], y[1]) for x in a for y in known if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])
        inside = sorted((r.i, r.j) for r in points_in(left, right, ["job_id"], "s1", "s2", "e2", bucket_ms=bucket).collect())
        assert inside == sorted((x[1], y[1]) for x in a for y in known if x[0] == y[0] and y[2] <= x[2] <= y[3])
    long = intervals._levelled(spark.createDataFrame([(1, 0, 36_000_000), (1, 7, 1007)], "job_id long, s long, e long"), "s", "e", 1000)
    copies = long.select(F.size(F.sequence(intervals._bucket("s", F.col("_own"), 1000), intervals._bucket("e", F.col("_own"), 1000))).alias("n"))
    assert max(r.n for r in copies.collect()) <= intervals.LONGEST + 1
    none = spark.createDataFrame([], "job_id long, j long, s2 long, e2 long")
    assert overlapping(left, none, ["job_id"], ("s1", "e1"), ("s2", "e2")).count() == 0 and points_in(left, none, ["job_id"], "s1", "s2", "e2").count() == 0


def scenes_by_definition(segments, vectors, duration, gap, floor):
    """Scene spans: a segment opens one where it is far from, or unlike, the segment before it."""
    if not segments:
        return [(0, duration)]
    starts, ends = np.array([s[1] for s in segments]), np.array([s[2] for s in segments])
    body = np.array([vectors[s[3]] for s in segments])
    opens = np.flatnonzero((starts[1:] - ends[:-1] > gap) | ((body[1:] * body[:-1]).sum(axis=1) < floor)) + 1
    next_starts = np.append(starts[opens], duration)
    last = np.append(opens, len(segments)) - 1
    return list(zip([0, *starts[opens].tolist()], np.maximum(ends[last], next_starts).tolist()))


def test_scene_segments_match_definition(spark):
    rng = random.Random(7)
    vectors = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.8, 0.6]}
    segs = {job: [(n, s, s + rng.randint(500, 5000), rng.randint(0, 2)) for n, s in enumerate(sorted(rng.sample(range(90_000), 25)))]
            for job in (1, 2)}
    df = spark.createDataFrame([(job, n, s, e, v, f"w{n}") for job, rows in segs.items() for n, s, e, v in rows],
                               "job_id long, seg_id long, start_ms long, end_ms long, vec_id long, text string")
    vec = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    info = spark.createDataFrame([(1, 100_000), (2, 100_000), (3, 50_000)], "job_id long, duration_ms long")
    cfg = SegmentationSettings(chunk_ms=7_000)
    got = scene_segments(df, vec, info, cfg).orderBy("job_id", "scene_no").collect()
    for job in (1, 2, 3):
        expected = scenes_by_definition(segs.get(job, []), vectors, 50_000 if job == 3 else 100_000, 4000, 0.3)
        assert [(r.start_ms, r.end_ms) for r in got if r.job_id == job] == expected
    texts = scene_texts(scene_numbers(df, vec, cfg), cfg).filter("job_id = 1").orderBy("scene_no").collect()
    assert " ".join(t.transcript for t in texts) == " ".join(f"w{n}" for n in range(25))


def test_gap_is_strict(spark):
    df = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 5000, 6000), (1, 3, 10_001, 11_000)],
                               "job_id long, seg_id long, start_ms long, end_ms long")
    assert [r.n_segments for r in gap_scenes(df).orderBy("scene_no").collect()] == [2, 1]


def window_by_definition(begin, size, scene, frames, speech, silence, ad, cfg):
    """Features of one window that has frames; times are whole tenths of a second."""
    here = [f for f in frames if max(scene[0], begin) <= f[0] <= min(scene[1], begin + size)]
    if not here:
        return None
    own = [s for s in speech if s[1] > scene[0] and s[0] < scene[1] and s[1] > begin and s[0] < begin + size]
    if own:
        # Quiet: some stretch of the window, long enough, that no speech covers.
        ticks = np.arange(begin, begin + size, 100)
        silent = ~np.any([(s[0] <= ticks) & (ticks < s[1]) for s in own], axis=0)
        runs = "".join("q" if q else " " for q in silent).split()
        quiet = max(map(len, runs), default=0) * 100 >= cfg.quiet_gap_ms
    else:
        quiet = bool(speech) or any(q[0] < end and q[1] > at for q in silence for at, end in [(max(begin, scene[0]), min(begin + size, scene[1]))])
    usable = np.array([f[1:5] for f in here if f[3] > 0 and f[4] > 0]).reshape(-1, 4)

    def visible(left):
        top = 720 - ad[1] - 20
        across = np.minimum(left + ad[0], usable[:, 0] + usable[:, 2]) - np.maximum(left, usable[:, 0])
        down = np.minimum(top + ad[1], usable[:, 1] + usable[:, 3]) - np.maximum(top, usable[:, 1])
        return int((across.clip(0) * down.clip(0)).sum())

    return len(here), sum(f[5] or 0 for f in here), len(usable), visible(20), visible(1280 - ad[0] - 20), int(quiet)


def test_window_pieces_match_single_windows(spark):
    rng = random.Random(8)
    cfg = PlacementSettings(chunk_windows=4, bucket_ms=5000)
    frames = [(job, ts, rng.choice([0, 640]), 300, rng.choice([0, 500]), 400, rng.choice([None, 800, 6400]))
              for job in (1, 2) for ts in sorted(rng.sample(range(0, 60_000, 500), 60))]
    segs = [(1, n, s, s + 100 * rng.randint(2, 40)) for n, s in enumerate(sorted(rng.sample(range(0, 60_000, 100), 14)))]
    silence = [(2, s, s + 900) for s in (3_000, 20_500, 41_000)]
    requests = [(job, s, e, length, 300, 250) for job in (1, 2)
                for s, e, length in ((0, 9_700, 4_000), (9_700, 41_300, 10_000), (41_300, 42_400, 1_100), (42_400, 60_000, 5_500))]
    req = spark.createDataFrame(requests, "job_id long, start_ms long, end_ms long, window_ms long, ad_w int, ad_h int").withColumn(
        "last_window", F.floor((F.col("end_ms") + 500 - F.col("start_ms") - F.col("window_ms")) / 1000))
    info = spark.createDataFrame([(1, 60_000, 1280, 720), (2, 60_000, 1280, 720)], "job_id long, duration_ms long, width int, height int")
    pieces = place.window_features(
        req, spark.createDataFrame(frames, "job_id long, ts_ms long, safe_x int, safe_y int, safe_w int, safe_h int, density_e4 int"),
        spark.createDataFrame(segs, "job_id long, seg_id long, start_ms long, end_ms long"),
        spark.createDataFrame(silence, "job_id long, start_ms long, end_ms long"), info, cfg).collect()
    got = {}
    for p in pieces:
        for k in range(p.k, p.k + p.n_windows):
            assert (p.job_id, p.start_ms, k) not in got
            got[p.job_id, p.start_ms, k] = (p.frames, p.density_sum, p.safe_frames, p.bl_sum, p.br_sum, p.quiet)
    expected = {}
    for job, s, e, length, w, h in requests:
        for k, begin in enumerate(range(s, e + cfg.overrun_ms - length + 1, cfg.step_ms)):
            value = window_by_definition(begin, length, (s, e), [f[1:] for f in frames if f[0] == job], [(x[2], x[3]) for x in segs if x[0] == job],
                                         [q[1:] for q in silence if q[0] == job], (w, h), cfg)
            if value:
                expected[job, s, k] = value
    assert got == expected


def test_silence_trailing_run_and_minimum(spark):
    quiet = set(range(10, 120)) | set(range(150, 200)) | set(range(300, 420))
    rows = [(1, t, 0.0 if t in quiet else 1.0) for t in range(420)]
    out = silence_intervals(spark.createDataFrame(rows, "job_id long, tick long, rms double"),
                            spark.createDataFrame([(1, 4_205)], "job_id long, track_ms long"), chunk_ticks=37)
    assert sorted((r.start_ms, r.end_ms) for r in out.collect()) == [(100, 1200), (3000, 4205)]


def test_safe_area_against_exhaustive_search(spark):
    rng = random.Random(9)
    boxes = [(1, f, 39 if rng.random() < 0.7 else 0, x, y, x + rng.randint(10, 200), y + rng.randint(10, 150))
             for f in range(12) for x, y in [(rng.randint(-20, 300), rng.randint(-20, 160)) for _ in range(4)]]
    frames = spark.createDataFrame([(1, f) for f in range(13)], "job_id long, frame_index long")
    df = spark.createDataFrame(boxes, "job_id long, frame_index long, class_id int, x1 int, y1 int, x2 int, y2 int")
    w, h, s = 320, 180, 20
    got = {r.frame_index: (r.safe_x, r.safe_y, r.safe_w, r.safe_h) for r in fr.safe_area(frames, df, w, h, s).collect()}
    for f in range(13):
        taken = [(x1, y1, x2, y2) for _, n, _, x1, y1, x2, y2 in boxes if n == f]
        for _, n, c, x1, y1, x2, y2 in boxes:
            if n == f and c == 0:
                pad = max(2, int(max(x2 - x1, y2 - y1) * 0.03))
                taken.append((x1 - pad, y1 - pad, x2 + pad, y1 + (y2 - y1) // 2 + pad))
        free = [[not (y < int(h * .12) or y >= int(h * .92) or any(a <= x < c and b <= y < d for a, b, c, d in taken))
                 for x in range(0, w, s)] for y in range(0, h, s)]
        best = (0, 0, 0, 0, (0, 0, 1, 1))
        for r2 in range(9):
            for c2 in range(16):
                for c1 in range(c2 + 1):
                    for r1 in range(r2 + 1):
                        if all(free[r][c] for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)):
                            key = ((r2 - r1 + 1) * (c2 - c1 + 1), -r2, -c2, c1, (c1, r1, c2 - c1 + 1, r2 - r1 + 1))
                            best = max(best, key)
        c, r, cw, ch = best[4]
        assert got[f] == (c * s, r * s, min(cw * s, w - c * s), min(ch * s, h - r * s))


def test_skew_helpers(spark):
    df = spark.range(2000).selectExpr("id", "id % 7 AS h", "CASE WHEN id < 1500 THEN 0 ELSE id END AS k")
    for n in (0, 1, 500, 1999, 5000):
        got = {r.id for r in take_smallest(df, F.lit(n), "h", "id").collect()}
        assert got == {i for _, i in sorted((i % 7, i) for i in range(2000))[:n]}
    assert pick_by(df, ["h"], [F.col("id")], last=True).count() == 7


def test_boxes_travel_as_rows_of_their_own(spark):
    """No box is multiplied by its grid rows before the shuffle; frames that span many batches and frames without boxes are right."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        boxes = spark.range(300).selectExpr("id % 3 AS job_id", "id % 2 AS frame_index", "2 AS class_id", "CAST(id % 40 * 8 AS INT) AS x1",
                                            "CAST(id % 40 * 8 + 4 AS INT) AS x2", "0 AS y1", "CAST(100 + id % 5 AS INT) AS y2")
        frames = boxes.select("job_id", "frame_index").union(spark.createDataFrame([(9, 9), (9, 9), (8, 1)], "job_id long, frame_index long"))
        found = fr.safe_area(frames, boxes, 320, 200, 4, bands=False)
        got = {(r.job_id, r.frame_index): (r.safe_x, r.safe_y, r.safe_w, r.safe_h) for r in found.collect()}
        assert len(got) == 8 and found.count() == 8
        assert got[9, 9] == got[8, 1] == (0, 0, 320, 200)
        held = {k: max(r.y2 for r in boxes.filter(f"job_id = {k[0]} AND frame_index = {k[1]}").collect()) for k in got if k[0] < 3}
        assert all(got[k] == (0, -(-y // 4) * 4, 320, 200 - -(-y // 4) * 4) for k, y in held.items())
        assert "explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cuts_of_shared_signals_move_numbers_only(spark):
    shared = spark.createDataFrame([(n, [float(n * n), 0.0]) for n in range(12)], "signal_id long, signal array<double>")
    numbers = spark.range(200).selectExpr("id % 4 AS job_id", "id * 60000 AS frame_index", "id * 7 % 13 AS signal_id")
    whole = fr.cut_flags(numbers.join(shared, "signal_id").drop("signal_id"))
    assert sorted(map(tuple, fr.cut_flags(numbers, shared=shared).collect())) == sorted(map(tuple, whole.collect()))


def _joins_of(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and column in line]


def test_copies_of_a_range_join_are_not_broadcast(spark):
    spans = spark.createDataFrame([(1, 0, 100), (1, 50, 900_000)], "job_id long, s2 long, e2 long")
    points = spark.createDataFrame([(1, 60, 70), (2, 60, 70)], "job_id long, s1 long, e1 long")
    for met in (points_in(points, spans, ["job_id"], "s1", "s2", "e2"), overlapping(points, spans, ["job_id"], ("s1", "e1"), ("s2", "e2"))):
        joins = _joins_of(met, "_bucket")
        assert joins and all("SortMergeJoin" in j for j in joins)
        assert met.count() == 2


def test_scene_numbers_order_ids_without_vectors(spark, monkeypatch):
    from spotweave.operators import segments as seg
    plans, write = [], seg.stage
    monkeypatch.setattr(seg, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    rows = spark.createDataFrame([(1, 1, 0, 1000, 1, "a"), (1, 2, 1500, 2000, 2, "b"), (1, 3, 2500, 3000, 3, "c"), (1, 4, 3500, 4000, None, "d"),
                                  (1, 5, 90_000, 91_000, 3, "e")], "job_id long, seg_id long, start_ms long, end_ms long, vec_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = scene_numbers(rows, vectors).orderBy("seg_id").collect()
    assert [r.scene_no for r in found] == [1, 1, 2, 3, 4]
    assert "embedding" not in plans[0]


def test_frames_move_only_the_columns_asked_for(spark, sf_dir):
    from spotweave.sources import fixtures as fx
    some, whole = fx.frames(spark, sf_dir, "objects"), fx.frames(spark, sf_dir)
    assert some.columns == ["job_id", "frame_index", "ts_ms", "objects"]
    assert "l_quantity" not in some._jdf.queryExecution().executedPlan().toString()
    assert some.exceptAll(whole.select(some.columns)).count() == 0 and some.count() == whole.count() == fx.frame_times(spark, sf_dir).count()
