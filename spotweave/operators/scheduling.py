"""Ordered greedy scheduling as folds over blocks of overlays.

The greedy rules look at the last kept overlay only. A job is cut wherever an overlay starts beyond the reach of everything
before it; what follows does not depend on what came before, so the islands between the cuts are independent. An island longer than
a block is many tasks: a block maps the overlay it is entered with to the one it is left with, every block is first folded as if it
began the island, and then only those are folded again whose true entry turns out to be another one. Entries are followed
from block to block over one row each; a block in which nothing can answer its entry is passed without being read. A task reads its block
in order and holds one overlay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators.ordered import running_max_before, running_totals, span_chunk
from spotweave.operators.skew import pick_by
from spotweave.session import stage
from spotweave.settings import SCHEDULE, ScheduleSettings

BLOCK_ITEMS = 65_536


class Item(NamedTuple):
    start_ms: int
    item_id: str
    end_ms: int
    score: int
    interval_ms: int | None


class Extent(NamedTuple):
    """What a block holds at most or at least; enough to tell that an overlay goes through it untouched."""

    last_start: int
    best_score: int
    least_interval: int | None


FOLLOW, REPLACE, SKIP = range(3)


class Rule(NamedTuple):
    """``step``: (last kept, kept in its hour, next) -> what becomes of the next, and the new number in the hour.

    ``passes``: (last kept, extent of a block) -> certainly no item of the block follows or replaces it.
    """

    step: Callable[[Item, int, Item], tuple[int, int]]
    passes: Callable[[Item, Extent], bool]


def _better(last: Item, in_hour: int, item: Item) -> tuple[int, int]:
    if item.start_ms >= last.end_ms:
        return FOLLOW, 0
    return (REPLACE if item.score > last.score else SKIP), 0


#: Overlapping neighbours: the better one stays.
PREFER_BETTER = Rule(_better, lambda last, block: block.last_start < last.end_ms and block.best_score <= last.score)
#: Overlapping neighbours: the earlier one stays.
PREFER_EARLIER = Rule(lambda last, in_hour, item: (FOLLOW if item.start_ms >= last.end_ms else SKIP, 0),
                      lambda last, block: block.last_start < last.end_ms)


def keep_apart(cfg: ScheduleSettings = SCHEDULE) -> Rule:
    """Neighbours closer than the interval: the better one stays, a replacement not counting anew within its hour; and
    at most ``max_per_hour`` per clock hour of the video."""
    def step(last: Item, in_hour: int, item: Item) -> tuple[int, int]:
        together = item.start_ms // cfg.hour_ms == last.start_ms // cfg.hour_ms
        if item.start_ms - last.start_ms < item.interval_ms:
            return (REPLACE, in_hour if together else 1) if item.score > last.score else (SKIP, in_hour)
        full = together and in_hour >= cfg.max_per_hour
        return (SKIP, in_hour) if full else (FOLLOW, in_hour + 1 if together else 1)

    return Rule(step, lambda last, block: block.last_start - last.start_ms < block.least_interval and block.best_score <= last.score)


_ENTRY = [f"in_{f}" for f in Item._fields]
_EXIT = [f"out_{f}" for f in Item._fields]
_STATE = "{0}_start_ms long, {0}_item_id string, {0}_end_ms long, {0}_score long, {0}_interval_ms long, {0}_hour long"
_BLOCK = ["job_id", "island", "block"]


def _blocks(items: DataFrame, reach: Column, cfg: ScheduleSettings, size: int) -> DataFrame:
    """Number the islands of each job, where an item starts at or after the reach of all before it, and the blocks by items of the job."""
    chunk, order = span_chunk("start_ms", cfg.hour_ms), ["start_ms", "item_id"]
    rows = running_max_before(items.withColumn("_reach", reach), ["job_id"], chunk, order, "_reach", "_before")
    opens = F.coalesce(F.col("start_ms") >= F.col("_before"), F.lit(True)).cast("long")
    rows = stage(rows.withColumn("_opens", opens).drop("_reach", "_before"), "islands")
    numbered = running_totals(rows, ["job_id"], chunk, order, {"island": F.col("_opens"), "_nth": F.lit(1)})
    return numbered.withColumn("block", F.floor((F.col("_nth") - 1) / size)).select(*_BLOCK, *Item._fields)


def _fold(blocks: DataFrame, rule: Rule, job_type: str) -> DataFrame:
    """Fold every block from its entry: the items it settles (``out_hour`` NULL) and, last, the state it is left with.

    ``blocks`` carries the entry on each row (in_*, NULL for none). A kept item is settled once another follows it, so what
    a block is left with is settled by a later block or, in the last one, by the caller.
    """
    dealt = blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "start_ms", "item_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, in_hour, schema = None, None, 0, None

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            schema = pa.schema([("job_id", batch.schema.field("job_id").type), ("island", pa.int64()), ("block", pa.int64()), ("out_start_ms", pa.int64()),
                                ("out_item_id", pa.string()), ("out_end_ms", pa.int64()), ("out_score", pa.int64()), ("out_interval_ms", pa.int64()),
                                ("out_hour", pa.int64())])
            settled = []
            for job, island, block, *values in zip(*(column.to_pylist() for column in batch.columns)):
                if (job, island, block) != current:
                    if current is not None:
                        settled.append((*current, *last, in_hour))
                    current, item = (job, island, block), Item(*values[:5])
                    entry, in_hour = Item(*values[5:10]), values[10]
                    last = entry if in_hour is not None else None
                else:
                    item = Item(*values[:5])
                fate, count = (FOLLOW, 1) if last is None else rule.step(last, in_hour, item)
                if fate == FOLLOW and last is not None:
                    settled.append((*current, *last, None))
                if fate != SKIP:
                    last, in_hour = item, count
            if settled:
                yield packed(settled)
        if current is not None:
            yield packed([(*current, *last, in_hour)])

    return dealt.select(*_BLOCK, *Item._fields, *_ENTRY, "in_hour").mapInArrow(
        work, f"job_id {job_type}, island long, block long, " + _STATE.format("out"))


def _no_entry(blocks: DataFrame) -> DataFrame:
    kinds = dict(blocks.dtypes)
    return blocks.select("*", *[F.lit(None).cast(kinds[f]).alias(f"in_{f}") for f in Item._fields], F.lit(None).cast("long").alias("in_hour"))


def _wanted_entries(extents: DataFrame, states: DataFrame, rule: Rule, job_type: str) -> DataFrame:
    """Follow the state from block to block of each island: per block its entry, whether it is passed, and whether it is to be folded again.

    ``extents``: one row per block; ``states``: the entry each block was folded with last and what it was left with. Where a
    block has not been folded with its true entry, its last known exit is taken for the time being.
    """
    names = [*_ENTRY, "in_hour"]
    left_names = [*_EXIT, "out_hour"]

    def walk(rows: pa.Table) -> pa.Table:
        state: tuple = (None,) * len(names)
        out = []
        for row in sorted(rows.to_pylist(), key=lambda r: r["block"]):
            left, again, passed = tuple(row[n] for n in left_names), False, False
            if tuple(row[n] for n in names) != state:
                entry = Item(*state[:-1])
                passed = state[-1] is not None and rule.passes(entry, Extent(row["last_start"], row["best_score"], row["least_interval"]))
                left, again = (state, False) if passed else (left, True)
            out.append((*(row[n] for n in _BLOCK), *state, *left, again, passed))
            state = left
        kinds = [rows.schema.field(n).type for n in (*_BLOCK, *names, *left_names)] + [pa.bool_()] * 2
        columns = [*_BLOCK, *names, *left_names, "again", "passed"]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=columns)

    return extents.join(states, _BLOCK).groupBy("job_id", "island").applyInArrow(
        walk, f"job_id {job_type}, island long, block long, {_STATE.format('in')}, {_STATE.format('out')}, again boolean, passed boolean")


def fold_blocks(items: DataFrame, rule: Rule, reach: Column, cfg: ScheduleSettings = SCHEDULE, size: int | None = None) -> DataFrame:
    """Run a rule over each job's items in (start_ms, item_id) order; returns job_id, start_ms, item_id of the kept ones.

    ``items``: job_id, start_ms, item_id, end_ms, score, interval_ms. An item must not influence anything that starts at or
    after its ``reach``.
    """
    job_type = items.schema["job_id"].dataType.simpleString()
    blocks = stage(_blocks(items, reach, cfg, size or BLOCK_ITEMS), "blocks")
    kept = ["job_id", F.col("out_start_ms").alias("start_ms"), F.col("out_item_id").alias("item_id")]
    once = _fold(_no_entry(blocks), rule, job_type)
    if not blocks.agg(F.max("block")).first()[0]:
        return once.select(*kept)
    found = stage(once, "folded")
    extents = blocks.groupBy(*_BLOCK).agg(F.max("start_ms").alias("last_start"), F.max("score").alias("best_score"), F.min("interval_ms").alias("least_interval"))
    several = extents.groupBy("job_id", "island").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    long = stage(extents.join(several, ["job_id", "island"]), "long-islands")
    if long.isEmpty():
        return found.select(*kept)
    blank = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in _STATE.format("in").split(", ")]
    states = found.filter("out_hour IS NOT NULL").join(long.select(*_BLOCK), _BLOCK, "left_semi").select(*_BLOCK, *blank, *_EXIT, "out_hour")
    # Every round makes at least one more block of each island final, usually all of them.
    while True:
        walked = stage(_wanted_entries(long, states, rule, job_type), "entries")
        again = walked.filter("again")
        if again.isEmpty():
            break
        entries = again.select(*_BLOCK, *_ENTRY, "in_hour")
        redone = stage(_fold(blocks.join(entries, _BLOCK), rule, job_type), "folded")
        # Settled items of an older folding of the same block go.
        found = stage(found.join(entries.select(*_BLOCK), _BLOCK, "left_anti").unionByName(redone), "folded")
        fresh = redone.filter("out_hour IS NOT NULL").join(entries, _BLOCK)
        states = stage(states.join(entries.select(*_BLOCK), _BLOCK, "left_anti").unionByName(fresh.select(*states.columns)), "states")
    in_long = found.join(several, ["job_id", "island"], "left_semi")
    settled = in_long.filter("out_hour IS NULL").join(walked.filter("passed").select(*_BLOCK), _BLOCK, "left_anti")
    ends = walked.groupBy("job_id", "island").agg(F.max_by(F.struct("out_start_ms", "out_item_id"), "block").alias("last")).select("job_id", "last.*")
    short = found.join(several, ["job_id", "island"], "left_anti")
    return short.select(*kept).unionByName(settled.select(*kept)).unionByName(ends.select(*kept))


def _as_items(overlays: DataFrame, interval: Column | None = None) -> DataFrame:
    return overlays.select(
        "job_id", F.col("overlay_start_ms").alias("start_ms"), F.col("item_id").cast("string").alias("item_id"),
        (F.col("overlay_start_ms") + F.col("overlay_ms")).alias("end_ms"), F.col("score").cast("long").alias("score"),
        (F.lit(None).cast("long") if interval is None else interval.cast("long")).alias("interval_ms"))


def _keep(overlays: DataFrame, kept: DataFrame) -> DataFrame:
    chosen = kept.select("job_id", F.col("start_ms").alias("overlay_start_ms"), "item_id")
    return overlays.join(chosen, ["job_id", "overlay_start_ms", "item_id"], "left_semi")


def best_per_scene(scored: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Best ad of each (job, scene), if it reaches the minimum score; ties go to the lower ad id."""
    best = pick_by(scored, ["job_id", "start_ms"], [-F.col("score"), F.col("ad_id")])
    return best.filter(F.col("score") >= cfg.min_score)


def drop_overlaps(overlays: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Remove overlaps in start order, the better of two neighbours staying.

    ``overlays``: job_id, item_id (unique per job, breaks ties), overlay_start_ms, overlay_ms, score, ...
    """
    return _keep(overlays, fold_blocks(_as_items(overlays), PREFER_BETTER, F.col("end_ms"), cfg))


def drop_earlier(overlays: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Skip what starts before the last kept overlay ends."""
    return _keep(overlays, fold_blocks(_as_items(overlays), PREFER_EARLIER, F.col("end_ms"), cfg))


def _with_duration(overlays: DataFrame, info: DataFrame) -> DataFrame:
    known = info.select("job_id", F.col("duration_ms").alias("_duration"))
    return overlays.join(known, "job_id", "left")


def cold_zones(overlays: DataFrame, info: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Drop overlays starting in the protected beginning or end of the video."""
    rows = _with_duration(overlays, info)
    known = F.coalesce(F.col("_duration") > 0, F.lit(False))
    zone = F.when(~known, F.lit(cfg.cold_unknown_ms))
    for upto, protected in cfg.cold_tiers:
        zone = zone.when(F.col("_duration") <= upto, F.lit(protected))
    zone = zone.otherwise(F.lit(cfg.cold_rest_ms))
    inside = (F.col("overlay_start_ms") >= zone) & (
        ~known | (F.col("overlay_start_ms") <= F.col("_duration") - zone))
    return rows.filter(inside).drop("_duration")


def min_interval(duration_ms: Column, cfg: ScheduleSettings = SCHEDULE) -> Column:
    stepped = F.lit(cfg.interval_unit_ms) * (F.floor(duration_ms / cfg.interval_step_ms) + 1)
    return F.when(F.coalesce(duration_ms > 0, F.lit(False)), F.least(F.lit(cfg.interval_max_ms), F.greatest(
        F.lit(cfg.interval_unit_ms), stepped))).otherwise(F.lit(cfg.interval_unknown_ms))


def space_out(overlays: DataFrame, info: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Apply the minimum interval and the hourly cap."""
    rows = _with_duration(overlays, info).withColumn("_interval", min_interval(F.col("_duration"), cfg))
    return spaced(rows.drop("_duration"), cfg).drop("_interval")


def spaced(overlays: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Spacing by the ``_interval`` column. The count of an hour carries on to its end, so that is how far an item reaches."""
    hour_end = (F.floor(F.col("start_ms") / cfg.hour_ms) + 1) * cfg.hour_ms
    reach = F.greatest(F.col("start_ms") + F.col("interval_ms"), hour_end)
    return _keep(overlays, fold_blocks(_as_items(overlays, F.col("_interval")), keep_apart(cfg), reach, cfg))


def unique_ads(overlays: DataFrame) -> DataFrame:
    """First placement of each ad per job."""
    return pick_by(overlays, ["job_id", "ad_id"], [F.col("overlay_start_ms"), F.col("item_id")])


def schedule(scored: DataFrame, info: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Scored overlays to the final schedule of every job."""
    best = stage(best_per_scene(scored, cfg).withColumn("item_id", F.col("start_ms").cast("string")), "best")
    clear = stage(cold_zones(drop_overlaps(best, cfg), info, cfg), "clear")
    return unique_ads(space_out(clear, info, cfg)).drop("item_id")


def serve_overlays(rows: DataFrame, cfg: ScheduleSettings = SCHEDULE) -> DataFrame:
    """Serving rule: best score per exact start, then skip what starts before the last one ends."""
    best = pick_by(rows, ["job_id", "overlay_start_ms"], [-F.col("score"), F.col("decision_id")])
    return drop_earlier(best.withColumn("item_id", F.col("decision_id").cast("string")), cfg).drop("item_id")
