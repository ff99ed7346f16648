"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors within cosine s lie within epsilon = sqrt(2 - 2 s) of each other, in every orthonormal projection too.
Vectors are projected on the leading principal directions, sorted by the cells of a grid of side epsilon, and the
sorted sequence is cut into blocks. A tree of sequence intervals over the blocks keeps the bounding box of each
interval; interval pairs are joined level by level and pairs whose boxes are more than epsilon apart are
dropped with everything below them. What remains are block pairs, compared in double precision.

Equal vectors are one point; links are counted inside the block tasks and only a spanning forest of them leaves, so a
dense group of n vectors costs n rows and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from spotweave.llm.common import hash_sample
from spotweave.llm.components import components
from spotweave.session import stage

COSINE = 0.98
BLOCK_ROWS = 4096
GRID_DIMENSIONS = 6
BOX_DIMENSIONS = 16
FIT_ROWS = 4096
FAN_OUT = 8
LEAF = 64  # rows below which an interval is compared rather than split
SLACK = 1e-6  # boxes hold rounded coordinates: keep pairs this much beyond epsilon


def principal_directions(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Orthonormal columns, leading directions of the sample first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :wanted]
    _, _, right = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    rest = right[:wanted].T
    if rest.shape[1] < min(wanted, sample.shape[1]):
        rest = np.linalg.qr(np.hstack([rest, np.eye(sample.shape[1])]))[0][:, :wanted]
    return rest


def _unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / big
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.sqrt((a * a).sum(axis=1))[:, None] / np.sqrt((b * b).sum(axis=1))[None, :]


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of the bounding boxes of two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap)


def interval_links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (rows of a, rows of b) within the cosine; intervals are halved until small, distant ones skipped.

    With ``same`` both are one block and each pair comes once, the first index being the smaller.
    """
    limit = 2 - 2 * cosine + SLACK
    pending = [(0, len(a), 0, len(b))]
    while pending:
        a0, a1, b0, b1 = pending.pop()
        if same and a0 > b0 or _apart(pa_[a0:a1], pb[b0:b1]) > limit:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            near = cosines(a[a0:a1], b[b0:b1]) >= cosine
            if same and a0 == b0:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield i + a0, j + b0
            continue
        halves_a = [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)] if a1 - a0 > LEAF else [(a0, a1)]
        halves_b = [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > LEAF else [(b0, b1)]
        pending += [(*x, *y) for x in halves_a for y in halves_b]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], found: list) -> np.ndarray:
    """Spanning forest edges of the pairs; ``found`` gets every pair array.

    Every point carries the number of its tree; only pairs across trees are looked at one by one, and each of them joins two.
    """
    tree = np.arange(n)
    edges = []
    for i, j in pairs:
        found.append((i, j))
        while len(apart := np.flatnonzero(tree[i] != tree[j])):
            # One pair of each tree on the first side: these trees hang on to the others' all at once if they form no circle.
            _, at = np.unique(tree[i[apart]], return_index=True)
            for k in apart[at].tolist():
                a, b = int(tree[i[k]]), int(tree[j[k]])
                if a != b:
                    tree[tree == a] = b
                    edges.append((int(i[k]), int(j[k])))
            i, j = i[apart], j[apart]
    return np.array(edges, np.int64).reshape(-1, 2)


def _points(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """Vectors that can link: label, id and embedding not null, all components finite, not all zero."""
    body = F.col(embedding)
    return (vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), body.alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
            .filter(F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
            .filter(F.exists("vector", lambda x: x != 0)))


def _blocks(points: DataFrame, cosine: float, block_rows: int) -> DataFrame:
    """Blocks of the sequence in epsilon grid order: place, label and length range, box, ids and vectors."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    sample = hash_sample(points.select("low", "vector"), FIT_ROWS, "low").select("vector").toArrow().column(0).to_pylist()
    by_length: dict[int, list] = {}
    for row in sorted(sample):
        by_length.setdefault(len(row), []).append(row)
    basis = {n: principal_directions(_unit(np.array(rows, float)), BOX_DIMENSIONS) for n, rows in by_length.items()}
    shared = points.sparkSession.sparkContext.broadcast(basis)

    def project(rows: np.ndarray) -> np.ndarray:
        # Lengths the sample has missed use their first coordinates, an orthonormal projection as well.
        directions = shared.value.get(rows.shape[1])
        out = _unit(rows)
        out = out[:, :BOX_DIMENSIONS] if directions is None else out @ directions
        return np.pad(out, ((0, 0), (0, BOX_DIMENSIONS - out.shape[1])))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            lengths = np.array([len(v) for v in columns["vector"]], np.int64)
            where = np.zeros((len(lengths), BOX_DIMENSIONS))
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                where[at] = project(np.array([columns["vector"][i] for i in at], float))
            cells = np.floor(where[:, :GRID_DIMENSIONS] / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "low": batch.column(batch.schema.get_field_index("low")), "copies": pa.array(columns["copies"], pa.int64()),
                "grp": pa.array([f"{n}:{name}" for n, name in zip(lengths, columns["label"])], pa.string()),
                "cell": pa.array(cells.tolist(), pa.list_(pa.int64())), "place": pa.array(where.tolist(), pa.list_(pa.float64())),
                "body": pa.array([np.array(v, kind).tobytes() for v in columns["vector"]], pa.binary())})

    kind = "<f4" if points.schema["vector"].dataType.elementType == FloatType() else "<f8"
    located = points.select("low", "copies", F.col("label").cast("string").alias("label"), "vector").mapInArrow(
        locate, "low long, copies long, grp string, cell array<long>, place array<double>, body binary")
    total = points.count()
    parts = max(1, min(-(-total // (4 * block_rows)), 20_000))
    ordered = located.repartitionByRange(parts, "grp", "cell", "low").sortWithinPartitions("grp", "cell", "low")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, held = TaskContext.get().partitionId(), 0, None

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            where = np.array(rows.column("place").to_pylist())
            number += 1
            return pa.RecordBatch.from_pydict({
                "part": [part], "number": [number], "grp": [rows.column("grp")[0].as_py()], "box_low": [where.min(axis=0).tolist()],
                "box_high": [where.max(axis=0).tolist()], "ids": [np.array(rows.column("low").to_pylist(), "<i8").tobytes()],
                "copies": [np.array(rows.column("copies").to_pylist(), "<i8").tobytes()], "place": [where.astype("<f8").tobytes()],
                "vectors": [b"".join(rows.column("body").to_pylist())]},
                schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("grp", pa.string()), ("box_low", pa.list_(pa.float64())),
                                  ("box_high", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()),
                                  ("place", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows:
                names = held.column("grp").to_numpy(zero_copy_only=False)
                other = np.flatnonzero(names[:block_rows + 1] != names[0])
                size = int(other[0]) if len(other) else block_rows
                if not len(other) and held.num_rows <= block_rows:
                    break
                yield block(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield block(held)

    return ordered.mapInArrow(cut, "part long, number long, grp string, box_low array<double>, box_high array<double>, ids binary, "
                                   "copies binary, place binary, vectors binary")


def _near(limit: float):
    """Two intervals a and b can hold a pair: a common label and boxes no further apart than the limit."""
    gaps = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y),
                      lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return ((F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
            & (F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= limit))


def _block_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """(a, b), a <= b: blocks that may hold a pair, found by joining sequence intervals from the root down."""
    leaves = stage(blocks.select("block", F.col("grp").alias("first"), F.col("grp").alias("last"),
                                 F.col("box_low").alias("low"), F.col("box_high").alias("high")), "grid-boxes")
    top = leaves.agg(F.max("block")).first()[0]
    levels, span = [leaves.withColumnRenamed("block", "node")], 1
    sides = range(BOX_DIMENSIONS)
    while top is not None and span <= top:
        span *= FAN_OUT
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN_OUT).alias("node")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.array(*[F.min(F.col("low")[i]) for i in sides]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in sides]).alias("high")))
    limit = 2 - 2 * cosine + SLACK
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for depth, level in enumerate(reversed(levels[:-1])):
        below = level.withColumn("up", F.floor(F.col("node") / FAN_OUT))
        side = {s: below.select(F.col("up").alias(f"{s}_up"), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "first", "last", "low", "high")]) for s in "ab"}
        pairs = (pairs.join(side["a"], pairs["a"] == side["a"]["a_up"]).join(side["b"], F.col("b") == F.col("b_up"))
                 .filter((F.col("a_node") <= F.col("b_node")) & _near(limit))
                 .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
        if depth % 3 == 2:
            pairs = stage(pairs, "grid-pairs")
    return pairs


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label (not null) and one length link at ``cosine`` or more, in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do rows with a null label or id. Rows that repeat
    vector and label count as separate vectors; rows that share an id but not the vector may share links
    and component. A null id has a null component and is not kept. Ids are whole numbers.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    usable = _points(vectors, key, embedding, label)
    points = stage(usable.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("copies")), "grid-points")
    cut = stage(_blocks(points, cosine, block_rows), "grid-blocks")
    # Running number of the blocks in sequence; one row per partition goes through the window.
    counts = cut.groupBy("part").agg(F.max("number").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    blocks = stage(cut.join(before, "part").withColumn("block", F.col("base") + F.col("number") - 1), "grid-sequence")

    kind = "<f4" if points.schema["vector"].dataType.elementType == FloatType() else "<f8"
    body = blocks.select("block", "ids", "copies", "place", "vectors")
    right = body.select(*[F.col(c).alias(f"{c}_b") for c in body.columns])
    # Written, as their number decides how they are dealt out.
    near_blocks = stage(_block_pairs(blocks, cosine), "grid-near")
    pairs = (near_blocks.join(body, F.col("a") == F.col("block")).join(right, F.col("b") == F.col("block_b"))
             .select("a", "b", "ids", "copies", "place", "vectors", "ids_b", "copies_b", "place_b", "vectors_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {c: batch.column(i)[row].as_py() for i, c in enumerate(batch.schema.names)}
                same = value["a"] == value["b"]
                ids, ids_b = (np.frombuffer(value[c], "<i8") for c in ("ids", "ids_b"))
                many, many_b = (np.frombuffer(value[c], "<i8") for c in ("copies", "copies_b"))
                x, y = (np.frombuffer(value[c], kind).astype(np.float64).reshape(len(n), -1) for c, n in (("vectors", ids), ("vectors_b", ids_b)))
                px, py = (np.frombuffer(value[c], "<f8").reshape(len(n), -1) for c, n in (("place", ids), ("place_b", ids_b)))
                shift = 0 if same else len(ids)
                found: list = []
                edges = _forest(shift + len(ids_b), ((i, j + shift) for i, j in interval_links(x, y, px, py, same, cosine)), found)
                if not found:
                    continue
                everyone = ids if same else np.concatenate([ids, ids_b])
                weight = many if same else np.concatenate([many, many_b])
                i, j = (np.concatenate(side) for side in zip(*found))
                # Sums of whole numbers, which doubles hold exactly here.
                links = (np.bincount(i, weight[j], len(everyone)) + np.bincount(j, weight[i], len(everyone))).astype(np.int64)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({
                    "u": pa.array(np.concatenate([everyone[at], everyone[edges[:, 0]]]), pa.int64()),
                    "v": pa.array([None] * len(at) + everyone[edges[:, 1]].tolist(), pa.int64()),
                    "links": pa.array(links[at].tolist() + [None] * len(edges), pa.int64())})

    # Block pairs are few and heavy: spread them evenly.
    spread = max(1, min(near_blocks.count(), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    found = stage(pairs.repartition(spread).mapInArrow(compare, "u long, v long, links long"), "grid-links")
    tallies = found.filter(F.col("v").isNull()).groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.filter(F.col("v").isNotNull()).select("u", "v"), "grid-components")
    nodes = (points.join(tallies, points["low"] == tallies["u"], "left").join(roots, points["low"] == roots["node"], "left")
             .select(F.col("label").alias("_label"), F.col("vector").alias("_vector"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "low").alias("root")))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("vector"))
    return (rows.join(nodes, F.col("id").isNotNull() & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
