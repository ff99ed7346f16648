"""Packing documents into fixed-length training sequences by harmonic size classes.

A document's ids are cut into whole sequences and a remainder; the remainder is cut into at most
``CUTS`` pieces of reciprocal size (capacity // k), the last of which may be a little smaller. Pieces of
class k are laid k to a bin in order of arrival, so every worker packs its own documents with one open
bin per class and no exchange of data. What is left in a worker's open bins at the end is chained and
cut at the capacity, the last stretch at powers of two (which need no padding).
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
CUTS = 3
END_ID = 0
FLUSH = 20_000  # output rows held at once
LONG_BLANK = 1000  # white space from here on is cut out before the pattern, which would try each of its ends
# Unicode white space.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{BLANK}]{{{LONG_BLANK},}}")


class Encoder:
    """Ids of whole texts by byte-pair ranks; texts are cut at the added tokens, which have their own ids."""

    def __init__(self, ranks_path: str, pattern: str, added: Mapping[str, int]):
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.added = dict(added)
        # Longer tokens first, as one may begin with another.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for n, part in enumerate(self.cut.split(text) if self.cut else [text]):
            out += [self.added[part]] if n % 2 else self._ordinary(part)
        return out

    def _ordinary(self, text: str) -> list[int]:
        """As ``plain`` has it; a long run of white space is one piece but for its last character, which goes with the word after it."""
        out: list[int] = []
        at = 0
        for run in _BLANKS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += self.plain.encode_ordinary(text[at:run.start()]) + self.whole.encode_ordinary(text[run.start():stop])
            at = stop
        return out + self.plain.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(ranks_path, pattern, dict(added))


def added_tokens(json_path: str) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` file and their ids, as :func:`pack` takes them."""
    with open(json_path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens") or []
    for token in tokens:
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip") or token.get("normalized"):
            raise ValueError(f"added token {token['content']!r} is not matched to the letter")
    return {token["content"]: token["id"] for token in tokens}


def remainder_pieces(length: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[tuple[int, int]]:
    """(class, length) of the pieces a remainder below the capacity is cut into, largest first.

    A piece of class k is at most capacity // k long, so k of them always fit a bin.
    """
    pieces = []
    while length:
        k = capacity // length
        if length == capacity // k or len(pieces) == cuts - 1 or length * length <= capacity:
            pieces.append((k, length))
            break
        pieces.append((k + 1, capacity // (k + 1)))
        length -= capacity // (k + 1)
    return pieces


class _Bins:
    """One worker's open bins; rows are (document, start, ids, document's ids, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.close([(doc, start, ids[start:start + self.capacity], total)])
            start += self.capacity
        for k, length in remainder_pieces(total - start, self.capacity):
            bin_ = self.open.setdefault(k, [])
            # A copy, so that a waiting piece does not hold its whole document.
            bin_.append((doc, start, ids[start:start + length].copy(), total))
            start += length
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        length = sum(len(piece[2]) for piece in left)
        sizes = [self.capacity] * (length // self.capacity)
        length %= self.capacity
        while length:
            sizes.append(1 << (length.bit_length() - 1))
            length -= sizes[-1]
        at, used = 0, 0
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, ids, total = left[at]
                taken = ids[used:used + room]
                pieces.append((doc, start + used, taken, total))
                room -= len(taken)
                used += len(taken)
                if used == len(ids):
                    at, used = at + 1, 0
            self.close(pieces)


def pack(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, added: Mapping[str, int] | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids (or none), ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids followed by ``end_id``; null text counts as empty, so it is the end id
    alone. White space of any length is encoded as the pattern has it. Every id lies in exactly one piece and every sequence has at most ``capacity`` ids, its
    pieces laid gaplessly from offset 0. ``ranks_path`` names a file of byte-pair ranks (base64 token and rank per
    line) that every executor can read, ``pattern`` its splitting pattern. A text is
    cut at the ``added`` tokens first and these get their own ids; without any they are ordinary text. Repeated rows and null keys are packed like any others. Other columns are ignored.

    No shuffle: a lost task is redone from its own split. ``sequence_id`` is the partition's number
    and a running number within it; write the documents first where their order could change between runs.
    A worker holds one document and one bin per class (at most 2 * sqrt(capacity) of them).
    """
    given = tuple(sorted((added or {}).items()))
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, given)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 32)

        def taken() -> pa.RecordBatch:
            rows, bins.rows = bins.rows, []
            columns = {
                "doc_id": pa.array([r[0] for r in rows], key_type), "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([len(r[2]) for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r[2].tobytes()) for r in rows], pa.int64()),
                "doc_tokens": pa.array([r[3] for r in rows], pa.int64()), "sequence_id": pa.array([r[4] for r in rows], pa.int64()),
                "offset": pa.array([r[5] for r in rows], pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(body.as_py() or "")
                ids.append(end_id)
                bins.add(doc, np.array(ids, "<u4"))
                if len(bins.rows) >= FLUSH:
                    yield taken()
        bins.finish()
        if bins.rows:
            yield taken()

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                                   "offset long" + (", ids array<int>" if with_ids else ""))
