"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # runs of anything but ASCII white space
_FINE = 1 << 30
SLICE_BYTES = 1 << 20  # of Arrow data worked on at once, where what is made of it is large


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents no model may learn from; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def named(column: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def keep_columns(df: DataFrame, *replaced: str) -> Column:
    """All columns but those replaced as one struct, so they cannot clash with working columns."""
    return F.struct(*[named(c) for c in df.columns if c not in replaced])


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows, all of them where there are fewer, chosen by a hash of their key.

    The choice depends on the keys alone, so a rerun or a lost executor gets the same rows; it
    takes a threshold on the hash, so nothing is sorted or gathered.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(_FINE)) < int(rows / total * _FINE))


def sliced(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``size`` bytes by a batch's mean row, one row at least.

    A batch of Spark's has 10,000 rows whatever they hold. What a task yields for a slice is sent off before the next one, so
    neither the Python worker nor the executor that reads from it holds the results of a whole batch.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
