"""Language identification: multinomial naive Bayes over hashed character trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import hash_sample, named, sliced

BUCKETS = 1 << 14
SAMPLE_ROWS = 20_000
MAX_LANGUAGES = 1_000
SLICE_CHARS = 1 << 21  # characters worked on at once, bounds a worker's memory
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the character trigrams of the whole text, in bounded slices.

    Lower-cased; anything but letters counts as a space; trigrams around a space are left out.
    """
    table = _letter_table()
    for begin in range(0, max(len(text), 1), SLICE_CHARS):
        # Slices overlap by two characters, so no trigram is lost or counted twice.
        part = text[begin:begin + SLICE_CHARS + 2].lower()
        codes = np.frombuffer(f" {part} ".encode("utf-32-le") if len(text) <= SLICE_CHARS else part.encode("utf-32-le"), np.uint32)
        codes = np.where(table[codes], codes, np.uint32(32))
        mixed = (codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519)) * np.uint32(3266489917) + codes[2:] * np.uint32(668265263)
        mixed ^= mixed >> np.uint32(15)
        yield ((mixed * np.uint32(2654435761)) >> np.uint32(18))[codes[1:-1] != 32]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and their log probabilities per trigram bucket; the last row of scores is the prior."""

    languages: tuple[str, ...]
    log_probability: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """Most likely language and its posterior probability; ``und`` and 0 for null or letterless text."""
        if text is None or not self.languages or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0
        total = self.log_prior.copy()
        for buckets in trigrams(text):
            if len(buckets) > BUCKETS:
                seen = np.bincount(buckets, minlength=BUCKETS)
                total += seen @ self.log_probability
            else:
                total += self.log_probability[buckets].sum(axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, smoothing: float = 0.2) -> LanguageModel:
    """Learn from a hash sample of about ``sample_rows`` rows with a language and a text.

    Each task adds its documents' trigrams up to one row of counts per language; those rows are
    added up by Spark per language and the driver gets one row of 16,384 counts for each of at most
    ``MAX_LANGUAGES`` languages (more raise an error). Rows with null text or language are not
    used; without any row the model knows no language and predicts ``und``.
    """
    rows = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    sample = hash_sample(rows, sample_rows, "key").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in sliced(batches):
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in seen:
                    seen[name] = np.zeros(BUCKETS, np.int64)
                for buckets in trigrams(body):
                    seen[name] += np.bincount(buckets, minlength=BUCKETS)
                docs[name] = docs.get(name, 0) + 1
        for name, row in seen.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(used) + 1), "bucket": np.append(used, -1).astype(np.int32),
                                              "n": np.append(row[used], docs[name])})

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    found = packed.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(row["lang"] for row in found)
    table, prior = np.full((BUCKETS, len(names)), smoothing), np.zeros(len(names))
    for row in found:
        at = names.index(row["lang"])
        for bucket, n in row["cells"]:
            if bucket < 0:
                prior[at] = n
            else:
                table[bucket, at] += n
    return LanguageModel(tuple(names), np.log(table / table.sum(axis=0)) if names else table, np.log(prior / prior.sum()) if names else prior)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability, over whole texts.

    The log-probability matrix (128 KB per language) is broadcast. Null texts and texts without a
    letter get ``und`` and 0. Every row gives one row; columns of the two new names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (language, score)]
    plain = docs.select(*map(named, kept))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    at = kept.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches):
            found = [known.predict(body) for body in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*kept, language, score])

    return plain.mapInArrow(predict, f"{fields}, `{language}` string, `{score}` double")
