"""Quality classifier learned from trusted positives and unlabelled text (non-negative PU learning)."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import hash_sample, named

SAMPLE_ROWS = 12_000
HIDDEN = 24
STEPS = 400

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "space", "line_breaks", "non_ascii", "sentence_marks",
            "bars", "other_marks", "distinct_words", "repeated_next", "log_line", "distinct_lines", "marked_words",
            "byte_entropy", "top_byte")


def _classes() -> np.ndarray:
    """Byte -> column of the class matrix: upper, digit, space, line break, non-ASCII, .,;:'"-, |, other marks."""
    table = np.full(256, 8)
    for byte in range(256):
        char = chr(byte)
        if byte >= 128:
            table[byte] = 4
        elif "A" <= char <= "Z":
            table[byte] = 0
        elif char.isdigit():
            table[byte] = 1
        elif char == "\n":
            table[byte] = 3
        elif char.isspace():
            table[byte] = 2
        elif char in ".,;:'\"-":
            table[byte] = 5
        elif char == "|":
            table[byte] = 6
        elif not char.isalpha():
            table[byte] = 7
    return table


_CLASS_OF = _classes()
_MARKS = frozenset(b"!%$#&*|@^~=<>{}[]\\")


def _marked(word: bytes) -> bool:
    return word[-1] in _MARKS


def features(text: str | None) -> list[float]:
    """Shape of the whole text; nothing depends on which words it holds. Null counts as empty."""
    body = (text or "").encode("utf-8", "replace")
    words, lines = body.split(), body.split(b"\n")
    seen = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    size, n, n_lines = max(len(body), 1), max(len(words), 1), len(lines)
    share = seen / size
    by_class = np.bincount(_CLASS_OF, weights=share, minlength=9)
    used = share[share > 0]
    marked = sum(map(_marked, words))
    return [math.log1p(len(body)), math.log1p(len(words)), min(len(body) / n, 40.0), *by_class[:8],
            len(set(words)) / math.pow(n, 0.9), sum(map(operator.eq, words, words[1:])) / n,
            math.log1p(len(body) / n_lines), len(set(lines)) / n_lines, marked / n,
            float(-(used * np.log(used)).sum()), float(share.max())]


@dataclass(frozen=True)
class QualityModel:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        g = np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _matrix(df: DataFrame) -> np.ndarray:
    """Feature rows of a bounded sample."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))})
    rows = df.select("text").mapInArrow(measure, "x array<double>").toArrow().column(0).to_pylist()
    return np.array(sorted(rows)).reshape(-1, len(FEATURES))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 5) -> QualityModel:
    """Minimise the non-negative risk  prior*E_P[l(g)] + max(0, E_U[l(-g)] - prior*E_P[l(-g)])  with the logistic loss.

    Where the estimate of the negatives' risk falls below zero, only that term is ascended, which
    is what keeps a flexible model from explaining the unlabelled positives away.
    """
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / math.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.array(math.log(prior / (1 - prior)))]
    first, second = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    x = np.vstack([p, u])
    in_p, n_p, n_u = np.arange(len(x)) < len(p), len(p), len(u)
    for step in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        g = h @ params[2] + params[3]
        down = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # derivative of l(-g); that of l(g) is down - 1
        loss_negative = np.logaddexp(0, g)
        risk_negative = loss_negative[~in_p].mean() - prior * loss_negative[in_p].mean()
        if risk_negative >= 0:
            slope = np.where(in_p, prior * (down - 1) / n_p - prior * down / n_p, down / n_u)
        else:
            slope = np.where(in_p, prior * down / n_p, -down / n_u)
        back = (slope[:, None] * params[2]) * (1 - h * h)
        gradients = [x.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ slope + 1e-4 * params[2], np.array(slope.sum())]
        rate = 0.03 * (0.1 ** (step / steps))
        for k, gradient in enumerate(gradients):
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient * gradient
            params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return QualityModel(mean, scale, params[0], params[1], params[2], float(params[3]), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Learn from rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, 0/1), both without held-out rows.

    Trusted positives are the documents labelled 1; everything else is unlabelled text. The class
    prior is the labelled rows' share of 1, kept within 0.05 to 0.98 (both classes are labelled alike,
    so it estimates the share of positives in the text). About ``sample_rows`` positives and
    as many unlabelled documents reach the driver, as 18 features each. Null labels and ids are
    ignored; repeated labels of a document count once, as the larger. None without any positive.
    """
    given = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")))
    counted = given.agg(F.count("*").alias("n"), F.sum("_label").alias("ones")).first()
    if not counted["ones"]:
        return None
    prior = min(max(counted["ones"] / counted["n"], 0.05), 0.98)
    chosen = hash_sample(given.filter("_label = 1"), sample_rows, "doc_id")
    positive = _matrix(docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select("text"))
    unlabelled = _matrix(hash_sample(docs.select("doc_id", "text"), sample_rows, "doc_id"))
    return fit_pu(positive, unlabelled, prior) if len(positive) else None


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a document is good, from its whole text alone.

    Null text is scored as empty text. Without a model every score is 0.5. One row per input row;
    a column named like ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    plain = docs.select(*map(named, kept))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    at = kept.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            found = known.score(rows) if known else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*kept, out])

    return plain.mapInArrow(apply, f"{fields}, `{out}` double")
