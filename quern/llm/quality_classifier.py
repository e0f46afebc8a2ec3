"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features. From pairs of one
better and one worse document the weights are learnt by logistic loss on the
difference of the features, so only the order within pairs counts. The score is
the strength put on a 0 to 1 scale whose mark of 0.3 lies at the quantile of the
training strengths that equals the share of worse documents: documents below the
quantile are predicted 0.

Labels are learnt from a bounded sample (``TRAIN_DOCS`` documents, by a hash of
the id) outside the held-out fold; everything else covers all documents. Inputs
of a score are counts of the whole text alone.

Results for odd input: a null or empty text has zero features and is scored as
such; without labels of both kinds all scores are 0.5; null ids fall in the
held-out fold; repeated rows give repeated results; an empty table gives an
empty table; further columns are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_fold, discard, hash63, hash_mark, sized, texts, written
from quern.llm.textstats import CLASSES, base_counts, class_counts

#: Labelled documents that the weights are learnt from, at most (expected; by hash), and pairs drawn from them.
TRAIN_DOCS = 8_000
PAIRS = 40_000

FOLDS = 5
MARK = 0.3
RIDGE = 1e-3
STEPS = 30

FEATURES = (
    *(f"share_{c}" for c in CLASSES),
    "symbols_per_word",
    "repeated_share",
    "dup_line_share",
    "distinct_share",
    "top_word_share",
    "mean_word",
    "spread_word",
    "single_share",
    "bang_share",
    "bar_share",
    "log_words",
    "short",
)


def features(text: str | None) -> np.ndarray:
    """Counts of the whole text, scaled so that one unit means much the same everywhere."""
    data = (text or "").encode("utf-8", "replace")
    words, byte_n, counts = base_counts(data)
    n = len(words)
    out = np.zeros(len(FEATURES))
    if not n:
        return out
    classes = class_counts(byte_n)
    sizes = np.fromiter(map(len, words), np.float64, n)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = data.count(b"\n") + 1
    out[: len(CLASSES)] = np.sqrt(classes / classes.sum())
    out[len(CLASSES) :] = (
        math.sqrt(min(4.0, counts["n_symbols"] / n)),
        counts["n_repeat_words"] / n,
        counts["n_dup_lines"] / lines,
        len(tally) / n**0.8,
        max(tally.values()) / n,
        math.log1p(sizes.mean()),
        math.log1p(sizes.std()),
        float((sizes == 1).mean()),
        math.sqrt(min(1.0, byte_n[33] / n)),
        math.sqrt(min(1.0, byte_n[124] / n)),
        math.log1p(n) / 10,
        1.0 if n < 30 else 0.0,
    )
    return out


class Ranker:
    """Weights on standardised features, and the quantile that the scale is fixed at."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, width: float):
        self.mean, self.spread, self.weights, self.cut, self.width = mean, spread, weights, cut, width

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; MARK at the quantile."""
        strength = ((x - self.mean) / self.spread) @ self.weights
        z = np.clip((strength - self.cut) / self.width + math.log(MARK / (1 - MARK)), -40, 40)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, better: np.ndarray, seed: int = 7) -> Ranker:
    """Learns the weights from pairs by Newton steps on the logistic loss of feature differences."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(better == 1), np.flatnonzero(better == 0)
    if not len(good) or not len(bad):
        level = math.log(MARK / (1 - MARK))
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), level, 1.0)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    pairs = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(d)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(pairs @ w, -40, 40)))
        gradient = pairs.T @ (p - 1) / PAIRS + RIDGE * w
        curve = (pairs * (p * (1 - p))[:, None]).T @ pairs / PAIRS + RIDGE * np.eye(d)
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    strength = z @ w
    cut = float(np.quantile(strength, len(bad) / len(x)))
    return Ranker(mean, spread, w, cut, max(1e-6, float(strength.std()) / 2))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fits on at most about TRAIN_DOCS labelled documents outside the held-out fold; of rows that share an id one counts.

    An id is in the sample if its hash is below a threshold that makes TRAIN_DOCS
    the expected number at any size. The sample's ids are bounded, so they are broadcast.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
    known = known.where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & (crc_fold(F.col("__id"), FOLDS) != 0))
    known = written(known.groupBy("__id").agg(F.min("__label").alias("__label")), "labels")
    sample = known.where(hash63("__id") < hash_mark(TRAIN_DOCS / max(1, known.count())))
    rows = docs.select(F.col(id_col).cast("long").alias("__id2"), F.col(text_col).alias("__text"))
    rows = rows.join(sized(sample), F.col("__id") == F.col("__id2")).select("__id", "__label", "__text")
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, list[float]]] = {}
        for batch in batches:
            for at, label, text in zip(*(texts(batch.column(i)) for i in range(3)), strict=True):
                found = (label, features(text).tolist())
                own[at] = min(found, own.get(at, found))
        columns = [pa.array(own, pa.int64()), *(pa.array([v[i] for v in own.values()], schema.field(i + 1).type) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    one = rows.mapInArrow(run, "id long, label int, x array<double>").groupBy("id").agg(F.min(F.struct("label", "x")).alias("own"))
    got = sorted((r["label"], tuple(r["x"])) for r in one.select("own.label", "own.x").collect())
    discard(known)
    x = np.array([v for _, v in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([y for y, _ in got], int))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, held_out, score, predicted)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in texts(batch.column(2))]).reshape(-1, len(FEATURES))
            s = ranker.scores(x)
            columns = [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= MARK).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (crc_fold(F.col(id_col), FOLDS) == 0).alias("held_out"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
