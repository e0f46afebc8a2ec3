"""Hierarchical language identification.

Level one predicts the family of a document's language, level two separates the
languages of that family. Both levels are one-versus-one linear support vector
machines (squared hinge loss, trained by dual coordinate descent) on hashed
letter n-grams of lengths 1 to 3 of the whole text.

The machines are fitted on a bounded sample (``TRAIN_DOCS`` documents shared by
the languages, by a hash of the id) of labelled rows outside the held-out fold;
predictions cover all documents and use the text alone.

Results for odd input: a null text, or one without any letter, is ``und`` with
score 0; languages that no family lists are families of their own; without
labelled rows everything is ``und``; very long texts are counted in pieces;
repeated rows give repeated results; an empty table gives an empty table;
further columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_fold, discard, hash63, hash_mark, texts, written

#: Documents in the training sample, at most (expected; by hash).
TRAIN_DOCS = 3_000

#: Least share of the labelled rows for a language to be learnt: at most 1 / LANG_SHARE classes.
LANG_SHARE = 0.005

#: Hashed n-gram bins.
BINS = 4_096

#: Characters counted at a time.
PIECE = 1_000_000

FOLDS = 5
UNKNOWN = "und"
EPOCHS = 30
COST = 20.0

# Language families by ISO 639-1 code.
FAMILIES = {
    "romance": "fr es it pt ro ca gl oc",
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy br gd",
    "turkic": "tr az kk uz tk ky",
    "indic": "hi ur bn mr ne pa gu",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "malay": "id ms jv su tl",
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"only {lang}")


def letter_codes(text: str) -> tuple[np.ndarray, int]:
    """Lower-cased code points, everything in ASCII that is no letter as one space; and the number of letters."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    plain = codes < 128
    letters = (codes >= 97) & (codes <= 122)
    count = int(letters.sum())
    if not plain.all():
        count += sum(map(str.isalpha, "".join(map(chr, codes[~plain]))))
    return np.where(plain & ~letters, 32, codes), count


def grams(text: str | None) -> np.ndarray | None:
    """Root of the hashed n-gram shares of the whole text, of length 1; None without any letter."""
    if not text:
        return None
    total, letters, tail = np.zeros(BINS), 0, np.zeros(0, np.int64)
    for at in range(0, len(text), PIECE):
        codes, count = letter_codes(text[at : at + PIECE])
        letters += count
        old = len(tail)
        codes = np.concatenate([tail, [32] if at == 0 else [], codes, [32] if at + PIECE >= len(text) else []]).astype(np.int64)
        tail = codes[-2:]
        one = codes[old:]
        from_two = codes[max(0, old - 1) :]
        two = from_two[:-1] * 1_000_003 + from_two[1:]
        three = (codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]
        for h in (one * 7919 + 1, two * 31 + 2, three * 17 + 3):
            total += np.bincount((((h * -7046029254386353131) >> 40) & (BINS - 1)), minlength=BINS)
    if not letters:
        return None
    root = np.sqrt(total)
    return root / np.linalg.norm(root)


def fit_pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine for labels -1 and 1: weights and bias, by dual coordinate descent on the squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    norm = (x**2).sum(1) + 0.5 / COST
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / COST
            new = max(0.0, alpha[i] - slope / norm[i])
            step = new - alpha[i]
            if step:
                w += step * y[i] * x[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w[:-1], float(w[-1])


class Voter:
    """One-versus-one machines over a set of classes; the class with most won duels leads, margins break ties."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        at = np.array([self.classes.index(v) for v in labels])
        self.pairs = list(combinations(range(len(self.classes)), 2))
        fits = [fit_pair(x[(at == i) | (at == j)], np.where(at[(at == i) | (at == j)] == i, 1.0, -1.0)) for i, j in self.pairs]
        self.weights = np.array([w for w, _ in fits]).reshape(len(self.pairs), x.shape[1])
        self.bias = np.array([b for _, b in fits])

    def vote(self, x: np.ndarray) -> tuple[str, float]:
        """The class, and the least certain of its duels (0 to 1)."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights @ x + self.bias
        sure = 1 / (1 + np.exp(-np.clip(4 * margins, -40, 40)))
        won, held = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        least = np.ones(len(self.classes))
        for (i, j), p in zip(self.pairs, sure, strict=True):
            won[i if p >= 0.5 else j] += 1
            held[i] += p
            held[j] += 1 - p
            least[i], least[j] = min(least[i], p), min(least[j], 1 - p)
        best = max(range(len(self.classes)), key=lambda k: (won[k], held[k], -k))
        return self.classes[best], float(least[best])


class Hierarchy:
    """Families first, then the languages of the family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.top = Voter(x, [family(v) for v in langs]) if langs else None
        by: dict[str, list[int]] = defaultdict(list)
        for i, v in enumerate(langs):
            by[family(v)].append(i)
        self.within = {f: Voter(x[rows], [langs[i] for i in rows]) for f, rows in by.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        x = grams(text)
        if x is None or self.top is None:
            return UNKNOWN, 0.0
        name, sure = self.top.vote(x)
        lang, own = self.within[name].vote(x)
        return lang, sure * own


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """Fits on at most about TRAIN_DOCS documents outside the held-out fold, as many of each language as of any other where there are enough.

    A document is in the sample if its hash is below a threshold that makes
    TRAIN_DOCS the expected number at any size; of rows that share an id one counts.
    Languages with less than LANG_SHARE of the labelled rows are not learnt.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("id"), FOLDS) != 0))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    whole = counts.agg(F.sum("n")).first()[0] or 0
    large = {r["lang"]: r["n"] for r in counts.where(F.col("n") >= LANG_SHARE * whole).collect()}
    discard(counts)
    below = F.lit(0).cast("long")
    for lang, n in sorted(large.items()):
        below = F.when(F.col("lang") == lang, F.lit(hash_mark(TRAIN_DOCS / len(large) / n))).otherwise(below)
    chosen = rows.where(hash63("id") < below).select("id", "lang", "text")
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[str, bytes]] = {}
        for batch in batches:
            for at, lang, text in zip(*(texts(batch.column(i)) for i in range(3)), strict=True):
                x = grams(text)
                if x is not None:
                    found = (lang, x.astype(">f4").tobytes())
                    own[at] = min(found, own.get(at, found))
        columns = [pa.array(own, pa.int64()), *(pa.array([v[i] for v in own.values()], schema.field(i + 1).type) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sample = chosen.mapInArrow(run, "id long, lang string, x binary").groupBy("id").agg(F.min(F.struct("lang", "x")).alias("own"))
    got = sorted((r["lang"], bytes(r["x"])) for r in sample.select("own.lang", "own.x").collect())
    x = np.array([np.frombuffer(v, ">f4") for _, v in got], np.float64).reshape(-1, BINS)
    return Hierarchy(x, [lang for lang, _ in got])


def predict(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, held_out, lang_pred, score)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in texts(batch.column(2))]
            columns = [batch.column(0), batch.column(1), pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (crc_fold(F.col(id_col), FOLDS) == 0).alias("held_out"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
