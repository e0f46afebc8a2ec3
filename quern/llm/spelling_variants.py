"""Spelling variant grouping: full neighbourhoods, joined to the vocabulary by hash.

1. Words are maximal runs of letters, lower-cased in ASCII; a run whose checksum with
   its document's id is a multiple of NOISE loses one code point. Each task counts the
   words of many documents before anything is shuffled.
2. The vocabulary are the words of LEAST_LENGTH code points and LEAST_COUNT occurrences
   or more, its alphabet the code points that occur in it (fewer than 100: the pattern
   admits no more).
3. Of each word all distinct deletions, replacements and insertions over the alphabet
   are made, as 64-bit hashes that follow from the word's own by one addition. A Bloom
   filter of the vocabulary (bits for its size, FILTER_BITS at most) drops nearly all
   that are no words; the rest become strings and are joined to the vocabulary by
   equality. Such a candidate is one edit away by its making: no distance is computed.
4. The form of a word is its near word of largest count, if that is twice its own.
   Forms are followed to the last by pointer doubling; counts double with each step, so
   chains are short.

Results for odd input: a null or empty text has no words; a null id counts as empty in
the checksum; repeated rows count as often as they occur; words of any length are
handled in blocks of candidates; ties of counts go to the smallest word in code-point
order; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, joined, ship, texts, written

#: A run whose checksum this divides loses a code point.
NOISE = 97

LEAST_LENGTH = 5
LEAST_COUNT = 3

#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000

#: Candidates that are made at a time.
BLOCK = 1 << 20

#: Bits of the filter for a word of the vocabulary, the bits it has at most (64 MB), those of a segment, and its hashes.
WORD_BITS, FILTER_BITS, SEGMENT_BITS, FILTER_HASHES = 32, 1 << 29, 1 << 16, 3

#: Words that a batch of the vocabulary holds while their neighbours are made.
BATCH_WORDS = 2_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of one text with their counts, after the loss of code points."""
    out: Counter = Counter()
    start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    start = zlib.crc32(b":", start)
    for word, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
        h = zlib.crc32(word.encode(), start)
        if h % NOISE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the vocabulary."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def given(held: Counter) -> Iterator[pa.RecordBatch]:
        rows = list(held.items())
        for k in range(0, len(rows), 50_000):
            part = rows[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for word, n in words_of(at, text).items():
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from given(held)
                    held = Counter()
        yield from given(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Neighbours:
    """Hashes of words and of all that is one edit away from them, over an alphabet."""

    def __init__(self, alphabet: list[int]):
        self.codes = np.array(sorted(alphabet), np.int64)
        rng = np.random.default_rng(17)
        self.value = rng.integers(1, 2**63, len(self.codes) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, words: list[str]) -> np.ndarray:
        """The words, all of one length, as rows of places in the alphabet."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        return np.searchsorted(self.codes, codes)

    def heads(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(powers, hashes of all beginnings): a word's hash is the last of its beginnings."""
        powers = np.ones(at.shape[1] + 1, np.uint64)
        np.multiply.accumulate(np.full(at.shape[1], _STEP), out=powers[1:])
        heads = np.zeros((at.shape[0], at.shape[1] + 1), np.uint64)
        np.cumsum(self.value[at] * powers[:-1], axis=1, out=heads[:, 1:])
        return powers, heads

    def edits(self, at: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """Blocks (kind, first place, hashes, whether distinct) over [word, place] or [word, place, letter]."""
        n, size = at.shape
        powers, heads = self.heads(at)
        whole = heads[:, -1:]
        letters = np.arange(len(self.codes))
        step = max(1, BLOCK // max(1, n * len(letters)))
        for lo in range(0, size, step):
            hi = min(size, lo + step)
            gone = heads[:, lo:hi] + (whole - heads[:, lo + 1 : hi + 1]) * _BACK
            first = np.ones((n, hi - lo), bool)
            first[:, int(lo == 0) :] = at[:, max(lo, 1) : hi] != at[:, max(lo, 1) - 1 : hi - 1]
            yield "delete", lo, gone, first
            other = whole[:, :, None] + (self.value[letters] - self.value[at[:, lo:hi]][:, :, None]) * powers[lo:hi][:, None]
            yield "replace", lo, other, at[:, lo:hi][:, :, None] != letters
        for lo in range(0, size + 1, step):
            hi = min(size + 1, lo + step)
            more = (heads[:, lo:hi] + (whole - heads[:, lo:hi]) * _STEP)[:, :, None] + self.value[letters] * powers[lo:hi][:, None]
            first = np.ones((n, hi - lo, len(letters)), bool)
            # the same letter behind an equal one gives what it gives ahead of it
            first[:, int(lo == 0) :] = at[:, max(lo, 1) - 1 : hi - 1][:, :, None] != letters
            yield "insert", lo, more, first

    def edited(self, word: str, kind: str, place: int, letter: int) -> str:
        new = "" if kind == "delete" else chr(self.codes[letter])
        return word[:place] + new + word[place + (kind != "insert") :]


def slots(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The places of hashes in the filter, by its k-th hash function."""
    h = (hashes ^ (hashes >> np.uint64(31 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(7)) & np.uint64(bits - 1)


def passing(hashes: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    """The places in ``hashes`` that the filter admits."""
    at = np.arange(len(hashes))
    for k in range(FILTER_HASHES):
        s = slots(hashes[at], bits, k)
        at = at[(packed[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _by_length(words: list[str]) -> Iterator[list[str]]:
    lengths: dict[int, list[str]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    yield from lengths.values()


def _filter(vocabulary: DataFrame, alphabet: list[int], bits: int) -> bytes:
    """The Bloom filter, packed; made in segments by tasks, at most FILTER_BITS in all."""
    segment = min(bits, SEGMENT_BITS)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Neighbours(alphabet)
        for batch in batches:
            for words in _by_length(batch.column(0).to_pylist()):
                _, heads = made.heads(made.places(words))
                s = np.concatenate([slots(heads[:, -1], bits, k) for k in range(FILTER_HASHES)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s // segment), pa.array(s % segment)], names=["segment", "bit"])

    def packed(group: pa.Table) -> pa.Table:
        on = np.zeros(segment, np.uint8)
        on[group.column("bit").to_numpy()] = 1
        return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    rows = vocabulary.select("word").mapInArrow(marks, "segment long, bit long").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("segment").applyInArrow(packed, "segment long, bits binary").toLocalIterator():
        out[r["segment"] * segment // 8 : (r["segment"] + 1) * segment // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def neighbourhoods(vocabulary: DataFrame, size: int) -> DataFrame:
    """(word, near, n_near_word): all pairs of words of the vocabulary that are one edit apart, both ways round, with the second's count."""
    spark = vocabulary.sparkSession
    # the pattern of runs bounds the letters that there can be
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().select(F.ascii("c").alias("code")).where("code > 0")
    alphabet = sorted(r["code"] for r in letters.collect())
    bits = min(FILTER_BITS, max(1 << 10, 1 << (WORD_BITS * size - 1).bit_length()))
    sent = spark.sparkContext.broadcast(_filter(vocabulary, alphabet, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, packed = Neighbours(alphabet), np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_WORDS):
                for words in _by_length(batch.column(0).slice(k, BATCH_WORDS).to_pylist()):
                    for kind, lo, hashes, first in made.edits(made.places(words)):
                        at = np.flatnonzero(first)
                        at = at[passing(hashes.reshape(-1)[at], packed, bits)]
                        w, p, *c = np.unravel_index(at, hashes.shape)
                        c = c[0] if c else np.zeros(len(w), np.int64)
                        source = [words[i] for i in w]
                        found = [made.edited(x, kind, lo + int(i), int(j)) for x, i, j in zip(source, p, c, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(found, pa.string())], names=["word", "near"])

    candidates = vocabulary.select("word").repartition(max(spark.sparkContext.defaultParallelism, size // 20_000)).mapInArrow(run, "word string, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("n_near_word")), "near").select("word", "near", "n_near_word")


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of its chain of forms. Pointers double until none moves."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.hash("word").alias("k"), F.col("word").alias("of"), F.col("root").alias("next"))
        # many words may have one root: both sides are dealt by its hash
        rows = joined(at.withColumn("k", F.hash("root")), further, "k", "left").where("of is null or of = root")
        rows = at.join(rows.where("of is not null").select("word", "next"), "word", "left")
        after = written(rows.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = after
        if not at.where("moved").limit(1).count():
            return at
        at = at.drop("moved")
        at.scratch_path = after.scratch_path


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: (word, n, n_near, form, form_n, root). The result is written; the tables that led to it are removed."""
    ship(docs.sparkSession)
    vocabulary = written(counted(docs, id_col, text_col), "vocabulary")
    size = vocabulary.count()
    near = neighbourhoods(vocabulary, size)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near_word")).alias("rank"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"))
    twice = F.col("near_n") >= 2 * F.col("n")
    rows = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(twice, F.col("near")).alias("form"), F.when(twice, F.col("near_n")).alias("form_n")
    )
    rows = written(rows, "forms")
    roots = _followed(rows.where("form is not null"))
    out = written(rows.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
    discard(vocabulary, rows, roots)
    return out
