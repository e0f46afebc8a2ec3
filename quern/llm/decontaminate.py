"""Benchmark decontamination by BM25 with block-max WAND, then a check that tolerates edits.

The test items are the index: each item is cut into units of at most UNIT words,
and a unit's postings hold its BM25 impacts divided by the unit's own best
score, so every unit has the same threshold: the share of its score that a
passage must reach. Postings are kept in blocks with their largest impact.

Every training passage is a query (windows of WINDOW words, half overlapping, so
that each stretch of UNIT words lies whole in some window). Block-max WAND adds
up the largest impacts that a passage's words have in a block of units, skips the
blocks whose sum cannot reach the threshold, and scores the others in full: all
units above the threshold are retrieved, none is lost. It is run for many passages
at a time, from large blocks of blocks to small ones: of the blocks that pass, the
cursors of the passage's words are set forward to their parts by binary search, so
the postings in between are never read. Of an item whose
units are retrieved, the words around the passage are then checked. Where the
table tells question and answer apart, an item leaks if both parts occur there
to OVERLAP or more: by their five-word shingles, or, from five words on, by the
fewest words inserted, deleted or replaced that turn the part into a stretch of
the passage. Where the table has one text, the whole item is held against the
passage too, and leaks if COVER of its words or more need no edit, wherever in
the item the edits are; its last quarter may be missing.

The index is broadcast in parts of about BLOCK_ITEMS items and BLOCK_BYTES bytes at
most: a larger benchmark is run part by part against all documents. Word weights
and lengths are counted once over all items, so the scores are the same in any
number of parts.

Results for odd input: a null or empty text leaks nothing; items without words
are never matched; items shorter than five words are one shingle; equal item rows
count once; repeated documents give repeated matches; very long texts are cut into
windows to their end, and searched some windows at a time; an empty table on either side gives an empty table; further columns
are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sized, text_test, texts, written

K1, B = 1.2, 0.75

#: Words in an indexed unit; a passage has twice as many and moves by as many, so it holds any unit whole.
UNIT = 64
WINDOW = 2 * UNIT

#: Share of a unit's own score that a passage must reach.
THRESHOLD = 0.5

#: Share of the question and of the answer that must occur.
SHINGLE = 5
OVERLAP = 0.75

#: Share of an item's words that need no edit where the table has one text: a 15-word item may lose its last five words.
COVER = 0.65

#: Share of an item's words that is its answer where the table does not tell them apart.
ANSWER_SHARE = 0.25

#: Parts of a block (units in the smallest ones), and most blocks that are tested without a larger one above them.
BLOCK = 8
TOP_BLOCKS = 64

#: Items and bytes in a broadcast index.
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 8 << 20

#: Postings that a step of the search holds at a time.
STEP = 1 << 20

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item whose table has one text: the last quarter of the words, and five at least, is the answer."""
    cut = max(0, len(words) - max(SHINGLE, round(ANSWER_SHARE * len(words))))
    return words[:cut], words[cut:]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return set(zip(*[words[k:] for k in range(size)], strict=False))


def unedited(part: list[str], text: list[str]) -> float:
    """1 - edits / words, with the fewest edits by which ``part`` becomes a stretch of ``text`` (bit-parallel, a step a word of ``text``)."""
    full, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
    places: dict[str, int] = {}
    for i, w in enumerate(part):
        places[w] = places.get(w, 0) | 1 << i
    more, less = full, 0
    edits = fewest = len(part)
    for w in text:
        same = places.get(w, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up_across = (less | ~(across | more)) & full
        down_across = more & across
        edits += bool(up_across & last) - bool(down_across & last)
        fewest = min(fewest, edits)
        up_across, down_across = (up_across << 1) & full, (down_across << 1) & full
        more, less = (down_across | ~(down | up_across)) & full, up_across & down
    return 1 - fewest / len(part)


def _expand(begins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For list rows of a flat table: which of ``rows`` each entry belongs to, and the entry's place."""
    size = begins[rows + 1] - begins[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[rows], size)


def units_of(words: list[str]) -> list[Counter]:
    """The bags of words of an item's units."""
    return [Counter(words[begin : begin + UNIT]) for begin in range(0, len(words), UNIT)]


class Statistics:
    """What BM25 weights depend on, over all items: the number of units, their mean length and each word's units."""

    def __init__(self, units: int, words: int, df: dict[str, int]):
        self.units, self.mean, self.df = units, words / max(1, units), df

    @classmethod
    def of(cls, items: list[tuple[int, list[str], list[str]]]) -> Statistics:
        bags = [bag for _, q, a in items for bag in units_of(q + a)]
        return cls(len(bags), sum(sum(b.values()) for b in bags), Counter(w for b in bags for w in b))

    def impacts(self, bag: Counter) -> dict[str, float]:
        """The BM25 impact of each word of a unit."""
        size, n, df = sum(bag.values()), self.units, self.df
        return {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / self.mean)) for w, c in bag.items()}


class Level:
    """The largest impacts of each term in blocks of ``size`` units, sorted by term and block; ``size`` 1 has the postings themselves."""

    def __init__(self, size: int, blocks: int, term: np.ndarray, block: np.ndarray, top: np.ndarray, terms: int):
        self.size, self.blocks, self.block, self.top = size, blocks, block, top
        self.key = term * blocks + block
        self.begins = np.searchsorted(term, np.arange(terms + 1))

    def above(self, term: np.ndarray, terms: int) -> Level:
        """The level of blocks of BLOCK blocks."""
        blocks = -(-self.blocks // BLOCK)
        key, place = np.unique(term * blocks + self.block // BLOCK, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, place, self.top)
        return Level(self.size * BLOCK, blocks, key // blocks, key % blocks, top, terms)


class Index:
    """The inverted index of the items' units, with block maxima. ``whole``: the items are one text each, whose split is a guess."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], whole: bool = False, statistics: Statistics | None = None):
        self.items, self.whole = items, whole
        statistics = statistics or Statistics.of(items)
        self.units: list[tuple[int, int]] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, question, answer) in enumerate(items):
            for k, bag in enumerate(units_of(question + answer)):
                impact = statistics.impacts(bag)
                own = sum(impact.values())
                for w, x in impact.items():
                    postings[w].append((len(self.units), x / own))
                self.units.append((at, k * UNIT))
        names = sorted(postings)
        self.terms = {w: i for i, w in enumerate(names)}
        lists = [postings[w] for w in names]
        self.unit_from = np.cumsum([0, *map(len, lists)])
        self.unit_of = np.array([u for p in lists for u, _ in p], np.int64)
        self.unit_impact = np.array([x for p in lists for _, x in p], float)
        term = np.repeat(np.arange(len(lists)), np.diff(self.unit_from))
        self.levels = [Level(1, len(self.units), term, self.unit_of, self.unit_impact, len(lists))]
        while len(self.levels) < 2 or self.levels[-1].blocks > TOP_BLOCKS:
            last = self.levels[-1]
            self.levels.append(last.above(last.key // max(1, last.blocks), len(lists)))
        #: Shingle size and shingles of each part; a part of fewer than five words is one shingle.
        self.parts = [[(size := min(SHINGLE, len(x)), shingles(x, size)) for x in (q, a) if x] for _, q, a in items]

    def search(self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(passage, unit, score) of all units that reach the threshold; ``passage`` and ``term`` are distinct pairs, sorted by passage."""
        begins = np.searchsorted(passage, np.arange(passages + 1))
        top = self.levels[-1]
        cost = np.maximum(np.bincount(passage, weights=np.diff(top.begins)[term], minlength=passages), top.blocks)
        part = (np.cumsum(cost) // STEP).astype(np.int64)
        out = []
        for first, last in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
            own = slice(begins[first], begins[last])
            owner, at = _expand(top.begins, term[own])
            bound = np.bincount((passage[own][owner] - first) * top.blocks + top.block[at], weights=top.top[at], minlength=(last - first) * top.blocks)
            opened = np.flatnonzero(bound >= threshold - 1e-9)
            of, block, score = opened // top.blocks + first, opened % top.blocks, bound[opened]
            for level in self.levels[-2::-1]:
                of, block, score = self._descend(level, begins, term, of, block, threshold)
            out += zip(of.tolist(), block.tolist(), score.tolist(), strict=True)
        return out

    def _descend(self, level: Level, begins: np.ndarray, term: np.ndarray, of: np.ndarray, parent: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        """The parts on ``level`` of the opened (passage, block) pairs whose sum reaches the threshold."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        part = np.cumsum((begins[of + 1] - begins[of]) * BLOCK) // STEP
        for chunk in np.split(np.arange(len(of)), np.flatnonzero(np.diff(part)) + 1):
            if not len(chunk):
                continue
            pair, at = _expand(begins, of[chunk])
            base, inside = term[at] * level.blocks, parent[chunk][pair] * BLOCK
            low = np.searchsorted(level.key, base + inside)
            size = np.searchsorted(level.key, base + np.minimum(inside + BLOCK, level.blocks)) - low
            pair, at = np.repeat(pair, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            key, place = np.unique(of[chunk][pair] * level.blocks + level.block[at], return_inverse=True)
            score = np.bincount(place, weights=level.top[at], minlength=len(key))
            good = score >= threshold - 1e-9
            found.append((key[good] // level.blocks, key[good] % level.blocks, score[good]))
        return tuple(np.concatenate([x[i] for x in found]) for i in range(3))

    def passages(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct (passage, term) pairs of a text's windows, and the number of windows: window k has the UNIT-word steps k and k + 1."""
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        count = max(1, -(-(len(words) - UNIT) // UNIT))
        known = np.flatnonzero(ids >= 0)
        step, term = known // UNIT, ids[known]
        window = np.concatenate([step, step - 1])
        term = np.concatenate([term, term])
        inside = (window >= 0) & (window < count)
        keys = np.unique(window[inside] * len(self.terms) + term[inside])
        return keys // len(self.terms), keys % len(self.terms), count

    def matches(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item's place, best score, question overlap, answer overlap) of the items that leak into a text.

        Both overlaps are the share of the whole item's words where that is what decides.
        """
        words = words_of(text)
        if not words or not self.terms:
            return []
        hits: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for window, unit, score in self.search(*self.passages(words)):
            hits[self.units[unit][0]].append((window * UNIT - self.units[unit][1], score))
        out = []
        for at, places in hits.items():
            _, question, answer = self.items[at]
            size = len(question) + len(answer)
            parts = [x for x in (question, answer) if x]
            best, cover = (-1.0, 0.0, 0.0), 0.0
            for begin in {b for b, _ in places}:
                near = words[max(0, begin - size) : begin + WINDOW + 2 * size]
                share = [len(own & shingles(near, k)) / len(own) for k, own in self.parts[at]]
                if min(share) < OVERLAP:
                    share = [max(x, unedited(own, near)) if len(own) >= SHINGLE else x for x, own in zip(share, parts, strict=True)]
                best = max(best, (min(share), share[0], share[-1]))
                if self.whole and best[0] < OVERLAP:
                    cover = max(cover, unedited(question + answer, near))
            top = max(s for _, s in places)
            if best[0] >= OVERLAP:
                out.append((at, top, best[1], best[2]))
            elif cover >= COVER:
                out.append((at, top, cover, cover))
        return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, q, a): the distinct items; without question and answer columns ``q`` is the whole text."""
    if {"question", "answer"} <= set(benchmark.columns):
        return benchmark.select(F.col(id_col).alias("i"), F.col("question").alias("q"), F.col("answer").alias("a")).distinct()
    return benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("q"), F.lit(None).cast("string").alias("a")).distinct()


def _loaded(items: DataFrame, whole: bool) -> list[tuple[int, list[str], list[str]]]:
    found = [(r["i"], *(split_item(words_of(r["q"])) if whole else (words_of(r["q"]), words_of(r["a"])))) for r in items.collect()]
    return sorted((x for x in found if x[1] or x[2]), key=lambda x: (x[0] is None, x[0] or 0, x[1:]))


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[tuple[int, list[str], list[str]]]:
    """The distinct items of a bounded table, with their question and answer words (columns ``question`` and ``answer`` where there are both)."""
    return _loaded(_items(benchmark, id_col, text_col), not {"question", "answer"} <= set(benchmark.columns))


def word_units(items: DataFrame) -> DataFrame:
    """(word, units, words): the units of all items that hold a word; the row of the null word has all units and their words."""
    schema = pa.schema([("word", pa.string()), ("units", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df: Counter = Counter()
            units = words = 0
            for q, a in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                for bag in units_of(words_of(q) + words_of(a)):
                    df.update(bag.keys())
                    units, words = units + 1, words + sum(bag.values())
            rows = [(None, units, words), *((w, n, 0) for w, n in df.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    counts = items.select("q", "a").mapInArrow(run, "word string, units long, words long")
    return counts.groupBy("word").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index in parts of about BLOCK_ITEMS items and BLOCK_BYTES bytes, each with the word weights of the whole."""
    whole = not {"question", "answer"} <= set(benchmark.columns)
    items = written(_items(benchmark, id_col, text_col), "items", benchmark.count())
    size = F.octet_length(F.concat_ws(" ", "q", "a"))
    count, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, math.ceil(count / BLOCK_ITEMS), math.ceil(total / BLOCK_BYTES))
    if parts == 1:
        yield Index(_loaded(items, whole), whole)
        return
    words = written(word_units(items), "words", total // SHINGLE)
    units, length = words.where("word is null").select("units", "words").first()
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("i", "q", "a"), F.lit(parts)) == part)
        known = word_units(own).where("word is not null").select("word").join(words, "word")
        df = {r["word"]: r["units"] for r in known.select("word", "units").collect()}
        yield Index(_loaded(own, whole), whole, Statistics(units, length, df))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row a document and item that leaks into it: (doc_id, item_id, score, question_overlap, answer_overlap). Clean documents give none."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def against(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                found = [
                    (doc_id, own.items[m[0]][0], *m[1:])
                    for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)
                    for m in own.matches(text)
                ]
                columns = [pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    context = docs.sparkSession.sparkContext
    out = before = None
    for index in indexes(benchmark, item_col):
        if before is not None:
            # a part's rows are written before the next part is broadcast, so one part is held at a time
            done = written(against(before), "leaks")
            out = done if out is None else out.unionByName(done)
            before.unpersist()
        before = context.broadcast(index)
    last = against(before)
    return last if out is None else out.unionByName(last)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows into whose text no item leaks, with all their columns, whatever their ids. Nothing is shuffled or joined."""
    context = docs.sparkSession.sparkContext
    before = None
    for index in indexes(benchmark, item_col):
        if before is not None:
            docs = written(docs, "clean")
            before.unpersist()
        before = context.broadcast(index)
        docs = docs.where(text_test(lambda text, held=before: not held.value.matches(text))(F.col(text_col)))
    return docs


def drop_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents into which nothing leaks, with all their columns. Null ids stay."""
    ids = found.select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(sized(ids), docs[id_col] == ids["__leaked"], "left_anti")
