"""Quality rules by distribution divergence.

Two histograms of a document are compared with references by Jensen-Shannon
distance (the root of the divergence in bits, 0 to 1): its characters by class,
and its words over the common words of a language (words with at least
``COMMON_SHARE`` of the language's tokens, at most 1 / COMMON_SHARE of them by
definition) with one bin for all others. The references are the histograms of
all documents of a language that pass the base rules and have few symbols and
no repeated line (``is_reference``), none of them sampled. A document is judged
by the reference whose words it is closest to, so a wrong or missing language
label does no harm. Characters come in words, so a few long tokens with digits
(keys, numbers, addresses) shift a short text's histogram more than chance does:
they are set aside while they are ``TOKEN_SHARE`` of it or less. Guards: the
class distance is judged from ``LEAST_CHARS`` characters on, by a bound that
narrows with the root of the length as the sampling spread does; the word
distance is judged wherever the base rule has words enough.

Results for odd input: a null text counts as empty and fails the base rule; a
null language is a language of its own when references are learnt; without any
reference document there is no reference and the base rule alone decides;
very long texts are counted whole; repeated rows give repeated results; an empty
table gives an empty table; further columns are kept by ``keep_good`` and not
read, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, plan_bytes, text_test, texts, written
from quern.llm.textstats import CLASSES, base_counts, byte_counts, class_counts, code_points

#: Least share of a language's tokens for a common word.
COMMON_SHARE = 0.004

#: Least share of the reference words for a language of its own; rarer ones are pooled under this name.
LANG_SHARE = 0.002
POOLED = "(pooled)"

#: Guard: below this length the class distance is not judged.
LEAST_CHARS = 200

#: Bytes from which on a token with a digit is set aside, and the largest share of a text's characters that such tokens may be.
LONG_TOKEN = 16
TOKEN_SHARE = 0.25

#: Largest distances that a kept document has. The class bound is MOST_CLASS + CLASS_SPREAD / root of the characters: the
#: constant is for texts that mix languages, at any length, and the rest for chance. Chosen of 48 pairs on sf0.1 and check_s
#: as the one that rejects no good document and keeps the least junk.
MOST_CLASS = 0.14
CLASS_SPREAD = 1.5
MOST_WORD = 0.40

#: Words that a task counts before it hands its partial counts on.
FLUSH = 100_000

#: Bytes of the documents for each row of counts, about.
KEY_BYTES = 20

#: Base rules: fewest words, and the largest share of words in repeated windows in percent.
BASE_WORDS = 50
BASE_REPEATED = 50

#: Reference documents have at most one symbol in so many words, and no repeated line.
REFERENCE_SYMBOLS = 20

_DIGIT = re.compile(rb"[0-9]")
_STRIP = b".,;:!?'\"()-#*$%&|<>"


def base_failed(counts: dict[str, int]) -> bool:
    return counts["n_words"] < BASE_WORDS or 100 * counts["n_repeat_words"] > BASE_REPEATED * counts["n_words"]


def is_reference(counts: dict[str, int]) -> bool:
    """Whether a document counts for the references: base rules passed, few symbols, no repeated line."""
    return not base_failed(counts) and REFERENCE_SYMBOLS * counts["n_symbols"] <= counts["n_words"] and not counts["n_dup_lines"]


def plain(words: list[bytes]) -> list[bytes]:
    """Lower-cased (ASCII) words without punctuation at the ends."""
    return [w.strip(_STRIP).lower() for w in words]


def style_counts(words: list[bytes], byte_n: np.ndarray) -> np.ndarray:
    """Code points by class, without the long tokens with digits where they are few."""
    classes = class_counts(byte_n)
    tokens = [w for w in words if len(w) >= LONG_TOKEN and _DIGIT.search(w)]
    if tokens:
        aside = class_counts(byte_counts(b"".join(tokens)))
        if aside.sum() <= TOKEN_SHARE * classes.sum():
            return classes - aside
    return classes


def corpus_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, kind, key, n) over all reference documents: kind ``word``, ``class`` or ``total``.

    Each task adds up before anything is shuffled, and hands on partial counts
    when it holds ``FLUSH`` words, so its memory does not grow with the input.
    """
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}
        totals: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, "class", CLASSES[i].encode(), int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
            rows += [(lang, "total", b"", n) for lang, n in totals.items()]
            for held in (words, classes, totals):
                held.clear()
            lang, kind, key, n = zip(*rows, strict=True) if rows else ([], [], [], [])
            columns = [pa.array(x, f.type) for x, f in zip((lang, kind, key, n), schema, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                found, byte_n, counts = base_counts((text or "").encode("utf-8", "replace"))
                if not is_reference(counts):
                    continue
                words.setdefault(lang, Counter()).update(plain(found))
                classes[lang] = classes.get(lang, 0) + style_counts(found, byte_n)
                totals[lang] += len(found)
                if sum(map(len, words.values())) > FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    partial = rows.mapInArrow(run, "lang string, kind string, key binary, n long")
    return partial.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


class References:
    """Common words, their shares and the class shares, by language. At most 1 / COMMON_SHARE words a language."""

    def __init__(self, rows: list[tuple[str | None, str, bytes, int]]):
        totals = {lang: n for lang, kind, _, n in rows if kind == "total"}
        self.langs = sorted((x for x in totals if totals[x]), key=lambda x: (x is None, x or ""))
        self.words = [
            sorted((key, n) for lang, kind, key, n in rows if lang == at and kind == "word" and key) for at in self.langs
        ]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for own in self.words for w, _ in own}))}
        self.places = [np.array([self.vocabulary[w] for w, _ in own], np.int64) for own in self.words]
        self.word_shares = []
        for at, own in zip(self.langs, self.words, strict=True):
            share = np.array([n for _, n in own], float) / totals[at]
            self.word_shares.append(np.append(share, max(0.0, 1 - share.sum())))
        self.class_shares = []
        for at in self.langs:
            own = {key: n for lang, kind, key, n in rows if lang == at and kind == "class"}
            share = np.array([own.get(c.encode(), 0) for c in CLASSES], float)
            self.class_shares.append(share / max(1.0, share.sum()))

    def distances(self, words: list[bytes], classes: np.ndarray) -> tuple[float, float]:
        """Class and word distance to the reference whose word distance is least."""
        get = self.vocabulary.get
        ids = [i for i in map(get, plain(words)) if i is not None]
        counts = np.bincount(ids, minlength=len(self.vocabulary)) if ids else np.zeros(len(self.vocabulary))
        best = None
        share = classes / max(1.0, classes.sum())
        for places, by_word, by_class in zip(self.places, self.word_shares, self.class_shares, strict=True):
            own = counts[places]
            own = np.append(own, len(words) - own.sum()) / max(1, len(words))
            pair = (jensen_shannon(own, by_word), jensen_shannon(share, by_class))
            best = pair if best is None or pair < best else best
        return (0.0, 0.0) if best is None else (best[1], best[0])


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance in bits, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(min(1.0, max(0.0, (left + right) / 2))))


def learn_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """References from all documents.

    Languages with less than LANG_SHARE of all reference words are counted as one,
    so a dirty language column gives 1 / LANG_SHARE references at most; of each only
    the common words come to the driver, at most 1 / COMMON_SHARE.
    """
    counts = written(corpus_counts(docs, text_col, lang_col), "counts", plan_bytes(docs) // KEY_BYTES)
    totals = counts.where("kind = 'total'")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    large = [(r["lang"], r["n"], True) for r in totals.where(F.col("n") >= LANG_SHARE * whole).collect()]
    rest = whole - sum(n for _, n, _ in large)
    own = docs.sparkSession.createDataFrame(large, "own string, total long, large boolean")
    found = counts.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("own")), "left")
    lang = F.when(F.col("large"), F.col("lang")).otherwise(F.lit(POOLED))
    total = F.coalesce("total", F.lit(rest))
    summed = found.groupBy(lang.alias("lang"), total.alias("total"), "kind", "key").agg(F.sum("n").alias("n"))
    chosen = summed.where((F.col("kind") != "word") | (F.col("n") >= F.greatest(F.lit(2), F.ceil(COMMON_SHARE * F.col("total")))))
    rows = [(r["lang"], r["kind"], bytes(r["key"]), r["n"]) for r in chosen.select("lang", "kind", "key", "n").collect()]
    discard(counts)
    return References(rows)


def verdict(text: str | None, references: References) -> dict:
    """The counts, distances and verdict of one text."""
    words, byte_n, out = base_counts((text or "").encode("utf-8", "replace"))
    by_class, by_word = references.distances(words, style_counts(words, byte_n))
    out["base_failed"] = base_failed(out)
    chars = code_points(byte_n)
    bad_class = chars >= LEAST_CHARS and by_class > MOST_CLASS + CLASS_SPREAD / np.sqrt(chars)
    out["kept"] = not (out["base_failed"] or bad_class or by_word > MOST_WORD)
    return out | {"class_distance": by_class, "word_distance": by_word}


def judge(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the base counts, ``base_failed``, ``kept`` and the two distances."""
    fields = [("doc_id", pa.int64())]
    fields += [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(text, references) for text in texts(batch.column(1))]
            columns = [batch.column(0)] + [pa.array([x[f.name] for x in found], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double",
    )


def keep_good(docs: DataFrame, references: References, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns. Only the text goes to Python and only the verdict comes back."""

    return docs.where(text_test(lambda text: verdict(text, references)["kept"])(F.col(text_col)))


def assess(docs: DataFrame) -> DataFrame:
    """References from the documents, then the verdict of each."""
    return judge(docs, learn_references(docs))
