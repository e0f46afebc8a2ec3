"""Scalar functions: quantisation, tokens, sentences, addresses, numbers with units, closed forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Text fields that selective quantisation leaves alone are not numbers; these are the fields that it packs.
QUANTISED_FIELDS = ("confidence", "importance", "relevance", "score", "weight", "valence", "arousal", "dominance", "load", "quality", "novelty", "utility", "strength", "uncertainty", "salience")


def quantize4(values: Column) -> Column:
    """Numbers in 0 to 1 as codes 0 to 15."""
    return F.transform(values, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 15 + 0.5))


def dequantize4(codes: Column) -> Column:
    return F.transform(codes, lambda x: x / 15)


def quantize_fields(columns: dict[str, Column]) -> dict[str, Column]:
    """The known fields as codes, the others as they are."""
    one = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 15 + 0.5).cast("tinyint")
    return {name: one(c) if name in QUANTISED_FIELDS else c for name, c in columns.items()}


def compression_ratio(columns: list[str]) -> float:
    """Bytes after packing over bytes before, with eight for a number and half a byte for a code."""
    packed = sum(c in QUANTISED_FIELDS for c in columns)
    return (packed * 0.5 + (len(columns) - packed) * 8) / (8 * len(columns)) if columns else 1.0


def sentences(text: Column) -> Column:
    """Sentences with their end marks; the white space between them is dropped."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), r"(?<=[。！？.!?;；])(?![。！？.!?;；])\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def char_tokens(text: Column) -> Column:
    """Single Han characters, and runs of Latin letters and digits, in order."""
    return F.regexp_extract_all(text, F.lit("([一-鿿]|[A-Za-z0-9]+)"), 1)


def boundary_split(text: Column) -> Column:
    """Pieces between Han and other text."""
    return F.filter(F.split(text, "(?<=[一-鿿])(?=[^一-鿿])|(?<=[^一-鿿])(?=[一-鿿])"), lambda s: s != "")


def char_ngrams(text: Column, n: int) -> Column:
    size = F.length(text) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(size < 1, F.expr("cast(array() as array<string>)")).otherwise(grams)


def dictionary_tokens(words: list[str]) -> Callable[[Column], Column]:
    """Longest-match tokens over a dictionary, single characters where no word fits, without blanks: one alternation, the longest words first."""
    longest = "|".join(re.escape(w) for w in sorted({w for w in words if w}, key=lambda w: (-len(w), w)))
    pattern = (longest + "|" if longest else "") + "(?s:.)"
    blank = "^(?U)[\\s\\x1c-\\x1f]$"
    return lambda text: F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: ~w.rlike(blank))


def normalise_unicode(text: Column) -> Column:
    """NFKC, plain quotes, no zero-width characters, trimmed. Spark has no NFKC, so Arrow batches go through Python."""
    table = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "\u200b": None, "\u200c": None, "\u200d": None, "\ufeff": None, "\u2060": None})

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x.translate(table)).translate(table).strip())

    return run(text)


def blocked_ip(address: Column) -> Column:
    """Private, loop-back, link-local, carrier, multicast and malformed IPv4 addresses."""
    part = lambda i: F.element_at(F.split(address, r"\."), i).cast("int")
    a, b, c, d = (part(i) for i in range(1, 5))
    bad = (a > 255) | (b > 255) | (c > 255) | (d > 255)
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    special = ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), bad | private | special).otherwise(F.lit(True))


def numbers_with_units(text: Column) -> Column:
    """Numbers of a text with their units worked in: percent, ten thousand, hundred million, million million."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?\s*(?:%|万亿|万|亿)?)"), 1)

    def value(x: Column) -> Column:
        n = F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1).cast("double")
        return F.when(x.endswith("%"), n / 100).when(x.endswith("万亿"), n * 1e12).when(x.endswith("万"), n * 1e4).when(x.endswith("亿"), n * 1e8).otherwise(n)

    return F.transform(found, value)


# -- closed forms, in their published shape -------------------------------------------


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def bayes(prior: Column, likelihood: Column, evidence: Column) -> Column:
    return prior * likelihood / evidence


def hick(choices: Column, b: float = 0.2) -> Column:
    return F.log2(choices + 1) * b


def fitts(distance: Column, width: Column, a: float = 0.1, b: float = 0.1) -> Column:
    return a + b * F.log2(2 * distance / width)


def weber_fechner(stimulus: Column, threshold: Column, k: float = 1.0) -> Column:
    return k * F.log(stimulus / threshold)


def rescorla_wagner(v: Column, reward: Column, rate: float = 0.1) -> Column:
    return v + rate * (reward - v)


def q_update(q: Column, reward: Column, best_next: Column, rate: float = 0.1, discount: float = 0.9) -> Column:
    return q + rate * (reward + discount * best_next - q)


def stdp(dt: Column, plus: float = 0.1, minus: float = 0.12, tau: float = 20.0) -> Column:
    return F.when(dt > 0, plus * F.exp(-dt / tau)).when(dt < 0, -minus * F.exp(dt / tau)).otherwise(F.lit(0.0))


def drift_diffusion(drift: Column, boundary: Column, noise: float = 1.0) -> Column:
    """Probability of the upper boundary."""
    return 1 / (1 + F.exp(-2 * drift * boundary / (noise * noise)))


def pleasure_arousal_dominance(pleasure: Column, arousal: Column, dominance: Column) -> Column:
    """Length of the mood vector over its largest."""
    return F.sqrt(pleasure * pleasure + arousal * arousal + dominance * dominance) / F.sqrt(F.lit(3.0))


def round_binary(x: Column, digits: int) -> Column:
    """Half up of the binary value, as C and DuckDB round; Spark's round takes the decimals that a double prints as, so 0.0628125 may differ."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def activation_base(accesses: Column, now: Column, decay: float = 0.5) -> Column:
    """Base-level activation from the times of accesses: log of the sum of age^-d."""
    return F.log(F.aggregate(accesses, F.lit(0.0), lambda a, t: a + F.pow(F.greatest(now - t, F.lit(1e-9)), F.lit(-decay))))


def decision_heat(values: Column, weights: Column) -> Column:
    """Weighted mean of an array by another array."""
    pairs = F.zip_with(values, weights, lambda v, w: v * w)
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / total
