"""Secret scans by sliding-window Shannon entropy, on DataFrame functions alone.

Base rules find assignments, access keys and hexadecimal runs. The method then
looks at candidate strings (runs of token characters, in what base spans and
allow-listed words leave of the text), slides a window over each, keeps the
entropy up to date by the counts of the character that enters and of the one that
leaves, and reports a candidate whose best window reaches the threshold of its
character class, unless an allow-list pattern matches the whole of it. So a token
is found although an allow-listed word is glued to it or a base span touches it.

Results for odd input: a null or empty text has no spans; very long texts are
scanned whole; repeated rows give repeated results; an empty table gives an
empty table; further columns are not read, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of a finding.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
CANDIDATE = r"([A-Za-z0-9+/=_-]{20,})"
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 12, "access": 18, "hex": 16, "entropy": 20}

#: Characters in the sliding window.
WINDOW = 20

#: Character class: the candidates that belong to it (first match wins) and the entropy in bits that a window must reach.
#: A window of letters must have 18 distinct characters or nearly so: words and paths, whose letters repeat, stay below.
CLASSES = (
    ("digits", r"^[0-9]+$", 3.1),
    ("letters", r"^[A-Za-z_=+/-]+$", 4.05),
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("mixed", r"^.*$", 3.75),
)

#: Words of samples: they end a candidate, what is left on either side is a candidate of its own.
ALLOW_WORDS = r"(?i)example|placeholder|changeme|dummy|sample|your[_-]?(?:key|token|secret)|x{6,}|0123456789|abcdefghij"

#: Whole candidates that are never reported.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.)\1*$",
)

_SCALE = 1_000_000_000
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _c_log_c(count: int) -> int:
    """count * log2(count) in whole billionths, so that adding and removing leaves no rounding error."""
    return round(count * math.log2(count) * _SCALE) if count > 0 else 0


def best_window_bits(candidate: Column) -> Column:
    """The largest Shannon entropy (bits a character) of any window of the candidate.

    The state holds the window and the sum of c*log2(c) of its character counts.
    A step looks up two counts in the window, that of the character that leaves and
    that of the one that enters, and changes the sum by what the two change.
    """
    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    fewer = F.array(*[F.lit(_c_log_c(k - 1) - _c_log_c(k)).cast("long") for k in range(WINDOW + 1)])
    more = F.array(*[F.lit(_c_log_c(k + 1) - _c_log_c(k)).cast("long") for k in range(WINDOW + 1)])
    start = F.struct(F.lit("").alias("window"), F.lit(0).cast("long").alias("total"), F.lit(2**62).cast("long").alias("least"))

    def count(window: Column, c: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, c, F.lit("")))

    def least(state: Column) -> Column:
        return F.when(F.length(state["window"]) == WINDOW, F.least(state["least"], state["total"])).otherwise(state["least"])

    def step(state: Column, c: Column) -> Column:
        window = state["window"]
        full = F.length(window) == WINDOW
        first = F.substring(window, 1, 1)
        gone = F.when(full, F.element_at(fewer, count(window, first) + 1)).otherwise(F.lit(0).cast("long"))
        same = F.when(full & (first == c), F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            F.concat(F.when(full, F.substring(window, 2, WINDOW - 1)).otherwise(window), c).alias("window"),
            (state["total"] + gone + F.element_at(more, count(window, c) - same + 1)).alias("total"),
            least(state).alias("least"),
        )

    return F.lit(math.log2(WINDOW)) - F.aggregate(chars, start, step, least) / F.lit(float(WINDOW * _SCALE))


def is_secret_like(candidate: Column) -> Column:
    """Whether a window reaches the threshold of the candidate's class and no allow-list pattern matches the whole."""
    bits = best_window_bits(candidate)
    verdict = F.lit(False)
    for _, pattern, least in reversed(CLASSES):
        verdict = F.when(candidate.rlike(pattern), F.lit(False) if least is None else bits >= least).otherwise(verdict)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    return ~allowed & verdict


def _matches(text: Column, pattern: str, rank: int, least: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches: the gaps between matches and the matches themselves give the places."""
    none = F.expr(f"cast(array() as {_SPAN})")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # but for assignments the value is the whole match
    hits = F.arrays_zip(whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value"))
    if pattern != ASSIGN:
        hits = F.transform(whole, lambda m: F.struct(m.alias("whole"), m.alias("value")))
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        hits,
        lambda gap, hit: F.struct(
            F.length(gap).alias("gap"),
            F.coalesce(F.length(hit["whole"]), F.lit(0)).alias("long"),
            F.coalesce((F.length(hit["value"]) >= least) & (keep(hit["value"]) if keep else F.lit(True)), F.lit(False)).alias("kept"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["long"]).alias("end"))
        return F.struct(
            (begin + x["long"]).alias("at"),
            F.when(x["kept"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    found = F.aggregate(pieces, start, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _blank(length: Column) -> Column:
    return F.repeat(F.lit(" "), length.cast("int"))


def _without_spans(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans (sorted): every other character keeps its place."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] > state["at"], F.substring(text, state["at"] + 1, s["start"] - state["at"])).otherwise(F.lit(""))
        blank = _blank(F.greatest(s["end"] - F.greatest(s["start"], state["at"]), F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(gap, blank)).alias("parts"))

    rest = F.aggregate(spans, start, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def _without_words(text: Column) -> Column:
    """The text with blanks in place of allow-listed words."""
    pieces = F.zip_with(
        F.split(text, ALLOW_WORDS, -1),
        F.regexp_extract_all(text, F.lit(ALLOW_WORDS), F.lit(0)),
        lambda gap, hit: F.concat(gap, _blank(F.coalesce(F.length(hit), F.lit(0)))),
    )
    return F.when(text.rlike(ALLOW_WORDS), F.array_join(pieces, "")).otherwise(text)


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds ``out``: an array of (start, rank of the kind in KINDS, end), sorted; code points, end exclusive.

    A projection: no shuffle, no Python, one pass over the text for each pattern,
    and the costly part only for the few texts that have a match.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn(
        out,
        F.array_sort(
            F.concat(
                *[
                    _matches(text, pattern, KINDS.index(kind), LEAST[kind])
                    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
                ]
            )
        ),
    )
    rest = "__secret_rest"
    base = base.withColumn(rest, F.when(text.rlike(CANDIDATE), _without_spans(text, F.col(out))).otherwise(F.lit("")))
    base = base.withColumn(rest, F.when(F.col(rest).rlike(CANDIDATE), _without_words(F.col(rest))).otherwise(F.lit("")))
    more = _matches(F.col(rest), CANDIDATE, KINDS.index("entropy"), LEAST["entropy"], is_secret_like)
    return base.withColumn(out, F.array_sort(F.concat(F.col(out), more))).drop(rest)


def spans_text(spans: Column, method: bool = True) -> Column:
    """Spans as kind:start:end, joined by commas; without ``method`` the base spans only."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    chosen = spans if method else F.filter(spans, lambda s: s["rank"] < KINDS.index("entropy"))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replaces every span of ``find_secrets`` by ``mask``; overlapping spans are replaced as one. Null texts stay null."""
    found = "__secret_spans"
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        part = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"),
        )

    clean = F.aggregate(
        F.col(found), start, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    )
    return find_secrets(docs, text_col, found).withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(text)).drop(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by kind, a digest of the base spans and all spans as text."""
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(spans_text(F.col("secret_spans"), method=False), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
