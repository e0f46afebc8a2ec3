"""Counts of one text that several operators share. Words are runs of bytes other than space and 0x09 to 0x0D."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Character classes of the histograms; ``other`` is all code points above ASCII.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "mark", "control", "other")

#: The characters of the symbol count and the sentence punctuation.
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    """Class of each byte; -1 for continuation bytes, which are no code points of their own."""
    out = np.full(256, CLASSES.index("mark"), np.int64)
    for byte in range(256):
        char = bytes([byte])
        if byte >= 0xC0:
            kind = "other"
        elif byte >= 0x80:
            out[byte] = -1
            continue
        elif char.islower():
            kind = "lower"
        elif char.isupper():
            kind = "upper"
        elif char.isdigit():
            kind = "digit"
        elif char.isspace():
            kind = "space"
        elif char in SYMBOLS:
            kind = "symbol"
        elif char in STOPS:
            kind = "stop"
        elif byte < 32 or byte == 127:
            kind = "control"
        else:
            kind = "mark"
        out[byte] = CLASSES.index(kind)
    return out


_CLASS = _class_table()
_SYMBOL_BYTES = np.frombuffer(SYMBOLS, np.uint8)
_SPACE_BYTES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_FOLD = np.array([CLASSES.index(c) for c in CLASSES])


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def class_counts(counts: np.ndarray) -> np.ndarray:
    """Code points by class, from the counts of the bytes."""
    seen = _CLASS >= 0
    return np.bincount(_CLASS[seen], weights=counts[seen], minlength=len(CLASSES))


def code_points(counts: np.ndarray) -> int:
    return int(counts[:0x80].sum() + counts[0xC0:].sum())


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    hit = np.fromiter((w in often for w in windows), bool, n)
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(data: bytes) -> tuple[list[bytes], np.ndarray, dict[str, int]]:
    """The words, the byte counts and the counts that the quality rules are based on."""
    words, counts = data.split(), byte_counts(data)
    return (
        words,
        counts,
        {
            "n_words": len(words),
            "word_chars": code_points(counts) - int(counts[_SPACE_BYTES].sum()),
            "n_symbols": int(counts[_SYMBOL_BYTES].sum()),
            "n_dup_lines": duplicate_lines(data),
            "n_repeat_words": repeated_words(words),
        },
    )
