"""Patterns that mean the same to Spark (Java), DuckDB (RE2) and the ASCII-only rules they are stated in.

Rules are written with ``\\b``, ``\\s``, ``\\w`` and ``\\d`` in their ASCII sense,
where ``\\s`` also covers the ideographic and no-break space. Java's ``\\b`` sees
Han characters as word characters and its ``\\s`` misses U+3000, so both are
spelt out for Spark. Patterns with look-around or back-references run on Spark
alone; ``portable`` tells them apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_SPACES = "\\s\\u3000\\u00a0\\ufeff"

CJK = "[一-鿿]"


def _boundary(pattern: str, at: int) -> str:
    """The cheapest form of the boundary at ``at``: next to a certain word character only the other side is looked at."""
    before, after = pattern[at - 1 : at], pattern[at + 2 : at + 3]
    if after.isascii() and (after.isalnum() or after == "_") and pattern[at + 3 : at + 4] not in ("?", "*", "{"):
        return "(?<![A-Za-z0-9_])"
    if before.isascii() and before.isalnum() and pattern[at - 2 : at - 1] != "\\":
        return "(?![A-Za-z0-9_])"
    return _BOUNDARY


def java(pattern: str) -> str:
    """The pattern for Spark, with explicit ASCII boundaries and wide spaces."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "b" and not inside:
                out.append(_boundary(pattern, i))
            elif n == "s":
                out.append(_SPACES if inside else f"[{_SPACES}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if inside and c in "[&":
            out.append("\\" + c)
        else:
            out.append(c)
        if c == "[" and not inside:
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "]" and inside:
            inside = False
        i += 1
    return "".join(out)


def needs_cjk(pattern: str) -> bool:
    """Whether every match has a Han character: no letter or digit of another script is in the pattern, and each
    alternative at the top has a Han character that is not optional. Then texts without one need not be searched."""
    bare = re.sub(r"\\[a-zA-Z]|\{[0-9,]+\}|\(\?[:=!<i]*", "", pattern)
    if re.search(r"[A-Za-z0-9]", bare):
        return False
    depth, parts, start = 0, [], 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
    parts.append(pattern[start:])

    def certain(part: str) -> bool:
        while True:
            less = re.sub(r"\((?:\?:)?[^()]*\)[?*]|\[[^\]]*\][?*]|\[\^[^\]]*\](?:\{0,\d+\}\??)?|.[?*]", "", part)
            if less == part:
                break
            part = less
        inner = re.fullmatch(r"\((?:\?:)?(.*)\)", part)
        if inner and "(" not in inner[1]:
            return all(re.search(CJK, x) for x in inner[1].split("|"))
        return bool(re.search(CJK, re.sub(r"\[[^\]]*\]", "", part)))

    return all(map(certain, parts))


def portable(pattern: str) -> bool:
    """Whether RE2 can run the pattern."""
    return not re.search(r"\(\?[=!<]|\\[1-9]", pattern)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + java(pattern))


def count_matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(("(?i)" if ignore_case else "") + java(pattern)))


def has_cjk(text: Column) -> Column:
    """Whether the text has a Han character. ASCII texts, whose bytes are their characters, are not searched."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(CJK)


def sql_text(value: str) -> str:
    """The value as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def risky(pattern: str) -> str | None:
    """Why a user-supplied pattern may not be used: too long, invalid, or a repeated group that itself repeats; None if it may."""
    if len(pattern) > 500:
        return "too long"
    try:
        re.compile(pattern)
    except re.error:
        return "invalid"
    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)\s*(?:[+*]|\{\d+,)", pattern):
        return "nested repetition"
    if re.search(r"(?:\.\*){2,}|(?:\.\+){2,}", pattern):
        return "adjacent wildcards"
    return None


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: White space and marks between words. A run of them is taken as one ``GAP`` by ``required_runs``.
MARKS = " \t\n\r\x0b\x0c\u3000\u00a0\ufeff,.;:!?\x01"
GAP = "\x01"


def _is_gap(items) -> bool:
    """Whether parsed items match marks only, and at least one."""
    if len(items) != 1:
        return False
    (op, arg), marks = items[0], set(map(ord, MARKS))
    if str(op) == "LITERAL":
        return arg in marks
    if str(op) != "IN":
        return False
    plain = lambda o, x: o == "LITERAL" and x in marks or o == "RANGE" and set(range(x[0], x[1] + 1)) <= marks or o == "CATEGORY" and str(x) == "CATEGORY_SPACE"
    return all(plain(str(o), x) for o, x in arg)


def _certain(items, gaps: bool) -> list[list[str]]:
    """What every match of parsed items holds: lists of runs of characters, of each of which it holds one."""
    found: list[list[str]] = []
    run: list[str] = []

    def cut() -> None:
        if run:
            found.append(["".join(run)])
            run.clear()

    def gap() -> None:
        if run[-1:] != [GAP]:
            run.append(GAP)

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if gaps and name in ("LITERAL", "IN") and _is_gap([(op, arg)]):
                gap()
            elif name == "LITERAL":
                run.append(chr(arg))
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name == "ATOMIC_GROUP":
                walk(arg)
            elif gaps and name.endswith("REPEAT") and arg[0] >= 1 and _is_gap(arg[2]):
                gap()
            elif name.endswith("REPEAT") and arg[0] >= 1:
                walk(arg[2])
                if arg[1] != 1:
                    cut()
            elif name == "BRANCH":
                cut()
                each = [_best(_certain(list(x), gaps)) for x in arg[1]]
                if all(each):
                    found.append([lit for part in each for lit in part])
            else:
                cut()

    walk(items)
    cut()
    return found


def _best(found: list[list[str]]) -> list[str]:
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=[])


def required_literals(pattern: str) -> list[str]:
    """Literals, ASCII letters in lower case, of which every match holds one in either case; empty if none is certain.

    They are the longest run of certain characters, or the alternatives of a group where the
    shortest of those is longer.
    """
    return [x.translate(_ASCII_LOWER) for x in _best(_certain(list(re._parser.parse(pattern)), False))]  # noqa: SLF001


def required_runs(pattern: str) -> tuple[list[str], list[str]]:
    """(runs, needs), ASCII letters in lower case. Every match, with each run of ``MARKS`` as one ``GAP``, holds one of the runs; a match as it stands holds each of the needs."""
    parsed = list(re._parser.parse(pattern))  # noqa: SLF001
    lower = lambda xs: [x.translate(_ASCII_LOWER) for x in xs]
    return lower(_best(_certain(parsed, True))), lower(x[0] for x in _certain(parsed, False) if len(x) == 1)
