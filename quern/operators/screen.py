"""What spares patterns most texts: one search for all literals that the patterns of a projection need.

Every match of most patterns holds one of a few literals (``regex.required_literals``). ``screened`` makes a
trie of those of all patterns, looks for them once a text, in one linear pass, and a pattern is only
tried on texts that hold one of its literals. Results are those of the patterns alone; patterns without a
certain literal are tried on each text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.regex import has_cjk, java, needs_cjk, required_literals

HELD = "__held"

#: Latin literals below it are in nearly every text.
LEAST_LITERAL = 3

_current: ContextVar[Screen | None] = ContextVar("screen", default=None)


def current() -> Screen | None:
    return _current.get()


def _split(pattern: str) -> list[str]:
    """The alternatives at the top of a pattern."""
    depth, inside, parts, start, i = 0, False, [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += pattern[i + 1 : i + 2] == "^"
            i += pattern[i + 1 : i + 2] == "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def alternatives(pattern: str) -> list[str]:
    """Patterns of which one occurs where ``pattern`` does: its alternatives, also those of a group that is all of it but for boundaries."""
    if re.search(r"\(\?[a-zA-Z]|\\[1-9]", pattern):
        return [pattern]
    parts = _split(pattern)
    if len(parts) > 1:
        return [x for p in parts for x in alternatives(p)]
    whole = re.fullmatch(r"(\\b)?\((?:\?:)?(?!\?)(.*)\)(\\b)?", pattern, re.S)
    if whole:
        inner = _split(whole[2])
        try:
            re.compile(whole[2])
        except re.error:  # two groups side by side
            return [pattern]
        if len(inner) > 1 or (whole[1] is None and whole[3] is None):
            a, b = whole[1] or "", whole[3] or ""
            return [x for p in inner for x in (alternatives(p) if not a and not b else [f"{a}(?:{p}){b}"])]
    return [pattern]


@lru_cache(None)
def literals(pattern: str) -> tuple[str, ...]:
    """Lower-cased literals of which every match holds one in either case; none if that is not certain or of no use."""
    try:
        found = required_literals(re.sub(r"^\(\?i\)", "", pattern))
    except re.error:
        return ()
    for x in found:
        if x.lower() != x or (x.isascii() and len(x) < LEAST_LITERAL):
            return ()
    return tuple(sorted(set(found)))


@lru_cache(None)
def _groups(pattern: str) -> tuple[tuple[str, tuple[str, ...], bool], ...]:
    """(pattern, its literals, whether it needs a Han character), of which one occurs where ``pattern`` does: alternatives by how common their literals are."""
    groups: dict[tuple[int, str], list] = {}
    for part in alternatives(pattern):
        own = literals(part)
        kind = (-1 if needs_cjk(part) else 0) if not own else 4 if not any(x.isascii() for x in own) else min(3, (min(len(x) for x in own if x.isascii()) - 1) // 2)
        # an alternative with a common literal has a condition of its own
        groups.setdefault((kind, part if kind == 1 else ""), []).append((part, own))
    return tuple(("|".join(f"(?:{p})" for p, _ in g) if len(g) > 1 else g[0][0], tuple(sorted({x for _, own in g for x in own})) if kind > 0 else (), kind == -1) for (kind, _), g in sorted(groups.items(), reverse=True))


def _trie(words: list[str]) -> str:
    """A pattern for the longest of the words at a place. Many branches are halved by a look at the next character."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}
    quoted = lambda c: f"\\x{{{ord(c):x}}}"

    def branch(chars: list[str], node: dict) -> str:
        if len(chars) > 4:
            half = [chars[: len(chars) // 2], chars[len(chars) // 2 :]]
            return "(?:" + "|".join(f"(?=[{quoted(h[0])}-{quoted(h[-1])}]){branch(h, node)}" for h in half) + ")"
        rows = [quoted(c) + below(node[c]) for c in chars]
        return rows[0] if len(rows) == 1 else "(?:" + "|".join(rows) + ")"

    def below(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        one = branch(chars, node)
        return f"(?:{one})?" if "" in node else one

    return f"(?=({branch(sorted(tree), tree)}))"


class Screen:
    """The literals of a projection's patterns, and conditions on them."""

    def __init__(self) -> None:
        self.words: set[str] = set()

    def some(self, own: tuple[str, ...]) -> Column:
        """Whether the text holds one of the literals. A place gives the longest literal there, so any that begins with one of them tells."""
        self.words |= set(own)
        named = sorted(w for w in self.words if w.startswith(own))
        return F.arrays_overlap(F.col(HELD), F.array(*[F.lit(w) for w in named]))

    def hit(self, text: Column, pattern: str, ignore: bool) -> Column:
        """Whether the pattern occurs in the text."""
        flag, out = "(?i)" if ignore else "", []
        for part, own, han in _groups(pattern):
            hit = text.rlike(flag + java(part))
            out.append(self.some(own) & hit if own else has_cjk(text) & hit if han else hit)
        return reduce(lambda a, b: a | b, out)

    def contains(self, text: Column, words: tuple[str, ...], lower: bool, plain: Callable[[Column], Column]) -> Column:
        """``plain``, tried where the text holds one of the words in either case."""
        own = tuple(w.lower() for w in words)
        usable = all(len(w) >= LEAST_LITERAL or not w.isascii() for w in own) and all(own) and (not lower or own == words)
        return self.some(own) & plain(text) if usable else plain(text)

    def count(self, text: Column, pattern: str, ignore: bool) -> Column:
        """How often the pattern matches."""
        groups = _groups(pattern)
        own = tuple(sorted({x for g in groups for x in g[1]})) if all(g[1] for g in groups) else ()
        n = F.regexp_count(text, F.lit(("(?i)" if ignore else "") + java(pattern)))
        return F.when(self.some(own), n).otherwise(F.when(text.isNotNull(), 0)) if own else n

    def held(self, text: Column) -> Column:
        """The literals that the text holds."""
        low, parts = F.lower(text), []
        plain, wide = sorted(w for w in self.words if w.isascii()), sorted(w for w in self.words if not w.isascii())
        none = F.expr("cast(array() as array<string>)")
        if plain:
            parts.append(F.regexp_extract_all(low, F.lit(_trie(plain)), F.lit(1)))
        if wide:
            parts.append(F.when(F.octet_length(text) != F.length(text), F.regexp_extract_all(low, F.lit(_trie(wide)), F.lit(1))).otherwise(none))
        return F.array_distinct(F.concat(*parts)) if parts else none


@contextmanager
def _as_current(screen: Screen):
    token = _current.set(screen)
    try:
        yield
    finally:
        _current.reset(token)


def screened(texts: DataFrame, text: Column, build: Callable[[], dict[str, Column]], group: int = 8) -> DataFrame:
    """Adds the columns that ``build`` gives, ``group`` to a projection. All patterns in them are held against ``text``, a part or another case of it.

    ``build`` is called twice: for its literals, then for its columns.
    """
    screen = Screen()
    with _as_current(screen):
        build()
        columns = list(build().items())
    rows = texts.withColumn(HELD, screen.held(text))
    out = rows.select(F.inline(F.array(F.struct(*rows.columns))))  # computed once: no expression passes a generator
    for at in range(0, len(columns), group):
        out = out.withColumns(dict(columns[at : at + group]))
    return out.drop(HELD)
