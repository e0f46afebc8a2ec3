"""Rule expressions: declared once, compiled to a Spark Column and to DuckDB SQL.

A detector is data: a length guard, exemptions, and one condition (or one for
each language, chosen by whether the text has a Han character). Compiling gives
a pure Column, so a table of texts is judged in one projection without a
shuffle or a UDF; guards come first as an outer ``when``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.regex import CJK, has_cjk, java, needs_cjk, portable, sql_text
from quern.operators.screen import current, screened


#: Up to so many literals are looked for one by one, which beats an alternation.
FEW_LITERALS = 24


class Expr:
    """A condition on one text."""

    def column(self, text: Column) -> Column:
        raise NotImplementedError

    def sql(self, text: str) -> str:
        raise NotImplementedError

    def portable(self) -> bool:
        return True

    def __and__(self, other: Expr) -> Expr:
        return All(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Some(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class Match(Expr):
    """Whether a pattern occurs; ``ignore`` for either case."""

    pattern: str
    ignore: bool = False

    def column(self, text: Column) -> Column:
        if current():
            return current().hit(text, self.pattern, self.ignore)
        hit = text.rlike(("(?i)" if self.ignore else "") + java(self.pattern))
        return has_cjk(text) & hit if needs_cjk(self.pattern) else hit

    def sql(self, text: str) -> str:
        return f"regexp_matches({text}, {sql_text(('(?i)' if self.ignore else '') + self.pattern)})"

    def portable(self) -> bool:
        return portable(self.pattern)


@dataclass(frozen=True)
class Contains(Expr):
    """Whether a literal occurs; ``lower`` compares with the lower-cased text."""

    literal: str
    lower: bool = False

    def column(self, text: Column) -> Column:
        plain = lambda t: (F.lower(t) if self.lower else t).contains(F.lit(self.literal))
        return current().contains(text, (self.literal,), self.lower, plain) if current() else plain(text)

    def sql(self, text: str) -> str:
        return f"contains({f'lower({text})' if self.lower else text}, {sql_text(self.literal)})"


class _Many(Expr):
    def __init__(self, *parts: Expr):
        self.parts = parts

    def portable(self) -> bool:
        return all(p.portable() for p in self.parts)


class All(_Many):
    def column(self, text: Column) -> Column:
        return reduce(lambda a, b: a & b, [p.column(text) for p in self.parts], F.lit(True))

    def sql(self, text: str) -> str:
        return "(" + (" AND ".join(p.sql(text) for p in self.parts) or "true") + ")"


class Some(_Many):
    """Whether any part holds. Patterns of one kind become one alternation, so a list costs one pass over the text."""

    def _joined(self) -> list[Expr]:
        flat: list[Expr] = []
        for p in self.parts:
            flat += p._joined() if isinstance(p, Some) else [p]
        out: list[Expr] = []
        for ignore in (False, True):
            own = [p.pattern for p in flat if isinstance(p, Match) and p.ignore == ignore]
            if own:
                out.append(Match("|".join(f"(?:{x})" for x in own) if len(own) > 1 else own[0], ignore))
        for lower in (False, True):
            own = [p.literal for p in flat if isinstance(p, Contains) and p.lower == lower]
            if own:
                out.append(Literals(tuple(own), lower) if len(own) > 1 else Contains(own[0], lower))
        return out + [p for p in flat if not isinstance(p, Match | Contains)]

    def column(self, text: Column) -> Column:
        return reduce(lambda a, b: a | b, [p.column(text) for p in self._joined()], F.lit(False))

    def sql(self, text: str) -> str:
        return "(" + (" OR ".join(p.sql(text) for p in self.parts) or "false") + ")"


@dataclass(frozen=True)
class Literals(Expr):
    """Whether any of many literals occurs, by one alternation of quoted strings."""

    literals: tuple[str, ...]
    lower: bool = False

    def column(self, text: Column) -> Column:
        return current().contains(text, self.literals, self.lower, self._column) if current() else self._column(text)

    def _column(self, text: Column) -> Column:
        if len(self.literals) <= FEW_LITERALS:
            low = F.lower(text) if self.lower else text
            return reduce(lambda a, b: a | b, [low.contains(F.lit(x)) for x in self.literals])
        pattern = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", x) for x in self.literals)
        return (F.lower(text) if self.lower else text).rlike(pattern)

    def sql(self, text: str) -> str:
        return "(" + " OR ".join(Contains(x, self.lower).sql(text) for x in self.literals) + ")"


class Not(_Many):
    def column(self, text: Column) -> Column:
        return ~self.parts[0].column(text)

    def sql(self, text: str) -> str:
        return f"NOT {self.parts[0].sql(text)}"


class AtLeast(_Many):
    """Whether ``least`` of the parts hold."""

    def __init__(self, least: int, *parts: Expr):
        super().__init__(*parts)
        self.least = least

    def column(self, text: Column) -> Column:
        return reduce(lambda a, b: a + b, [p.column(text).cast("int") for p in self.parts]) >= self.least

    def sql(self, text: str) -> str:
        return "(" + " + ".join(f"({p.sql(text)})::INT" for p in self.parts) + f" >= {self.least})"


class Cjk(Expr):
    """Whether the text has a Han character."""

    def column(self, text: Column) -> Column:
        return has_cjk(text)

    def sql(self, text: str) -> str:
        return f"regexp_matches({text}, '{CJK}')"


def any_of(*patterns: str, ignore: bool = False) -> Expr:
    return Some(*[Match(p, ignore) for p in patterns])


def any_literal(*literals: str, lower: bool = False) -> Expr:
    return Some(*[Contains(x, lower) for x in literals])


def by_language(zh: Expr, en: Expr) -> Expr:
    """``zh`` for texts with a Han character, ``en`` for the others."""
    return Some(All(Cjk(), zh), All(Not(Cjk()), en))


@dataclass(frozen=True)
class Detector:
    """One dimension. ``routes`` are (condition, score), the first that holds counts."""

    name: str
    routes: tuple[tuple[Expr, float], ...]
    exempt: tuple[Expr, ...] = ()
    least_chars: int = 6
    max_score: float = 1.0
    note: str = ""
    tags: tuple[str, ...] = field(default=())

    def portable(self) -> bool:
        return all(e.portable() for e in self.exempt) and all(c.portable() for c, _ in self.routes)

    def score(self, text: Column) -> Column:
        """The score, 0 for no hit; null and short texts never hit."""
        found = F.lit(0.0)
        for condition, score in reversed(self.routes):
            found = F.when(condition.column(text), F.lit(float(score))).otherwise(found)
        for e in reversed(self.exempt):
            found = F.when(e.column(text), F.lit(0.0)).otherwise(found)
        return F.when(F.coalesce(F.length(text), F.lit(0)) >= self.least_chars, found).otherwise(F.lit(0.0))

    def sql(self, text: str) -> str:
        cases = [f"WHEN coalesce(length({text}), 0) < {self.least_chars} THEN 0.0"]
        cases += [f"WHEN {e.sql(text)} THEN 0.0" for e in self.exempt]
        cases += [f"WHEN {c.sql(text)} THEN {float(score)}" for c, score in self.routes]
        return f"(CASE {' '.join(cases)} ELSE 0.0 END)::DOUBLE"


def detect(texts: DataFrame, detectors: list[Detector], text_col: str = "text", group: int = 8) -> DataFrame:
    """Adds ``<name>_score`` for each detector.

    Detectors are added a group at a time, so that no projection outgrows the
    size up to which a method is compiled. Their literals are looked for once.
    """
    return screened(texts, F.col(text_col), lambda: {f"{d.name}_score": d.score(F.col(text_col)) for d in detectors}, group)


def findings(texts: DataFrame, detectors: list[Detector], text_col: str = "text") -> DataFrame:
    """Adds ``findings``: (dimension, severity 0 to 100, score) of the hits, most severe first, then in declared order."""
    scores = [f"{d.name}_score" for d in detectors]
    scored = detect(texts, detectors, text_col).withColumn("findings", F.array(*scores)).drop(*scores)
    names = F.array(*[F.lit(d.name) for d in detectors])
    rows = F.transform(
        "findings",
        lambda s, i: F.struct(F.element_at(names, i + 1).alias("dimension"), F.floor(s * 100 + 0.5).cast("int").alias("severity"), s.alias("score"), i.alias("place")),
    )
    by = lambda a, b: F.when(a["severity"] != b["severity"], b["severity"] - a["severity"]).otherwise(a["place"] - b["place"])
    return scored.withColumn("findings", F.array_sort(F.filter(rows, lambda x: x["score"] > 0), by))
