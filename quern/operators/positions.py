"""Match positions as a relation: (key, name, start, end, value), and what follows from joins and windows over it.

Nearness, nesting and order of matches are conditions between rows, so patterns need no
look-around and brackets are matched by depth, not by a pattern.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.regex import java
from quern.operators.text_rules import NAME_NEEDS
from quern.sources.scratch import written

# Words that are no exported names.
NO_NAMES = (
    "function", "const", "let", "var", "if", "else", "return", "throw", "new", "try", "catch", "for", "while", "switch", "case", "break", "continue", "typeof", "instanceof", "void", "delete", "this",
    "true", "false", "null", "undefined", "NaN", "Infinity", "module", "exports", "async", "await", "yield", "of", "in", "static", "get", "set", "class", "extends", "super", "import", "export", "from",
    "default", "as", "require",
)
DECLARED = r"(?:function|const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("
DECLARATION = r"(?i)(?:function|const|let|var|async)\s+{}\s*\("
EXPORTS = r"module\.exports\s*=\s*\{"
NAME = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
THROWN, CALLED_BACK = r"throw\s+new\s+Error", r"callback\s*\(\s*(?:err|error)"


def occurrences(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, name, start, end, value) of all matches, leftmost and not overlapping, in code points from 0, ``end`` exclusive.

    A text is cut at the matches of a pattern once; places are running sums of the lengths of pieces and
    matches. Patterns that can match nothing are refused by their empty matches having no place.
    """
    # texts without a match, most of them, are looked through once and not cut
    found = lambda n, p: F.struct(F.lit(n).alias("name"), F.regexp_extract_all(text, F.lit(java(p)), 0).alias("v"), F.split(F.col(text), java(p), -1).alias("g"))
    cut = [F.when(F.col(text).rlike(java(p)), found(n, p)) for n, p in patterns.items()]
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*cut)).alias("m")).where("m is not null").select("key", "m.*")
    rows = rows.select("key", "name", F.posexplode(F.arrays_zip("v", F.slice("g", 1, F.size("v")).alias("g"))).alias("k", "x")).where("x.v <> ''")
    upto = Window.partitionBy("key", "name").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("x.v")
    end = F.sum(F.length("x.g") + size).over(upto)
    return rows.select(F.col("key").alias(key), "name", (end - size).alias("start"), end.alias("end"), F.col("x.v").alias("value"))


def matched(brackets: DataFrame, key: str, opening: str = "{") -> DataFrame:
    """(key, open, close) of brackets (key, start, value): each opening one and its closing one, null if it has none.

    Depth is a running sum. A bracket is closed by the first one that brings the depth below its own,
    which is the next row of the same level: no bracket is compared with another.
    """
    deep = F.sum(F.when(F.col("value") == opening, 1).otherwise(-1)).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    rows = brackets.select(key, "start", "value").withColumn("__depth", deep)
    opens = F.col("value") == opening
    rows = rows.withColumn("__level", F.when(opens, F.col("__depth")).otherwise(F.col("__depth") + 1))
    level = Window.partitionBy(key, "__level").orderBy("start")
    paired = rows.withColumn("close", F.when(~F.lead(opens).over(level), F.lead("start").over(level)))
    return paired.where(opens).select(key, F.col("start").alias("open"), "close")


def structure(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, misnamed, unexported, mixed) of code texts: functions whose body lacks what their name promises, whether a
    function is not among the exports, and whether errors are both thrown and called back. Keys are unique; null texts are left out.
    """
    known = texts.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.col(text).alias("code"))
    # written: it is read three times
    spots = occurrences(known, key, "code", {"brace": "[{}]", "exports": EXPORTS} | {f"name:{n}": DECLARATION.format(n) for n, _ in NAME_NEEDS})
    spots = written(spots, "spots")
    pairs = matched(spots.where("name = 'brace'"), key)
    # the first declaration of each name, the first brace from there on
    named = spots.where("name like 'name:%'").groupBy(key, "name").agg(F.min("start").alias("at"))
    first = named.join(pairs, key).where("open >= at").groupBy(key, "name").agg(F.min(F.struct("open", "close")).alias("b")).where("b.close is not null")
    bodies = first.join(known, key).select(key, "name", F.expr("substring(code, int(b.open) + 1, int(b.close - b.open) + 1)").alias("body"))
    lacks = F.lit(False)
    for n, needs in NAME_NEEDS:
        lacks = F.when(F.col("name") == f"name:{n}", ~F.col("body").rlike(f"(?i){java(needs)}")).otherwise(lacks)
    misnamed = bodies.where(lacks).groupBy(key).agg(F.count(F.lit(1)).alias("misnamed"))
    listed = spots.where("name = 'exports'").select(key, (F.col("end") - 1).alias("open")).join(pairs, [key, "open"]).where("close is not null").join(known, key)
    words = F.explode(F.regexp_extract_all(F.expr("substring(code, int(open) + 2, int(close - open) - 1)"), F.lit(NAME), 0))
    exported = listed.select(key, words.alias("word")).where(~F.col("word").isin(*NO_NAMES)).groupBy(key).agg(F.collect_set("word").alias("exported"))
    defs = F.regexp_extract_all("code", F.lit(java(DECLARED)), 1)
    rows = known.join(misnamed, key, "left").join(exported, key, "left").withColumn("defs", defs)
    missing = F.exists("defs", lambda d: ~d.startswith("_") & d.rlike("^[a-z$]") & ~F.array_contains("exported", d))
    return rows.select(
        key,
        F.coalesce("misnamed", F.lit(0)).cast("long").alias("misnamed"),
        F.coalesce((F.size("defs") > 3) & missing, F.lit(False)).alias("unexported"),
        (F.col("code").rlike(java(THROWN)) & F.col("code").rlike(java(CALLED_BACK))).alias("mixed"),
    )
