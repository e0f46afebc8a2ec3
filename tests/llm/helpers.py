"""Small tables and odd inputs for the operators of quern.llm."""

from __future__ import annotations

from quern.llm.common import ship

LONG = ("alpha beta gamma delta " * 5000).strip()

#: Extra columns whose names clash with columns that operators make.
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, label string, bucket long, keep boolean"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    ship(spark)
    full = []
    for r in rows:
        r = tuple(r) + (None,) * (4 - len(r))
        full.append((*r, None if r[1] is None else len(r[1]), 0.5, 7, "x", 1, True))
    return spark.createDataFrame(full, DOC)


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    return docs(
        spark,
        [
            (1, None, None, None),
            (2, "", "en", "a"),
            (3, " \n\t ", "en", "a"),
            (4, LONG, "en", None),
            (5, "one", None, "b"),
            (6, "x" * 3000, "fr", "b"),
            (7, "the cat and the dog sat on the mat", "en", "a"),
            (7, "the cat and the dog sat on the mat", "en", "a"),
            (None, "the cat and the dog sat on the mat", "en", "a"),
            (8, "日本語 テキスト 😀 ümlaut", "ja", "c"),
        ],
    )


def empty(spark):
    return docs(spark, [(1, "a", "en", "a")]).limit(0)
