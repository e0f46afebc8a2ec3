import zlib

from pyspark.sql import functions as F

from quern.llm import language_id as L
from quern.llm.common import table
from tests.conftest import SF2
from tests.llm.helpers import docs, empty, odd


def test_held_out_accuracy_and_split(spark):
    docs(spark, [(1, "a")])
    d = table(spark, SF2, "documents")
    got = L.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == d.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_uses_the_text_alone(spark):
    d = table(spark, SF2, "documents").limit(300)
    model = L.learn(table(spark, SF2, "documents"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(d, model).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(d.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model).collect()}
    assert a == b


def test_pieces_do_not_change_the_counts(monkeypatch):
    text = "Le chat et la souris — 日本 " * 200
    whole = L.grams(text)
    monkeypatch.setattr(L, "PIECE", 97)
    assert abs(L.grams(text) - whole).max() < 1e-12


def test_odd_input(spark):
    rows = {(r["doc_id"], r["lang_pred"]) for r in L.identify(odd(spark)).collect()}
    by = dict(rows)
    assert by[1] == by[2] == by[3] == L.UNKNOWN
    assert by[7] != L.UNKNOWN
    assert L.identify(empty(spark)).count() == 0
    unlabelled = docs(spark, [(1, "some words", None), (2, None, "en")])
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {L.UNKNOWN}
    alone = docs(spark, [(i, "some words here", "en") for i in range(20)])
    assert {r["lang_pred"] for r in L.identify(alone).collect()} == {"en"}
