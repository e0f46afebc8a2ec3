"""Rewrites of files: repeated, interrupted, and beside rows that come later."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import breaker as B
from quern.sources import json_logs as J
from quern.streaming import stateful as S

SCHEMA = "id long, kind string"


def stored(spark, path, kinds=("a", "b", "c d"), n=30):
    rows = spark.createDataFrame([(k, kinds[k % len(kinds)]) for k in range(n)], SCHEMA)
    rows.repartition(3).write.partitionBy("kind").json(path)


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.schema(SCHEMA).json(path).collect())


def test_erasure_rewrites_only_files_that_hold_its_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    stored(spark, path)
    before = {f for f in Path(path).rglob("part-*")}
    counts = J.erase(spark, path, SCHEMA, ["kind"], F.col("id").isin(2, 5, None)).first()
    assert (counts["erased"], counts["kept"]) == (2, 28) and ids(spark, path) == [k for k in range(30) if k not in (2, 5)]
    after = {f for f in Path(path).rglob("part-*")}
    assert {f.parent.name for f in before - after} == {f.parent.name for f in after - before} == {"kind=c d"} or len(before - after) <= 2
    assert J.erase(spark, path, SCHEMA, ["kind"], F.col("kind") == "a").first()["erased"] == 10
    assert J.erase(spark, path, SCHEMA, ["kind"], F.lit(None).cast("boolean")).first()["erased"] == 0
    assert ids(spark, path) == [k for k in range(30) if k % 3 and k not in (2, 5)] and not (tmp_path / "m" / "_erase").exists()


@pytest.mark.parametrize("point", ["before the list", "while deleting", "while moving"])
def test_an_erasure_that_fails_is_carried_through(spark, tmp_path, monkeypatch, point):
    path = str(tmp_path / "m")
    stored(spark, path)
    finish, delete = J._finish_erasures, J._delete_files
    if point == "before the list":
        calls = []
        monkeypatch.setattr(J, "_finish_erasures", lambda *a: calls.append(1) or (finish(*a) if len(calls) == 1 else 1 / 0))
    else:
        def some(spark, files):
            first = files.limit(1) if point == "while deleting" else files
            delete(spark, first)
            raise OSError("lost")

        monkeypatch.setattr(J, "_delete_files", some)
    with pytest.raises((OSError, ZeroDivisionError)):
        J.erase(spark, path, SCHEMA, ["kind"], F.col("id") < 12)
    monkeypatch.undo()
    if point == "before the list":
        (next((tmp_path / "m" / "_erase").glob("*/files/_SUCCESS"))).unlink()
    J.erase(spark, path, SCHEMA, ["kind"], F.col("id") < 12)
    assert ids(spark, path) == list(range(12, 30))


def test_archive_keeps_late_rows_and_repeats(spark, tmp_path):
    live, old = str(tmp_path / "live"), str(tmp_path / "old")

    def append(first):
        rows = spark.createDataFrame([(first + k, f"2024-01-{1 + k:02}") for k in range(6)], "id long, day string").withColumn("ts", F.to_timestamp("day"))
        J.append_daily(rows.withColumn("category", F.lit("x")).select("id", "ts", "category"), live)

    seen = lambda where: sorted(r["id"] for r in spark.read.schema("id long, category string, day string").json(where).collect())
    append(0)
    for _ in range(2):
        J.archive(spark, live, old, "id long, ts timestamp", "2024-01-14", 10)
    assert seen(old) == [0, 1, 2] and seen(live) == [3, 4, 5]
    append(10)
    J.archive(spark, live, old, "id long, ts timestamp", "2024-01-14", 10)
    assert seen(old) == [0, 1, 2, 10, 11, 12] and seen(live) == [3, 4, 5, 13, 14, 15]


def plain_breaker(rows, window, cooldown, least, critical):
    out, by = {}, {}
    for e, s, ok, load in rows:
        if e is not None and s is not None:
            by.setdefault(e, {}).setdefault(s, []).append((ok, load))
    for e, instants in by.items():
        start, total, bad, tripped = None, 0, 0, None
        for s in sorted(instants):
            if start is None or s - start > window * 10**6:
                start, total, bad = s, 0, 0
            total += len(instants[s])
            bad += sum(not ok for ok, _ in instants[s])
            hot = max((x for _, x in instants[s] if x is not None), default=0) >= critical
            if tripped is not None:
                if s - tripped >= cooldown * 10**6:
                    tripped, total, bad = (s, total, bad) if hot else (None, 0, 0)
            elif hot:
                tripped = s
            rate = bad / total if total >= least else 0
            out[e, s] = "TRIPPED" if tripped is not None else "OPEN" if rate >= 0.5 else "HALF_OPEN" if rate >= 0.3 else "CLOSED"
    return out


def test_breaker_in_batch_and_stream_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(900):
        at += rng.choice((0, 10**5, 10**6, 20 * 10**6, 60 * 10**6, 61 * 10**6))
        rows.append((rng.choice("xxxxy"), at, rng.random() > 0.4, rng.choice((None, 1.0, 50.0, 99.0)) if rng.random() < 0.2 else 10.0))
    rows += [(None, 1, True, 1.0), ("z", None, True, 1.0), ("z", 5, None, None)]
    want = plain_breaker(rows, 60, 60, 3, 95)
    df = spark.createDataFrame(rows, "e string, s long, ok boolean, load double")
    got = B.breaker_states(df, "e", F.col("s"), F.col("ok"), F.col("load"), least=3)
    assert {(r["e"], r["s"]): r["state"] for r in got.collect()} == want
    assert set(want.values()) == {"TRIPPED", "OPEN", "HALF_OPEN", "CLOSED"}
    known = df.where("e is not null and s is not null")
    stream = S.drained(S.breaker_states(S.replayed(known, "s"), "e", "s", "ok", "load", least=3))
    assert {(r["e"], r["s"]): r["state"] for r in stream.collect()} == want and stream.select("batch").distinct().count() > 1
