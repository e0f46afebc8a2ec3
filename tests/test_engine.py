import datetime as dt
import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import graph as G
from quern.operators import logs as L
from quern.operators import memory as M
from quern.sources import json_logs, wal
from quern.streaming import stateful
from tests.conftest import SF

ROOT = Path(__file__).resolve().parent.parent


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_entry_has_the_flagship_query(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["lang", "action", "n"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("quern", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "quern").mkdir()
    for p in (ROOT / "quern").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "quern" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "quern").parts:
            assert "quern.llm" not in p.read_text(), p


def test_scalars(spark):
    assert one(spark, S.quantize4(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.2), F.lit(-1.0)))) == [0, 8, 15, 0]
    assert one(spark, S.sentences(F.lit("A b. C!  D?? 好。坏"))) == ["A b.", "C!", "D??", "好。", "坏"]
    assert one(spark, S.boundary_split(F.lit("中文abc中"))) == ["中文", "abc", "中"]
    assert one(spark, S.char_tokens(F.lit("中文 abc1"))) == ["中", "文", "abc1"]
    assert one(spark, S.char_ngrams(F.lit("abcd"), 2)) == ["ab", "bc", "cd"]
    assert one(spark, S.numbers_with_units(F.lit("5% 3万 2亿 7"))) == [0.05, 30000.0, 2e8, 7.0]
    assert [one(spark, S.blocked_ip(F.lit(x))) for x in ("10.0.0.1", "8.8.8.8", "300.1.1.1", "x")] == [True, False, True, True]
    assert one(spark, S.normalise_unicode(F.lit("Ｆｕｌｌ​ “q” "))) == 'Full "q"'
    assert one(spark, S.dictionary_tokens(["研究", "研究生", "生命"])(F.lit("研究生命 x"))) == ["研究生", "命", "x"]
    assert one(spark, wal.hmac_sha256("k", F.lit("m"))) == __import__("hmac").new(b"k", b"m", "sha256").hexdigest()
    assert one(spark, L.js_round(F.lit(-0.5))) == 0 and one(spark, L.js_round(F.lit(2.5))) == 3


def test_memory_edges(spark):
    row = one(spark, F.struct(*[M.falsy_default(F.lit(v).cast("double"), 0.5).alias(f"c{i}") for i, v in enumerate((None, 0.0, 0.2))]))
    assert tuple(row) == (0.5, 0.5, 0.2)
    assert one(spark, M.expired(F.lit(None).cast("long"), 5)) is False and one(spark, M.expired(F.lit(5), 5)) is True
    step = one(spark, M.sm2_step(F.lit(2.5), F.lit(1), F.lit(1), F.lit(5)))
    assert (step["repetitions"], step["interval"]) == (2, 6)
    assert one(spark, M.char_bigrams(F.lit("a b"))) == ["ab"] and one(spark, M.char_bigrams(F.lit("a"))) == []


def test_graph_edges(spark):
    rows = [(1, "A", "p", "B", 0.4), (2, "a", "P", "b", 1.7), (3, "B", "p", "C", 0.6), (4, "C", "p", "A", 0.5), (5, "C", "p", "D", 0.9), (6, "D", "p", "D", 1.0)]
    e = spark.createDataFrame(rows, "seq long, subject string, predicate string, object string, confidence double")
    first = {r["key"]: r for r in G.upsert(e).collect()}["a|p|b"]
    assert (first["subject"], first["confidence"], first["writes"]) == ("A", 1.0, 2)
    assert G.search(e, subject="a", exact=True).count() == 1 and G.search(e, subject="a").count() == 2
    p = G.paths(e, "A", "D").first()
    assert p["nodes"] == ["A", "B", "C", "D"] and p["length"] == 3
    assert G.paths(e, "A", "D", depth=2).count() == 0 and G.paths(e, "A", "Z").count() == 0
    near = {r["entity"]: r["distance"] for r in G.neighbourhood(e, spark.createDataFrame([("A",)], "entity string"), 2).collect()}
    assert near == {"A": 0, "B": 1, "C": 1, "D": 2}
    assert G.related(e, "C").count() == 3


def test_similar_pairs_against_all_pairs(spark):
    import random

    rnd = random.Random(9)
    rows = [(i, [f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.randrange(1, 14))]) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    for least in (0.3, 0.5):
        got = {(r["a"], r["b"]) for r in G.similar_pairs(df, "k", F.col("t"), least, 1000).collect()}
        want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert got == want


def test_seed_clusters_follow_insertion_order(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["a", "b", "c"]), ("g", 3, ["b", "c", "d"]), ("g", 4, ["z"])], "g string, k long, t array<string>")
    assert {r["k"]: r["cluster"] for r in G.seed_clusters(df, "g", "k", "t", 0.4).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_logs_edges(spark):
    rows = [("u", i, float(i % 3 == 0)) for i in range(12)]
    df = spark.createDataFrame(rows, "u string, seq long, v double")
    s = {r["seq"]: (r["ratio"], r["sustained"]) for r in L.sustained(df, "u", ["seq"], F.col("v") > 0).collect()}
    assert s[8][1] is False and s[9] == (0.4, False)
    assert L.trailing_streak(df, "u", ["seq"], F.col("v") == 0).first()["streak"] == 2
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m // 10, m % 10), m % 2 == 0) for m in range(20)] + [(dt.datetime(2024, 1, 1, 0, 5, 1), False)], "ts timestamp, ok boolean")
    states = [r["state"] for r in L.circuit_windows(t, "ts", F.col("ok")).orderBy("window_start").collect()]
    assert states == ["OPEN", "OPEN", "CLOSED"]
    gate = L.cooldown_gate(spark.createDataFrame([("u", float(x)) for x in (0, 100, 900, 1000, 1800)], "u string, s double"), "u", F.col("s")).collect()
    assert sorted(r["second"] for r in gate) == [0.0, 900.0, 1800.0]


def test_wal_and_chains(spark):
    rows = [(1, "write", "a"), (2, "commit", ""), (3, "write", "b"), (4, "write", "c"), (5, "delete", "d")]
    w = spark.createDataFrame(rows, "seq long, type string, data string").withColumn("hash", wal.entry_hash("seq", "type", "data"))
    bad = w.withColumn("hash", F.when(F.col("seq") == 4, "0").otherwise(F.col("hash")))
    assert [r["seq"] for r in wal.replay(bad, ("seq", "type", "data")).collect()] == [3]
    c = spark.createDataFrame([("c", 1, "h1", None), ("c", 2, "h2", "h1"), ("c", 3, "h3", "zz"), ("d", 1, "k1", None)], "chain string, seq long, hash string, prev_hash string")
    assert {r["chain"]: r["first_break"] for r in wal.chain_verdict(c, "chain").collect()} == {"c": 3, "d": None}


def test_snapshots(spark):
    items = spark.createDataFrame([("e", 1, "a", "1"), ("e", 1, "b", "1"), ("e", 5, "a", "2"), ("e", 5, "c", "1")], "entity string, day long, key string, value string")
    got = {(r["key"], r["change"]) for r in wal.consecutive_diffs(items, "entity", "day").collect()}
    assert got == {("a", "changed"), ("b", "removed"), ("c", "added")}
    s = spark.createDataFrame([("l", i, i == 1) for i in range(6)], "label string, no long, is_rollback boolean")
    assert {r["no"] for r in wal.retained(s, "label", "no", 2).collect()} == {5, 4, 1}


def test_json_sources(spark, tmp_path):
    f = tmp_path / "log.jsonl"
    f.write_text('{"a": 1, "ts": "2024-01-01"}\nnot json\n\n{"a": 2, "ts": "2024-01-02"}\n{"a": \n')
    rows, dead = json_logs.read_jsonl(spark, str(f), "a long, ts string")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and dead.count() == 2
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({"a": 7}, indent=1))
    assert json_logs.read_document(spark, str(doc), "a long").first()["a"] == 7
    assert json_logs.read_document(spark, str(tmp_path / "none.json"), "a long").count() == 0
    logs = spark.createDataFrame([("x", dt.datetime(2024, 1, d), d) for d in (1, 2, 300 % 28 + 1)], "category string, ts timestamp, v long")
    out = str(tmp_path / "daily")
    json_logs.append_daily(logs, out)
    json_logs.append_daily(logs.limit(1), out)
    schema = "category string, day string, ts timestamp, v long"
    assert json_logs.scan_days(spark, out, schema, "x", "2024-01-01", "2024-01-02").count() == 3
    kept = json_logs.rotate(spark, out, str(tmp_path / "old"), schema, "2024-07-01", 181)
    assert kept.count() == 2 and spark.read.schema(schema).json(str(tmp_path / "old")).count() == 2
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("y")
    assert json_logs.scan_files(spark, str(tmp_path / "src"), "*.py").count() == 1


def test_streams_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    src = str(tmp_path / "in")
    e.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stateful.breaker(stream, "ts", F.col("event_type") != "error", 3600, "40 days").writeStream.outputMode("complete").format("memory").queryName("breaker").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = {tuple(r) for r in L.circuit_windows(e, "ts", F.col("event_type") != "error", 3600).collect()}
    assert {tuple(r) for r in spark.table("breaker").collect()} == batch

    q = stateful.running_ema(spark.readStream.schema(e.schema).parquet(src), "user_id", "event_id", "value").writeStream.outputMode("update").format("memory").queryName("ema").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    last = {r["user_id"]: r["ema"] for r in spark.table("ema").groupBy("user_id").agg(F.max_by("ema", "n").alias("ema")).collect()}
    want = {r["user_id"]: r["ema"] for r in L.ema(e, "user_id", ["event_id"], "value").collect()}
    assert last == pytest.approx(want)


def test_periodic_consolidates_what_small_batches_add_up_to(spark, tmp_path):
    source, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []

    def consolidate(rows, number):
        seen.append(sorted(r["id"] for r in rows.collect()))

    def feed(first, last):
        spark.range(first, last).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        query = stateful.periodic(stream, consolidate, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None

    feed(0, 15)
    assert seen == []
    feed(15, 30)
    assert seen == [list(range(30))]
    feed(30, 45)
    feed(45, 49)
    assert len(seen) == 1
    feed(49, 51)
    assert seen[1:] == [list(range(30, 51))]


def test_seed_clusters_against_all_pairs_in_order(spark):
    rnd = random.Random(8)
    rows = [(g, i, [rnd.choice("abcdefgh") for _ in range(rnd.randrange(6))]) for g in ("x", "y") for i in range(60)]
    want = {}
    for g in ("x", "y"):
        own = [(i, set(w)) for h, i, w in rows if h == g]
        for at, (i, w) in enumerate(own):
            if (g, i) in want:
                continue
            want[g, i] = i
            for j, v in own[at + 1 :]:
                if (g, j) not in want and w | v and len(w & v) / len(w | v) > 0.3:
                    want[g, j] = i
    df = spark.createDataFrame(rows, "g string, k long, w array<string>")
    assert {(r["g"], r["k"]): r["cluster"] for r in G.seed_clusters(df, "g", "k", "w", 0.3).collect()} == want


def test_seed_clusters_of_a_chain_take_rounds(spark):
    df = spark.createDataFrame([("g", k, [f"t{k}", f"t{k + 1}"]) for k in range(9)] + [("h", 1, []), ("h", 2, None), (None, 3, ["a"]), (None, 4, ["a"])], "g string, k long, w array<string>")
    got = {(r["g"], r["k"]): r["cluster"] for r in G.seed_clusters(df, "g", "k", "w", 0.3).collect()}
    assert got == {("g", k): k - k % 2 for k in range(9)} | {("h", 1): 1, ("h", 2): 2, (None, 3): 3, (None, 4): 3}


def test_search_of_a_long_chain_keeps_its_plan(spark):
    e = spark.createDataFrame([(f"n{k:02}", "r", f"n{k + 1:02}", 0.5) for k in range(25)] + [("n00", "r", "n02", 0.1)], "subject string, predicate string, object string, confidence double")
    near = G.neighbourhood(e, spark.createDataFrame([("n00",)], "entity string"), 20)
    assert {r["entity"]: r["distance"] for r in near.collect()} == {f"n{k:02}": max(0, k - 1) if k > 1 else k for k in range(22)}
    assert str(near._jdf.queryExecution().optimizedPlan()).count("Relation") <= 1
    assert G.paths(e, "n00", "n20", depth=19).first()["length"] == 19 and G.paths(e, "n00", "n21", depth=19).count() == 0


def test_one_hot_entity_in_folds_and_cooldowns(spark):
    rnd = random.Random(9)
    times, at = [], 0
    for _ in range(3000):
        at += rnd.choice((0, 1, 5, 100, 899, 900, 4000))
        times.append(at)
    rows = [("hot", k, float(t), rnd.random()) for k, t in enumerate(times)] + [("cold", 0, 5.0, 0.25), (None, 0, 1.0, 0.5), (None, 1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "u string, n long, s double, v double").repartition(3)
    last, passed = None, []
    for t in times:
        if last is None or t - last >= 900:
            last = t
            passed.append(float(t))
    gate = L.cooldown_gate(df, "u", F.col("s"))
    assert sorted(r["second"] for r in gate.where("u = 'hot'").collect()) == passed
    assert {(r["u"], r["second"]) for r in gate.where("u is null or u = 'cold'").collect()} == {("cold", 5.0), (None, 1.0)}
    e, q = None, 0.0
    for *_, v in rows[:3000]:
        e = v if e is None else 0.1 * v + 0.9 * e
        q = q + 0.1 * (v + 0.9 * q - q)
    folded = L.ema(df, "u", ["n"], "v")
    assert abs(folded.where("u = 'hot'").first()["ema"] - e) < 1e-12 and abs(folded.where("u is null").first()["ema"] - 0.55) < 1e-12
    assert abs(L.q_value(df, "u", ["n"], "v").where("u = 'hot'").first()["q"] - q) < 1e-10
    assert "collect" not in str(folded._jdf.queryExecution().optimizedPlan())
    assert {r["u"]: len(r["values"]) for r in L.last_values(df, "u", ["n"], "v", 3).collect()} == {"hot": 3, "cold": 1, None: 2}
    assert L.last_values(df, "u", ["n"], "v", 3).where("u = 'hot'").first()["values"] == [r[3] for r in rows[2997:3000]]


def test_paths_between_tables_of_names(spark):
    e = spark.createDataFrame([("A", "r", "B", 0.5), ("B", "r", "C", 1.0), ("C", "r", "D", 0.2)], "subject string, predicate string, object string, confidence double")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert G.paths(e, names("A"), names("C")).first()["nodes"] == ["A", "B", "C"]
    assert G.related(e, names("B")).count() == 2 and G.related(e, names()).count() == 0


def test_pairs_of_concepts_keep_their_order(spark):
    df = spark.createDataFrame([(1, ["c", "a", "a"]), (2, ["x"]), (3, []), (4, None)], "id long, w array<string>")
    assert sorted(map(tuple, G.concept_pairs(df, "id", "w").collect())) == [(1, "a", "a"), (1, "c", "a"), (1, "c", "a")]
