import random
import re

from pyspark.sql import functions as F

from quern import plans
from quern.operators import dialogue as D
from quern.operators import graph as G
from quern.operators import judgement as J
from quern.operators import logs as L
from quern.operators import memory as M
from quern.plans.tables import settled, spread, table
from tests.conftest import SF


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def text(spark, t, f):
    return spark.createDataFrame([(t,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_rewriting_takes_each_finding_once_and_in_order(spark):
    names = F.array(F.lit("vagueness"), F.lit("gaslighting"), F.lit("vagueness"), F.lit("no_such_finding"))
    assert text(spark, "据了解，，有关部门说你记错了。。", lambda t: J.rewrite(t, names)) == "根据现有信息，相关管理部门说我记得不太一样。"
    assert text(spark, "如果你不同意就说明你自私", lambda t: J.rewrite(t, F.array(F.lit("emotional_manipulation")))) == "我不同意的原因是同意不成立，不代表我自私"
    assert text(spark, "我完全同意方案，但是不行", lambda t: J.rewrite(t, F.array(F.lit("contradiction")))) == "我理解方案，但是不行"
    assert text(spark, "有关部门", lambda t: J.rewrite(t, F.array(F.lit("sycophancy")))) == "有关部门"


def test_misuse_counts_errors_only_without_context(spark):
    def count(t):
        return text(spark, t, lambda c: F.struct(*[v.alias(k) for k, v in J.misuse(c).items()])).asDict()

    assert count("it is broken")["bare_error"] == 1
    assert count("it is broken when I start it")["bare_error"] == 0
    assert count("it is broken " + "x" * 95 + " when")["bare_error"] == 1
    assert count("when " + "y" * 120 + " broken and " + "z" * 120 + " broken")["bare_error"] == 2
    assert count("retry, try again")["repeated_fixes"] == 0 and count("retry, try again, fix it")["repeated_fixes"] == 1


def test_unresolved_conflicts(spark):
    score = lambda t: text(spark, t, J.UNRESOLVED_CONFLICT.score)
    assert score("I noticed a contradiction, but I am certain this is the correct answer.") == J.CONFLICT_SCORE
    assert score("I noticed a contradiction.") == 0
    assert score("I am certain this is the correct answer.") == 0
    assert score("I noticed a contradiction, case closed; but we need more evidence.") == 0
    assert score("发现数据矛盾，尘埃落定。") == J.CONFLICT_SCORE


def test_tone_needs_and_empathy(spark):
    x = text(spark, "急！！！快点，气死我了", J.tone)
    assert (x["urgency"], x["emotion"]) == ("high", "angry") and 0 <= x["intensity"] <= 1
    assert text(spark, "  ", J.tone)["intensity"] == 0 and text(spark, None, J.tone)["urgency"] == "low"
    needs = text(spark, "比如这个，好累", lambda t: J.implicit_needs(t, F.lit("sad")))
    assert [(n["need"], n["confidence"]) for n in needs] == [("need_example", 0.85), ("need_emotional_support", 0.85), ("need_clarification", 0.75)]
    assert text(spark, "", J.empathy)["level"] == "none"
    assert text(spark, "你觉得难过，我觉得担心你，但是我理解你可能会好", J.empathy)["level"] in ("moderate", "high")


def test_reactions(spark):
    def predict(t, style, sensitivity=1, pleasure=0):
        return text(spark, t, lambda c: J.reaction(c, F.lit(style), F.lit(sensitivity), F.lit(pleasure)))["predicted"]

    assert predict("but you are great", "direct") == "defensive"
    assert predict("maybe, perhaps, but", "direct") == "confused"
    assert predict("great support", "empathetic") == "positive"
    assert predict("however", "plain", pleasure=-5) == "negative"
    assert predict("hello", "plain") == "neutral"


def test_preferences(spark):
    rows = [("a", 1, "简洁"), ("a", 2, "详细"), ("a", 3, "formal 中文"), ("b", 4, "casual"), ("a", 5, "英文")]
    p = spark.createDataFrame(rows, "owner string, k long, content string")
    assert {(r["earlier"], r["later"]) for r in D.excluding_pairs(p, "owner", "k", "content").collect()} == {(1, 2), (3, 5)}
    assert not one(spark, D.preference_applies(F.lit("always"), F.lit("never say no"), F.lit("x")))
    assert one(spark, D.preference_applies(F.lit("contextual"), F.lit("jazz music"), F.lit("我 like music")))


def test_json_values(spark):
    same = lambda a, b: one(spark, J.same_json(F.lit(a), F.lit(b)))
    assert same('{"a": 1, "b": [1, {"c": null}]}', '{"b":[1,{"c":null}],"a":1}')
    assert not same('{"a": 1}', '{"a": 1, "b": null}') and not same("[1, 2]", "[2, 1]") and not same("{", "{")


def test_graph_is_saved_and_loaded_with_one_edge_a_key(spark, tmp_path):
    rows = [(1, "A", "is", "b", 0.4), (2, "a", "IS", "b", 1.7), (3, "c", "is", "d", -1.0), (4, "", "is", "x", 0.5), (5, "e", None, "f", 0.5)]
    G.save_triples(spark.createDataFrame(rows, "seq long, subject string, predicate string, object string, confidence double"), str(tmp_path / "g"))
    got = {(r["subject"].lower(), r["confidence"]) for r in G.load_triples(spark, str(tmp_path / "g")).collect()}
    assert got == {("a", 1.0), ("c", 0.0)}


def test_running_average_of_a_long_series(spark):
    rnd = random.Random(4)
    rows = [(u, i, rnd.random()) for u, n in (("x", 1000), ("y", 66), ("z", 67), ("w", 1)) for i in range(n)]
    for alpha in (0.1, 0.5, 0.013):
        want, last = {}, {}
        for u, i, v in rows:
            last[u] = v if u not in last else alpha * v + (1 - alpha) * last[u]
            want[u, i] = last[u]
        got = L.ema_series(spark.createDataFrame(rows, "u string, i long, v double"), "u", ["i"], "v", alpha).collect()
        assert len(got) == len(rows) and all(abs(r["ema"] - want[r["u"], r["i"]]) < 1e-12 for r in got)


def test_rank_in_buckets_equals_a_plain_rank(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([0.0, 0.25, 1.0, rnd.random(), 1.5, -1.0])) for i in range(500)]
    got = {r["id"]: r["rank"] for r in M.bucketed_rank(spark.createDataFrame(rows, "id long, g string, s double"), ["g"], "s", [F.desc("id")]).collect()}
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], -r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_recurrences_across_stretches(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("ab"), 1_700_000_000 + rnd.randrange(20_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["recurrences"] for r in L.recurrence(df, "c", "ts").collect()}
    assert got == {i: sum(d == c and s - 3600 <= t < s for _, d, t in rows) for i, c, s in rows}


def test_rules_run_once_and_on_dealt_rows(spark):
    for name in ("detectors_1", "detectors_2", "pii_counts", "injection_flags", "portable_findings", "assistant_misuse"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Filter.*(RLIKE|regexp_count)", plan), name
        assert "Repartition" in plan.split("Filter")[-1] or "Repartition" in plan, name


def test_settled_keeps_rows_and_values(spark):
    d = table(spark, SF, "documents").select("doc_id", F.length("text").alias("n"))
    assert sorted(map(tuple, settled(d).collect())) == sorted(map(tuple, d.collect()))
    assert spread(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
