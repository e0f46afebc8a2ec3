import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import regex
from quern.operators import assessment as A
from quern.operators import registry as R
from quern.operators import rule_index as I  # noqa: E741
from quern.plans.assessment import SAMPLES
from quern.streaming import stateful as S


def text(spark, t, f):
    return spark.createDataFrame([(t,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_acceptance_of_a_whole_answer_and_of_its_faults(spark):
    whole = SAMPLES[0]
    known = F.array(F.lit("M1"), F.lit("M2"), F.lit("M3"))
    got = text(spark, whole, lambda t: A.acceptance(t, known))
    assert (got["passed"], got["score"], got["most"], got["percent"], got["failed"]) == (True, 11, 11, 100, "")
    failed = lambda t, **more: text(spark, t, lambda c: A.acceptance(c, known, **more))["failed"]
    assert failed(whole.replace("M2、M3", "M9")) == "citations,declaration,citation_ids"
    assert failed(whole.replace("来自", "可能来自")) == "hedge"
    assert failed(whole.replace("缺少客单价", " 无 ")) == "gap,declaration"
    assert failed(whole.replace("无法定量", "无法定量").replace("缺少客单价", "无法定量")) == ""
    assert failed(whole.replace("14天内", "尽快")) == "four_parts"
    assert failed(whole, most_items=1) == "" and failed(whole.replace("【缺口】", "甲 / 2天 / 乙 / 丙\n【缺口】"), most_items=1) == "overload,declaration"
    assert failed(whole.split("[自检A]")[0]) == "declaration"
    assert text(spark, None, A.acceptance)["score"] == 2 and text(spark, "", A.acceptance)["most"] == 10
    assert text(spark, whole, lambda t: A.block(t, "gap")) == "缺少客单价"


def test_numbers_against_materials(spark):
    allowed = A.material_numbers(F.array(F.lit("收入 12.4亿元，占 5%"), F.lit(None).cast("string"), F.lit("1,200万")))
    assert sorted(spark.range(1).select(allowed.alias("x")).first()["x"]) == [5.0, 12.4, 1200.0, 12_000_000.0, 1.24e9]
    check = lambda t: tuple(text(spark, t, lambda c: A.foreign_numbers(c, allowed)))
    assert check("市场规模 12.40亿元") == (True, 1, 0, [])
    assert check("市场规模 13亿元，M3，共 14天") == (False, 0, 2, ["13亿"])
    assert check("据统计 1,200 人，另 7 人") == (True, 1, 1, [])
    assert check("预计 2026年8月") == (False, 0, 1, ["8"]) and check("预计 2026年8月1日")[3] == ["1"]
    assert check("预计 3天") == (True, 0, 1, [])
    assert check(None) == (True, 0, 0, []) and check("") == (True, 0, 0, [])
    assert spark.range(1).select(A.material_numbers(F.expr("cast(array() as array<string>)")).alias("x")).first()["x"] == []


def test_surroundings_of_numbers_against_a_plain_reading(spark):
    rnd = random.Random(7)
    words = ["预计", "大盘", "M", "m", " ", "亿元", "亿", "%", "1", "23", ",456", ".5", "年", "8月", "天", "x", "万亿", "，"]
    allowed = [1.0, 23.0, 0.23, 456.0]
    unit = f"(?:{A.MATERIAL_UNITS})"

    def plain(t):
        matched, skipped, outside = 0, 0, []
        for m in re.finditer(f"({A.NUMBER})(?:[ \t\n\r\f]*({unit}))?", t):
            behind = t[m.start() : m.start() + 40]
            large = any(w in behind for w in A.MAGNITUDES)
            before = t[max(0, m.start() - 10) : m.start()]
            claim = before[-1:] not in ("M", "m") and (large or any(w in before for w in A.CLAIM_WORDS)) and not any(re.search(p, behind[:30], re.A) for p in A.NO_CLAIM)
            v, u = float(m[1].replace(",", "")), (m[2] or "").replace("％", "%")
            held = v in allowed or (u in A.PERCENT_UNITS and v / 100 in allowed) or (large and u == "亿" and v * 1e4 in allowed) or (large and u == "万" and v / 1e4 in allowed)
            if not claim:
                skipped += 1
            elif held:
                matched += 1
            else:
                outside.append(m[1].replace(",", "") + u)
        return not outside, matched, skipped, outside

    texts = ["".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: tuple(r["x"]) for r in df.select("id", A.foreign_numbers(F.col("text"), F.array(*[F.lit(v) for v in allowed])).alias("x")).collect()}
    assert [got[i] for i in range(300)] == [plain(t) for t in texts]


def test_deliverables_and_the_verdict(spark):
    x = text(spark, "a.b a.b axb git diff", lambda t: A.deliverables(t, ("git",), (("diff", "patch"), ("none", "nothing")), {"a.b": 2, "a": 4}))
    assert (x["passed"], x["score"], x["most"], x["percent"], x["missing"]) == (False, 3, 5, 60, ["none|nothing", "ax4"])
    assert tuple(text(spark, "x", A.deliverables)) == (True, 0, 0, 0, [])

    def verdict(t, action):
        none = F.expr("cast(array() as array<double>)")
        return tuple(text(spark, t, lambda c: A.evaluation(A.acceptance(c), A.foreign_numbers(c, none), A.deliverables(c, ("M1",)), F.lit(action))))

    assert verdict(SAMPLES[0], "pass") == ("PASS", "") and verdict(SAMPLES[0], "rewrite") == ("FAIL", "gate")
    assert verdict("市场规模 13亿元", "verify") == ("FAIL", "form,numbers,deliverables")


def test_deliberation(spark):
    ask = lambda t: text(spark, t, A.deliberation)
    assert (ask(None)["depth"], ask(" \n")["fast_exit"], ask("")["composite"]) == (1, False, 0.0)
    hard = ask(SAMPLES[11])
    assert hard["depth"] == 4 and hard["pause"] and not hard["fast_exit"]
    easy = ask("数量是 3")
    assert easy["depth"] == 1 and easy["fast_exit"]
    told = ask(SAMPLES[13])
    assert told["story"] >= A.DEEP_STORY_FROM and not told["fast_exit"]
    assert ask("给我一个答案")["missing"] > ask("给我一个答案。\n好")["missing"]
    deep = lambda d, n, c, k: spark.range(1).select(A.deepened(F.lit(d), F.lit(n), F.lit(c), F.lit(k)).alias("x")).first()["x"]
    assert [deep(1, 6, 0, None), deep(1, 4, 0, ""), deep(1, 0, 3, "x"), deep(1, 0, 0, "judgment"), deep(3, 0, 0, "retrieval"), deep(2, None, None, None)] == [4, 3, 3, 4, 3, 2]


def test_signals(spark):
    read = lambda t: text(spark, t, A.absorbed)
    assert read("  ") is None and read(None) is None
    x = read("一直有预警，终于崩塌；太晚了")
    assert x["lessons"] == ["weak_signal_escalation", "repeated_signal_ignored", "missed_window"]
    assert x["measures"] == ["count_recurrences", "escalate_overdue"] and len(x["parts"]) == 3
    assert tuple(read("天气很好")) == ("dialogue", ["generic"], ["signal-absorber"], ["store_signal"])
    assert read("早期没有后果")["lessons"] == ["generic"]
    assert read("据报道，请说不对")["source"] == "news" and read("请说不对")["source"] == "instruction"


def test_progress(spark):
    def judge(action, claim, evidence, intent):
        row = spark.createDataFrame([(action, claim, evidence, intent)], "a string, c string, e string, i string")
        return row.select(A.progress(*[F.col(c) for c in "acei"]).alias("x")).first()["x"]

    good = judge("优化并记录", "更准确", "测量", None)
    assert good["progress"] and abs(good["confidence"] - (0.85 + 0.7 * 0.15)) < 1e-9 and good["handed_on"]
    assert judge("更强大更快", "", "", "")["pseudo"] == "surface,illusion" and judge("更大", "", "", "")["pseudo"] == "surface"
    assert judge("x", "更好", None, "")["failures"] == "verifiability" and judge("x", "更好", None, "")["pseudo"] == "decoration,illusion"
    assert judge("假装", None, None, None)["failures"] == "truth"
    assert not judge("x", "", "", "都可以")["progress"] and judge(None, None, None, None)["progress"]


def test_plugins_stages_and_engines(spark):
    plugins = R.Plugins({"off": {"enabled": False}, "n": {"config": {"k": 2}}})
    plugins.add("n", lambda c: lambda df: df.where(f"id < {c['k']}"))
    plugins.add("off", lambda c: lambda df: df)
    plugins.add("bad", lambda c: 1 / 0)
    plugins.add("none", lambda c: None)
    loaded, status = plugins.load()
    assert list(loaded) == ["n"] and status["off"] == "disabled" and status["bad"].startswith("failed") and status["none"].startswith("failed")
    stages = R.Stages().add("n", loaded["n"], "shallow").add("broken", lambda df: df.select("no_such_column"), "shallow").add("deep", lambda df: df.limit(0))
    out, status = stages.run(spark.range(5), "shallow")
    assert out.count() == 2 and status["deep"] == "skipped" and status["broken"].startswith("failed") and stages.run(spark.range(5))[0].count() == 0
    e = R.Engines()
    for name, gives in (("a", "xy"), ("b", "yz"), ("c", "xyz"), ("d", "w")):
        e.add(name, [], gives, lambda c, name=name: name)
    assert e.cover("xyz", "abcd") == (["c"], set()) and e.cover("xyz", "abd") == (["a", "b"], set()) and e.cover("xq", "a") == (["a"], {"q"})
    e.add("f", [], "xyzw", lambda c: 1 / 0)
    outputs, errors = e.run(None, "xyzw", "abcdf")
    assert outputs == {"x": "c", "y": "c", "z": "c", "w": "d"} and list(errors) == ["f"]


def test_rules_grow_from_what_is_seen(spark):
    seen = [("hot", "A", i) for i in range(50)] + [("b+", "B", 1), ("b+", "B", 2), ("b+", "B", 4), ("rare", "C", 0), ("rare", "C", 1), (None, "D", 1), (None, "D", 2), (None, "D", 3), ("(a+)+", "E", 0), ("(a+)+", "E", 1), ("(a+)+", "E", 2)]
    df = spark.createDataFrame(seen, "p string, d string, n long").repartition(4)
    rules = R.learned(df, "p", "d", "n")
    assert {tuple(r) for r in rules.collect()} == {("hot", "A", 2), ("b+", "B", 4), ("(a+)+", "E", 2)}
    assert "WindowGroupLimit" in rules._jdf.queryExecution().executedPlan().toString()
    texts = spark.createDataFrame([(1, "BB hot"), (2, "xBx"), (3, "rare aaaa"), (4, None), (5, "")], "k long, t string")
    assert {r["k"]: (r["decision"], r["pattern"]) for r in I.first_match(texts, rules, "k", "t").collect()} == {1: ("A", "hot"), 2: ("B", "b+")}


def test_many_rules_equal_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé日") for _ in range(rnd.randint(1, 5)))
    shapes = ("{a}", "{a}{b}", r"{a}\s+{b}", "({a}|{b})", "{a}.{{0,3}}{b}", "^{a}", "[{a}]x?", "{a}+{b}?", "(?:{a}{b})?", "{a}(?={b})", "({a}", "{a}|", "(?:{a}|{b}x)y*")
    rules = [(rnd.choice(shapes).format(a=word(), b=word()), k % 7, f"d{k}") for k in range(3000)]
    texts = [(k, " ".join(rnd.choice((word(), word().upper())) for _ in range(rnd.randint(0, 8)))) for k in range(60)]
    want = {}
    for k, t in texts:
        for p, at, d in sorted(rules, key=lambda r: (r[1], r[0], r[2])):
            if regex.risky(p) is None and re.search(p, t, re.I | re.A):
                want[k] = (at, p, d)
                break
    df = spark.createDataFrame(rules, "pattern string, learned_at long, decision string")
    got = I.first_match(spark.createDataFrame(texts, "k long, t string"), df, "k", "t").collect()
    assert {r["k"]: (r["learned_at"], r["pattern"], r["decision"]) for r in got} == want


def test_fifty_thousand_rules_without_collecting_them(spark):
    rules = spark.range(50_000).selectExpr("concat('rule', lpad(id, 5, '0'), '[a-z]+') pattern", "id learned_at", "'d' decision")
    texts = spark.range(300).selectExpr("id k", "concat('x RULE', lpad(id * 150, 5, '0'), 'ab rule', lpad(id * 160, 5, '0'), 'c') t")
    found = I.first_match(texts, rules, "k", "t")
    assert {r["k"]: r["learned_at"] for r in found.collect()} == {k: k * 150 for k in range(300)}
    assert "rule00001" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [("abc.def?g", ["abc"]), ("(?i)AB(cd)+e", ["abcd"]), ("(always|never)x", ["always", "never"]), ("a|", []), ("[ab]c*", []), (r"\bfoo\b", ["foo"]), ("(?:ab){2,}c", ["ab"]), ("x(?!yz)w", ["xw"])],
)
def test_required_literals(pattern, literals):
    assert regex.required_literals(pattern) == literals


def test_prevention_rules(spark):
    errors = spark.createDataFrame([("binary", 1)] * 3 + [("omission", 2), ("unknown", 1), (None, 1)], "kind string, again int")
    assert {(r["category"], r["n"]) for r in R.prevention_rules(errors, "kind").collect()} == {("binary", 3)}
    again = errors.union(spark.createDataFrame([("unknown", 3)], errors.schema))
    got = R.prevention_rules(again, "kind", "again").collect()
    assert {(r["category"], r["n"]) for r in got} == {("binary", 3), ("omission", 1)}
    assert next(r for r in got if r["category"] == "binary")["triggers"] == ["不是", "就是", "要么", "唯一选择"]
    assert R.prevention_rules(errors.limit(0), "kind", "again").count() == 0


def _stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_last_values_of_a_stream(spark, tmp_path):
    rows = [[("a", i, float(i)) for i in range(4)], [("a", i, float(i)) for i in range(4, 7)] + [("b", 1, 9.0)]]
    stream = _stream(spark, tmp_path, rows, "e string, n long, v double")
    q = S.last_values(stream, "e", "n", "v", 3).writeStream.outputMode("update").format("memory").queryName("lasts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = [tuple(r) for r in spark.table("lasts").collect()]
    assert ("b", [9.0]) in got and all(len(v) <= 3 for _, v in got) and {x for e, v in got if e == "a" for x in v} <= {float(i) for i in range(7)}


def test_deduplicated_stream(spark, tmp_path):
    rows = [[("k", 0), ("k", 5), ("m", 9)], [("k", 20), ("n", 30)]]
    stream = _stream(spark, tmp_path, rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    q = S.deduplicated(stream, "k", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r["k"] for r in spark.table("once").collect()) == ["k", "m", "n"]


def test_dead_letters(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("{broken",), ("",), (None,), ('{"a": null}',)], "value string")
    got = [(r["row"] and r["row"]["a"], r["dead"]) for r in S.with_dead_letters(lines, "a int").collect()]
    assert got == [(1, None), (None, "{broken"), (None, ""), (None, None), (None, None)]
