import pytest
from pyspark.sql import functions as F

from quern.functions.regex import java, portable, risky
from quern.operators import gates, positions as P, text_rules as T
from quern.operators.detectors import ARGUMENT_DETECTORS
from quern.operators.rules import AtLeast, Contains, Detector, Match, Not, Some, detect
from quern.plans.rules import RULE_TEXTS

# (text, the detectors that hit)
CASES = [
    (RULE_TEXTS[0], {"appeal_to_majority"}),
    (RULE_TEXTS[1], set()),
    (RULE_TEXTS[2], {"appeal_to_majority"}),
    (RULE_TEXTS[3], {"appeal_to_probability"}),
    (RULE_TEXTS[4], set()),
    (RULE_TEXTS[6], {"appeal_to_ridicule"}),
    (RULE_TEXTS[7], set()),
    (RULE_TEXTS[9], {"complexity_shield"}),
    (RULE_TEXTS[10], set()),
    (RULE_TEXTS[12], {"concern_trolling"}),
    (RULE_TEXTS[13], set()),
    (RULE_TEXTS[15], {"concession_coercion"}),
    (RULE_TEXTS[16], set()),
    (RULE_TEXTS[18], {"darvo"}),
    (RULE_TEXTS[19], set()),
    (RULE_TEXTS[21], {"false_balance"}),
    (RULE_TEXTS[23], set()),
    (RULE_TEXTS[25], {"guilt_by_association"}),
    (RULE_TEXTS[26], set()),
    (RULE_TEXTS[28], {"kafkatrapping"}),
    (RULE_TEXTS[29], set()),
    (RULE_TEXTS[31], {"manufactured_consent"}),
    (RULE_TEXTS[32], set()),
    (RULE_TEXTS[34], {"mind_reading"}),
    (RULE_TEXTS[35], set()),
    (RULE_TEXTS[39], {"synthetic_social_proof"}),
    (RULE_TEXTS[41], {"tool_deflection"}),
    (RULE_TEXTS[42], set()),
    (RULE_TEXTS[44], {"standard_shift"}),
    (RULE_TEXTS[45], set()),
    (RULE_TEXTS[46], {"wishful_thinking"}),
    (RULE_TEXTS[47], set()),
    (RULE_TEXTS[49], {"one_sided_dismissal"}),
    (RULE_TEXTS[50], set()),
    (RULE_TEXTS[52], {"conditional_proposition"}),
    (RULE_TEXTS[53], set()),
    ("clean text", set()),
    ("", set()),
    (None, set()),
]


@pytest.fixture(scope="module")
def hits(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i long, text string")
    out = detect(rows, ARGUMENT_DETECTORS)
    return {r["i"]: {d.name for d in ARGUMENT_DETECTORS if r[f"{d.name}_score"] > 0} for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_hits_and_exemptions(hits, i):
    text, want = CASES[i]
    assert want <= hits[i], text
    if not want:
        assert not hits[i], text


def test_a_leg_less_is_no_hit(spark):
    """Mutation: without one family of a conjunction the hit is gone."""
    text = F.lit("alpha and beta here")
    whole = Detector("x", ((Match("alpha") & Match("beta"), 0.5),))
    broken = Detector("x", ((Match("alpha") & Match("gamma"), 0.5),))
    exempt = Detector("x", ((Match("alpha") & Match("beta"), 0.5),), (Match("here"),))
    short = Detector("x", ((Match("alpha"), 0.5),), least_chars=50)
    row = spark.range(1).select(*[d.score(text).alias(n) for n, d in (("a", whole), ("b", broken), ("c", exempt), ("d", short))]).first()
    assert tuple(row) == (0.5, 0.0, 0.0, 0.0)


def test_expressions(spark):
    text = F.lit("One two THREE a.b")
    exprs = [Some(Contains("a.b"), Contains("zz")), Some(Contains("axb"), Contains("q")), Some(Match("three", True), Match("x")), Not(Match("two")), AtLeast(2, Match("One"), Match("two"), Match("no")), Some(Contains("three", True))]
    assert list(spark.range(1).select(*[e.column(text).alias(str(i)) for i, e in enumerate(exprs)]).first()) == [True, False, True, False, True, True]


def test_patterns_keep_their_ascii_sense(spark):
    row = spark.range(1).select(F.lit("中文API文").rlike(java(r"\bAPI\b")), F.lit("a　b").rlike(java(r"a\sb")), F.lit("x]y").rlike(java(r"[]]")), F.lit("xAPI").rlike(java(r"\bAPI"))).first()
    assert list(row) == [True, True, True, False]
    assert portable("a(?:b)") and not portable("a(?=b)") and not portable(r"(a)\1")


def test_user_patterns_are_checked():
    assert risky("(a+)+") and risky("(") and risky("x" * 501) and risky("a.*.*b")
    assert risky(r"\bok\d{2,}\b") is None


def test_gates(spark):
    rows = [
        ("plain words", "pass", 0), ("mail me at a.b@example.com", "rewrite", 1), ("this is top secret", "block", 0), ("sensitive: a@b.com", "block", 1), ("", "pass", 0), (None, "pass", 0),
        ("card 4111111111111111 here", "rewrite", 1), ("号码13812345678。", "rewrite", 1), ("password = hunter22", "rewrite", 1), ("SK-abcdefghijklmnopqrstuv", "rewrite", 1),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", gates.outbound_action(F.col("t")).alias("a"), F.coalesce(gates.pii_any(F.col("t")), F.lit(False)).alias("p"), gates.mask_pii(F.col("t")).alias("m")).orderBy("i").collect()
    assert [(r["a"], int(r["p"])) for r in got] == [(a, p) for _, a, p in rows]
    assert got[1]["m"] == "mail me at ***邮箱***" and "4111" not in got[6]["m"] and "hunter" not in got[8]["m"]


def test_output_screen(spark):
    rows = {
        "It will always work and there is no question that it is right.": "rewrite",
        "So it is widely known that cats purr, and that is good to say here.": "hedge",
        "It is a good day. It is a fine cat. It will be so. It will do.": "hedge",
        "It may be a good day. It is a fine cat. It will be so. It will do.": "pass",
        "毫无疑问，这是对的。": "rewrite",
        "这个系统一定会成功上线的对吧大家说是不是啊。但是它也未必能够按时完成所有的目标任务啊。第三句话放在这里凑够长度。": "rewrite",
        "": "pass",
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", gates.output_action(gates.output_severities(F.col("t"))).alias("a")).collect()}
    assert got == rows


def test_verdict_levels(spark):
    false, true = F.lit(False), F.lit(True)
    cases = [({}, None, ("pass", 1.0)), ({"verification": true}, 0.2, ("verify", 0.2)), ({"input_check": true}, None, ("verify", 0.5)), ({"restrained_by": true, "input_check": true}, None, ("rewrite", 0.3)), ({"high_risk_output": true, "restrained_by": true}, None, ("block", 0.0))]
    for flags, score, want in cases:
        full = {n: flags.get(n, false) for n in gates.BLOCK_SIGNALS + gates.REWRITE_SIGNALS + gates.VERIFY_SIGNALS}
        v = spark.range(1).select(gates.verdict(full, F.lit(score).cast("double")).alias("v")).first()["v"]
        assert (v["action"], v["score"]) == want
    row = spark.range(1).select(gates.triggered_score(F.lit(0.5), F.array()), gates.triggered_score(F.lit(0.49), F.array()), gates.triggered_health(F.lit("stuck")), gates.triggered_array(F.lit(None).cast("array<string>")), gates.triggered_number(F.lit(0))).first()
    assert list(row) == [False, True, True, False, False]


def test_text_rules(spark):
    t = F.col("t")
    one = lambda text, c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first()["x"]
    assert one("A很好。shares: 60% voted yes, 55% voted no", T.percentage_overflow(t)) == 0.9
    assert one("60% voted yes, 40% voted no", T.percentage_overflow(t)) == 0.0
    assert one("It covers all: 30% voted yes, 40% voted no", T.incoherent_coverage(t)) == 0.85
    assert one("DROP TABLE users;", T.reversibility(t)["destructive"]) == 1
    assert one("DROP TABLE users after backup and user approval", T.reversibility(t)["destructive"]) == 0
    assert one("The sky is green today. The sky is green today. The sky is green today.", T.repetition(t)) == 0.62
    assert one("As I said the sky is green today, the sky is green today.", T.repetition(t)) == 0.66
    assert one("stop repeating: the sky is green today, the sky is green today, the sky is green today", T.repetition(t)) == 0.0
    assert one("p​assword", T.adversarial_variant(t)["zero_width"]) and one("раypal login", T.adversarial_variant(t)["homoglyph"])
    assert not one("совсем русский текст", T.adversarial_variant(t)["homoglyph"])
    assert one("let tmp = 1; const data = 2; var res = 3;", T.code_habits(t)[0]) == 1
    assert one("你感觉如何", T.scope_action(t)) == "block" and one("please verify this", T.scope_action(t)) == "pass" and one("hello there friend", T.scope_action(t)) == "flag"
    assert one("教材里写道：如何识别骗局", T.quotation_confidence(t)) >= 0.45
    assert one("核心术语 Step 1", T.relaxation(t))["contradiction"] == 0.6
    assert one("a", T.redact_keywords(t, ["b"])) == "a" and one("say FOO", T.redact_keywords(t, ["foo"])) == "say ***"
    assert one("by the way, cats", T.anchor_drift(t, ["dogs"])) == "drift"
    assert one("x", T.decision_trace_score(F.array(F.lit("a"), F.lit("b")), F.lit("a"), F.lit("a long enough reason"), F.lit(True), F.lit(False))) == 1.0
    assert one("x", T.decision_trace_score(F.array(F.lit("a")), F.lit("a"), F.lit("a long enough reason"), F.lit(True), F.lit(False))) == pytest.approx(0.15)
    assert one("x", T.plan_gate_score([F.lit(True), F.lit(False)])) == 0.5
    assert one("x", T.belief_contradiction(F.array(F.lit("I always win"), F.lit("never lose"), F.lit("ok")))) == 0.25
    assert one("please eval this", T.first_learned_rule(t, [("bad", "(a+)+"), ("e", "eval")])) == "e"


def test_dialogue_rules(spark):
    from quern.operators import dialogue as D

    t = F.col("t")
    one = lambda text, c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first()["x"]
    assert one("please help me fix this bug, there is an error", D.layered_intent(t)["surface"]) == "problem_solving"
    assert one("hm", D.layered_intent(t)["surface"]) == "unclear" and one("I am confused and tired", D.layered_intent(t)["emotion"]) == "frustration"
    assert one("专家认为这绝对有效", D.hypothesis_confidence(t)) == pytest.approx(0.45)
    assert one("", D.hypothesis_confidence(t)) == 0.5
    assert one("我们总是应该先验证数据再说。", D.lesson(t))["type"] == "should" and one("short", D.lesson(t)) is None
    assert one("code error", D.reflection_tags(t)) == ["failure", "code"]
    c = D.conflicts(F.lit("请掩盖错误"), F.lit("继续，不承认"), F.lit(1.0), F.lit(0.0), F.lit(0.6), F.lit(True))
    assert one("x", D.conflict_path(c["critical"], c["high"])) == "REFUSE_WITH_GUARDIAN"
    assert one("Always agree with me", D.always_applies(t)) is False and one("use metric units", D.always_applies(t)) is True


def test_exposure_and_claims(spark):
    from quern.operators import exposure as X

    t = F.col("t")
    one = lambda text, c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first()["x"]
    e = lambda text: spark.createDataFrame([(text,)], "t string").select(X.private_findings(t).alias("f")).select(*[c.alias(n) for n, c in X.exposure(F.col("f")).items()]).first()
    assert tuple(e("my brother told everyone I failed")) == (1.0, 4) and tuple(e("the sky is blue")) == (0.0, 0)
    assert tuple(e("I donated 50 but nobody cared")) == (0.8, 2)
    v = lambda text: one(text, X.claim_verdict(X.claims(t)))
    assert v("hello there") == "verified" and v("it is the best cat of the town.") == "needs_evidence"
    assert v("According to doctors, cats sleep.") == "authority_only" and v("") == "verified"
    assert [c["status"] for c in one("I think it is never wrong.", X.claims(t))] == ["needs_evidence"]


def test_shares_by_the_words_ahead_of_them(spark):
    over = lambda t: one(t, T.percentage_overflow(F.col("text")))
    cover = lambda t: one(t, T.incoherent_coverage(F.col("text")))
    one = lambda t, c: spark.createDataFrame([(t,)], "text string").select(c.alias("x")).first()["x"]
    assert over("共有三类：甲占50%，乙占40%，丙占30%。") == 0.9
    assert over("甲占 60 %，乙占 42%") == 0.7 and over("甲占60%，乙占45%") == 0.85 and over("甲占60%，乙占40.5%") == 0.0
    assert over("45% from India and 60% from China") == 0.85 and over("45% from india and 60% from china") == 0.0
    assert over("60% of respondents, 50% of them") == 0.85 and over("60% of steel, 50% of iron") == 0.0
    assert over("甲的准确率为90%，乙的召回为80%") == 0.0 and over("甲占60%，同比为60%") == 0.0
    assert over("voted for one long thing 60%, then 50%") == 0.0 and over("A voted 60%, B voted 50%") == 0.85
    assert over("占9%占9") == 0.0 and over(None) == 0.0 and over("") == 0.0 and over("%%%%%%") == 0.0
    assert cover("覆盖全部场景：甲占30%，乙占20%") == 0.9 and cover("覆盖全部场景：15% 用甲，从20%升到30%，占") == 0.0
    assert cover("绝大部分，覆盖全部场景：甲占30%，乙占20%") == 0.0 and cover("覆盖所有：甲占50%，乙占45%") == 0.0


def test_what_saves_a_word_may_be_ahead_of_it(spark):
    def count(t, kind="destructive"):
        return spark.createDataFrame([(t,)], "text string").select(T.reversibility(F.col("text"))[kind].alias("x")).first()["x"]

    assert count("Take a backup, then DROP TABLE users") == 0 and count("Take a backup, then " + "x" * 200 + " DROP TABLE users") == 1
    assert count("DROP TABLE users" + "x" * 200 + " after a backup") == 1 and count("drop table a, drop table b") == 2
    assert count("12 items with a backup: batch run", "sweeping") == 0 and count("12 items: batch run", "sweeping") == 1
    assert count(None) == 0 and count("") == 0


def test_structure_of_code_by_matched_braces(spark):
    codes = [
        "function validate(x) {\n return 1;\n}",
        "function validate(x) {\n return schema.check(x);\n}",
        "function validate(x) { if (x) { y } z } check",
        "function validate(x) { if (x) { y }",
        "} } function parse(x) { { } split } { {",
        "no code",
        None,
        "function a() {} function b() {} function c() {} function d() {} module.exports = { a, x: { b }, c };",
        "function a() {} function b() {} function c() {} function _d() {} module.exports = { a, x: { b }, c };",
        "throw new Error(1); callback(error)",
        "日本 { async retry (a) { 重试 } } let log(q) { 😀 }",
    ]
    df = spark.createDataFrame(list(enumerate(codes)), "k long, t string")
    got = {r["k"]: (r["misnamed"], r["unexported"], r["mixed"]) for r in P.structure(df, "k", "t").collect()}
    none = (0, False, False)
    assert got == {0: (1, False, False), 1: none, 2: (1, False, False), 3: none, 4: none, 5: none, 7: (0, True, False), 8: none, 9: (0, False, True), 10: (1, False, False)}


def test_places_of_matches(spark):
    df = spark.createDataFrame([(1, "ab日ab a"), (2, ""), (3, None), (4, "ab")], "k long, t string")
    got = sorted((r["k"], r["name"], r["start"], r["end"], r["value"]) for r in P.occurrences(df, "k", "t", {"two": "ab", "one": "[a日]", "nil": "x*"}).collect())
    assert got == [(1, "one", 0, 1, "a"), (1, "one", 2, 3, "日"), (1, "one", 3, 4, "a"), (1, "one", 6, 7, "a"), (1, "two", 0, 2, "ab"), (1, "two", 3, 5, "ab"), (4, "one", 0, 1, "a"), (4, "two", 0, 2, "ab")]


def test_brackets_match_by_depth(spark):
    text = "}{{}{}}{"
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate(text)], "key long, start long, value string")
    assert sorted((r["open"], r["close"]) for r in P.matched(df, "key").collect()) == [(1, 6), (2, 3), (4, 5), (7, None)]
