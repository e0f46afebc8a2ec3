"""What the third review found."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import plans
from quern.functions import scalars
from quern.operators import dialogue as D
from quern.operators import graph as G
from quern.operators import judgement as J
from quern.operators import logs as L
from quern.operators import memory as M
from quern.operators import registry as R
from quern.operators import rule_index as I  # noqa: E741
from quern.operators import text_rules as T
from quern.operators.detectors import ARGUMENT_DETECTORS
from quern.operators.rules import Contains, Match, any_literal, detect
from quern.operators.screen import screened
from tests.conftest import SF2


def test_action_is_chosen_by_the_score_before_it_is_rounded(spark):
    rows = [("s", "big", "x", 0.5001), ("s", "small", "x", 0.5002), ("t", "big", "x", 0.5), ("t", "small", "x", 0.5)]
    model = spark.createDataFrame(rows, "from_state string, action string, to_state string, probability double")
    got = {r["from_state"]: (r["action"], r["score"]) for r in L.choose_action(model).collect()}
    assert got == {"s": ("small", 0.5), "t": ("big", 0.5)}


def test_heat_is_rounded_as_the_sql_does(spark):
    value = spark.range(1).select(scalars.round_binary(F.lit(0.0628125) - F.lit(7e-18), 6).alias("a"), scalars.round_binary(F.lit(-1.25), 1).alias("b")).first()
    assert tuple(value) == (round(0.0628125 - 7e-18, 6), -1.3)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF2}/lineitem.parquet'")
    want = con.sql(f"SELECT k, n, activation, heat FROM ({plans.oracle_sql()['order_heat']})").fetchall()
    got = plans.queries()["order_heat"](spark, SF2).select("k", "n", "activation", "heat").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_screened_patterns_find_what_they_find_alone(spark):
    patterns = [
        (r"\b(?:the\s+moon|stars?)\b", True), ("月亮|太阳很大", False), (r"a|bcd", True), (r"(?:foo|bar)(?:x|y)", False), (r"(?:one|two) (three|four)|five[|]six", True), ("(?i)Seven|eight", False),
        (r"\bif\b[^.]*\bwould\b", True), (r"(.)\1{3}", False), ("moon", False), ("ooni", True), (r"cafÉ|été", True), ("第[一二]名|no\\.1", False), (r"(?:ab|cd)|(?:ef|gh)x", False), ("[(|]x|[]|]yz", False),
    ]
    words = ("moon", "The  Moon", "STARS", "star", "月亮", "月亮 moonish", "BCD", "a", "barx", "foo", "two three", "five|six", "SEVEN", "eight", "If it would", "aaaa", "cafÉ", "ÉTÉ", "No.1", "第二名", "cd", "ghx", "gh", "|x", "]yz", "", None)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, text string")
    alone = {f"p{i}": Match(p, ic).column(F.col("text")) for i, (p, ic) in enumerate(patterns)} | {"c": any_literal("Moon", "eight").column(F.col("text")), "d": Contains("stars", True).column(F.col("text"))}
    build = lambda: {f"p{i}": Match(p, ic).column(F.col("text")) for i, (p, ic) in enumerate(patterns)} | {"c": any_literal("Moon", "eight").column(F.col("text")), "d": Contains("stars", True).column(F.col("text"))}
    want = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in alone.items()]).collect()}
    got = {r["id"]: r for r in screened(df, F.col("text"), build).drop("text").collect()}
    assert got == want


def test_texts_without_a_literal_are_not_matched(spark):
    plan = detect(spark.createDataFrame([(1, "x")], "id int, text string"), ARGUMENT_DETECTORS[:1])._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap(__held" in plan and plan.count("regexp_extract_all") == 2


def test_bigrams_make_the_bare_text_once(spark):
    df = spark.createDataFrame([("A b\n𝒳c",), ("a",), ("",), (None,)], "text string").select(M.char_bigrams(F.col("text")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["ab", "b𝒳", "𝒳c"], [], [], None]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["tone", "implicit_needs", "frame_check", "coverage_gaps"])
def test_texts_without_a_literal_skip_the_patterns_of(spark, name):
    assert "arrays_overlap(__held" in plans.queries()[name](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_goal_distance_are_made_once(spark):
    plan = plans.queries()["goal_distances"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2


def test_claims_of_the_output_screen_are_counted_once(spark):
    plan = plans.queries()["output_screen"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("determines") == 1


def test_similar_pairs_are_counted_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 40)
    monkeypatch.setattr(G, "PIECE", 16)
    # every fifth row holds a word that all have; of rows that share a key each counts for itself
    rows = [(i // 2, ["the", *{f"w{(i * j) % 37}" for j in range(1, 2 + i % 9)}] if i % 5 else [f"w{i % 4}", "of"]) for i in range(150)] + [(7, ["x", "y", "z"]), (500, ["alone"]), (None, ["the"]), (501, None)]
    found = G.similar_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", F.col("t"), 0.12, 6)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and x and y and a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.12:
                want.setdefault(a, []).append(b)
    got = {}
    for r in found.collect():
        got.setdefault(r["a"], []).append(r["b"])
    assert {a: sorted(b) for a, b in got.items()} == {a: sorted(b)[:6] for a, b in want.items()}


def test_similar_pairs_of_a_repeated_key(spark):
    rows = [(1, ["a", "b"]), (1, ["c", "d", "e"]), (2, ["a", "b"]), (3, ["a"]), (4, ["b"])]
    found = G.similar_pairs(spark.createDataFrame(rows, "k int, t array<string>"), "k", F.col("t"), 0.9)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1.0)]


def test_rules_meet_texts_by_runs_across_gaps(spark, monkeypatch):
    assert I._keyed("To[ ,.\\n]+is.{0,20}the")[1:] == (["to\x01is"], ["to", "is", "the"])
    patterns = [
        "to[ ,.\\n]+is.{0,20}the", "a b", "a[ ]b", "a, +b", r"x\s+y", "one[^a]two", "(?:red|blue)[ ,]+fox", "cat[ x]+dog", "q[ ]*r", "ab{2,}c", "End[.!]", " lead", "k\x01 l", "[0-9]+", "é é", "z(?=[ ]w)", "(u v)+", "(one|two)[ ]three", "..", "m[ ]{2}n", "(a+)+$", "t[!-.]+u",
    ]
    texts = ["To, is it the", "to  is\n", "a b", "A, b", "a,  b", "a  b", "x\u3000y", "x\t\ny", "onebtwo", "one two", "BLUE, fox red", "cat x dog", "cat  dog", "qr", "q  r", "abbbc", "end!", "the end.", "x. lead", "k\x01 l", "7", "é é", "É é", "z w", "u vu v", "two three", "two,three", "m  n", "m ,n", "t!+u", "t,.u", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rules = spark.createDataFrame([(i % 2, p) for i, p in enumerate(patterns + patterns[:3])], "n int, pattern string")
    space = lambda p: p.replace(r"\s", "[\\s\u3000]")
    want = {(k, i % 2, p) for i, p in enumerate(patterns + patterns[:3]) if not p.endswith("$") for k, t in enumerate(texts) if t is not None and re.search("(?ai)" + space(p) if p.isascii() else "(?i)" + p, t) and (k, p) != (texts.index("É é"), "é é")}
    for few, most in ((0, I.BROADCAST_RULES), (0, 5), (100, I.BROADCAST_RULES)):
        monkeypatch.setattr(I, "FEW_PATTERNS", few)
        monkeypatch.setattr(I, "BROADCAST_RULES", most)
        assert {(r["k"], r["n"], r["pattern"]) for r in I.matches(rows, rules, "k", "t").collect()} == want


def test_few_patterns_need_no_grams(spark):
    texts, rules = spark.createDataFrame([(1, "x")], "k int, t string"), spark.createDataFrame([("x", "A", 3)], "pattern string, decision string, learned_at int")
    plan = I.first_match(texts, rules, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_excluding_pairs_are_not_held_to_be_told_apart(spark):
    texts = ["简洁 formal", "详细 casual", "简洁 详细 formal", "CASUAL 简短", "技术 英文", "通俗 中文", "none", None, "简洁 详细", "详细 简洁 中文 英文"]
    rows = [(i % 2, i, texts[i // 2 % len(texts)]) for i in range(40)] + [(None, 90, texts[0]), (None, 91, texts[1])]
    found = D.excluding_pairs(spark.createDataFrame(rows, "o int, k int, c string"), "o", "k", "c")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 2
    meet = lambda x, y: x and y and any((p in x.lower() and q in y.lower()) or (q in x.lower() and p in y.lower()) for p, q in D.EXCLUSIVE)
    want = sorted((o, i, j) for o, i, x in rows for p, j, y in rows if o == p and o is not None and i < j and meet(x, y))
    assert sorted(map(tuple, found.collect())) == want


def test_code_structure_looks_for_matches_once(spark):
    plan = plans.queries()["code_structure"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    # names within exports and declarations: the places of matches are read from a table
    assert plan.count("regexp_extract_all") <= 2 and "split(" not in plan


def test_claims_of_the_uncertainty_gap_are_counted_once(spark):
    plan = plans.queries()["uncertainty_gap"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("determines") == 1


def test_texts_without_a_literal_skip_the_cues_of_quotation(spark):
    plan = plans.queries()["scope_and_quotation"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap(__held" in plan


def test_surroundings_of_speculative_words_are_not_cut_out(spark):
    assert set(J.SPECULATIVE.split("|")) <= set(J.PERSPECTIVE)
    plan = plans.queries()["empathy"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    rows = [("maybe", 0.35), ("i care. perh\x01aps", 0.0), ("i think it might", 0.6), ("i think", 0.25), ("可能", 0.35)]
    got = spark.createDataFrame(rows, "t string, p double").select("p", J.empathy(F.col("t"))["perspective"].alias("q")).collect()
    assert all(r["p"] == r["q"] for r in got), got


def test_markers_are_looked_for_where_a_clause_is_repeated(spark):
    plan = plans.queries()["repetition_scores"](spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    # in both parts of the union; the exemptions stand in the branch of repeated clauses, and the whole is made of the clauses' plain forms
    assert plan.index("broken record") > plan.index("locate") and plan.count("[^a-z0-9") == 2
    texts = ["we must go now. we must go now. we must go now", "as i said we must go now. we must go now", "we must go now. we must go now", "broken record: we must go now. we must go now. we must go now", "we must. we must. we must", '"we must go now" we must go now. we must go now']
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.repetition(F.col("t")).alias("s")).collect()]
    assert got == [0.62, 0.66, 0.0, 0.0, 0.0, 0.0], got


def test_patterns_are_prepared_once_and_not_for_each_sight(spark):
    seen = spark.range(40).selectExpr("id n", "concat('p', id % 3) p", "concat('d', id % 2) d")
    rules = R.learned(seen, "p", "d", "n")
    at = lambda df, *words: [i for i, x in enumerate(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) if any(w in x for w in words)]
    kinds = I.patterns_of(rules)
    # a plan names what comes later first
    assert max(at(kinds, "Python", "Pandas")) < min(at(kinds, "Window"))
    assert sorted(tuple(r) for r in kinds.select("pattern", "__regex").collect()) == [(f"p{i}", f"(?i)p{i}") for i in range(3)]
    texts = spark.createDataFrame([(1, "P2 p1"), (2, "x")], "k int, t string")
    # what rules are learned from is not read again to be held against texts
    found = I.first_match(texts, rules, "k", "t")
    assert not at(found, "Window") and [tuple(r) for r in found.collect()] == [(1, "p1", "d1", 13)]


def test_few_patterns_are_tried_on_texts_that_hold_a_literal_of_theirs(spark, monkeypatch):
    patterns = [r"\b(always|never)\b", "System|data", "x*", "[ab]c", "(?u)k", "É"]
    texts = ["NEVER", "nevermind", "dAtA é", "İsystem", "K", "bC", "É", "", None]
    rows, rules = spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {(0, patterns[0]), (2, patterns[1]), (3, patterns[1]), (4, "(?u)k"), (5, "[ab]c"), (6, "É")} | {(i, "x*") for i in range(8)}
    for few in (0, 16):
        monkeypatch.setattr(I, "FEW_PATTERNS", few)
        found = I.matches(rows, rules, "k", "t")
        assert {(r["k"], r["pattern"]) for r in found.collect()} == want
    assert "exists(__any" in found._jdf.queryExecution().optimizedPlan().toString()
