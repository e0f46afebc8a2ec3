import random
from collections import Counter

import numpy as np

from quern.llm import decontaminate as D
from quern.llm.common import table
from tests.conftest import SF2
from tests.llm.helpers import docs, empty, odd


def items(spark):
    return D.load_items(table(spark, SF2, "benchmark"))


def test_search_finds_what_exhaustive_scoring_finds(spark):
    index = D.Index(items(spark) * 5)
    rnd = random.Random(3)
    for _ in range(200):
        terms = set(rnd.sample(range(len(index.terms)), 50))
        at, begin = index.units[rnd.randrange(len(index.units))]
        words = (index.items[at][1] + index.items[at][2])[begin : begin + D.UNIT]
        terms |= {index.terms[w] for w in words if rnd.random() < 0.7}
        score = Counter()
        for t in terms:
            for k in range(index.unit_from[t], index.unit_from[t + 1]):
                score[int(index.unit_of[k])] += index.unit_impact[k]
        term = np.array(sorted(terms))
        for threshold in (0.2, 0.6):
            got = index.search(np.zeros(len(term), np.int64), term, 1, threshold)
            assert sorted(u for _, u, _ in got) == sorted(u for u, s in score.items() if s >= threshold - 1e-9)


def test_leaks_against_brute_force(spark):
    docs(spark, [(1, "a")])
    d = table(spark, SF2, "documents")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(d, table(spark, SF2, "benchmark")).collect()}
    want = set()
    bench = items(spark)
    for r in d.select("doc_id", "text").collect():
        words = D.words_of(r["text"])
        for item, q, a in bench:
            n = len(q) + len(a)
            share = []
            for part in (q, a):
                k = min(D.SHINGLE, len(part))
                own = D.shingles(part, k)
                share.append(len(own & D.shingles(words, k)) / len(own) if own else 1.0)
            if n and min(share) >= D.OVERLAP:
                want.add((r["doc_id"], item))
    assert want and got == want


def test_long_items_and_edits(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(800)]
    item = [rnd.choice(vocabulary) for _ in range(150)]
    noise = lambda n: [f"z{rnd.randrange(5000)}" for _ in range(n)]
    edited = item[:]
    edited[70] = "changed"
    half = item[:75] + noise(75)
    rows = [(1, " ".join(noise(333) + item + noise(200))), (2, " ".join(noise(100) + edited).upper() + "."), (3, " ".join(half)), (4, " ".join(noise(500)))]
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"] for r in D.leaks(docs(spark, rows), bench).collect()}
    assert got == {1, 2}


def test_a_changed_word_anywhere_or_a_missing_end_still_leaks(spark):
    rnd = random.Random(5)
    lengths = (15, 30, 56)
    bench = [[f"w{n}x{k}" for k in range(n)] for n in lengths]
    noise = lambda n: [f"z{rnd.randrange(5000)}" for _ in range(n)]
    cases = []
    for at, item in enumerate(bench):
        n = len(item)
        cases += [(at, item[:k] + ["changed"] + item[k + 1 :]) for k in range(n)]
        cases += [(at, D.split_item(item)[0]), (at, item[n // 4 :]), (at, item[: n // 2] + ["so", "to", "say"] + item[n // 2 :])]
        cases += [(None, item[: n // 2]), (None, item[::-1])]
    rows = [(i, " ".join(noise(80) + x + noise(150))) for i, (_, x) in enumerate(cases)]
    table_ = spark.createDataFrame([(at, " ".join(x)) for at, x in enumerate(bench)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(spark, rows), table_).collect()}
    assert got == {(i, at) for i, (at, _) in enumerate(cases) if at is not None}


def test_an_answer_with_a_changed_word_still_leaks(spark):
    bench = spark.createDataFrame([(1, "where is the red house on the hill", "behind the old stone bridge")], "item_id long, question string, answer string")
    assert D.leaks(docs(spark, [(1, "Where is the red house on the hill? Behind the old wooden bridge.")]), bench).count() == 1


def test_unedited_is_the_fewest_edits():
    rnd = random.Random(2)
    for _ in range(200):
        part = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))]
        text = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 15))]
        row = [0] * (len(text) + 1)
        for i, w in enumerate(part):
            new = [i + 1]
            for k, v in enumerate(text):
                new.append(min(row[k] + (v != w), row[k + 1] + 1, new[k] + 1))
            row = new
        assert abs(D.unedited(part, text) - (1 - min(row) / len(part))) < 1e-12


def test_blocks_give_the_same_items(spark, monkeypatch):
    d, b = table(spark, SF2, "documents"), table(spark, SF2, "benchmark")
    whole = {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 15)
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()} == whole


def test_question_and_answer_columns(spark):
    bench = spark.createDataFrame([(1, "where is the red house on the hill", "behind the old stone bridge")], "item_id long, question string, answer string")
    rows = [(1, "So where is the red house on the hill? Behind the old stone bridge!"), (2, "So where is the red house on the hill? Nobody knows that at all.")]
    assert [r["doc_id"] for r in D.leaks(docs(spark, rows), bench).collect()] == [1]


def test_odd_input(spark):
    bench = table(spark, SF2, "benchmark")
    assert D.leaks(odd(spark), bench).count() == 0
    assert D.leaks(empty(spark), bench).count() == 0
    assert D.leaks(odd(spark), bench.limit(0)).count() == 0
    found = D.leaks(odd(spark), bench)
    assert D.drop_leaks(odd(spark), found).count() == 10 and D.drop_leaks(odd(spark), found).columns == odd(spark).columns


def test_parts_give_the_same_scores_and_long_texts_are_searched_in_steps(spark, monkeypatch):
    d, b = table(spark, SF2, "documents"), table(spark, SF2, "benchmark")
    rows = lambda: sorted((r["doc_id"], r["item_id"], r["score"], r["question_overlap"], r["answer_overlap"]) for r in D.leaks(d, b).collect())
    whole = rows()
    monkeypatch.setattr(D, "BLOCK_ITEMS", 15)
    assert rows() == whole
    index = D.Index(D.load_items(b) * 20)
    assert len(index.levels) > 2
    words = [w for _, q, a in index.items[:10] for w in q + a] * 3
    pairs = index.passages(words)
    want = sorted(index.search(*pairs, 0.3))
    monkeypatch.setattr(D, "STEP", 50)
    assert want and sorted(index.search(*pairs, 0.3)) == want


def test_keep_clean_equals_the_documents_without_leaks(spark, monkeypatch):
    d, b = table(spark, SF2, "documents"), table(spark, SF2, "benchmark")
    want = {r["doc_id"] for r in D.drop_leaks(d, D.leaks(d, b)).collect()}
    assert {r["doc_id"] for r in D.keep_clean(d, b).collect()} == want
    monkeypatch.setattr(D, "BLOCK_ITEMS", 9)
    assert {r["doc_id"] for r in D.keep_clean(d, b).collect()} == want
    assert D.keep_clean(odd(spark), b).count() == 10 and D.keep_clean(odd(spark), b.limit(0)).count() == 10
