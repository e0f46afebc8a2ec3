import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import near_dedup as N
from quern.llm.common import table
from tests.conftest import SF2
from tests.llm.helpers import docs, empty, odd


def brute(rows):
    """Components by comparing all sets that share a shingle."""
    sets = {}
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows):
    got = {r["doc_id"]: r for r in N.near_components(docs(spark, rows)).collect()}
    for i, (n, c) in brute(rows).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i), i


def test_documents_against_brute_force(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in table(spark, SF2, "documents").collect()])


def test_chains_groups_and_shared_passages(spark):
    rnd = random.Random(7)
    words = [f"v{k}" for k in range(3000)]
    pick = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = pick(52)
    rows = []
    base = pick(60)
    for k in range(60):  # a group of near copies around one text
        w = base[:]
        w[rnd.randrange(60)] = f"e{k}"
        rows.append(w)
    chain = pick(80)
    for k in range(40):  # each close to the one before, the ends far apart
        chain = chain[:]
        chain[(k * 2) % 80] = f"c{k}"
        rows.append(chain)
    for k in range(80):  # different texts that all hold one long passage
        rows.append(pick(rnd.randrange(2, 30)) + passage + pick(rnd.randrange(2, 30)))
    rows += [base, base, pick(3), pick(3), ["A", "b"], ["a", "B"]]
    rnd.shuffle(rows)
    check(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for size in (3, 12, 60, 800):
        agree = []
        for _ in range(120):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 2**63, len(a) - len(a) * 3 // 4, dtype=np.uint64)]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((N.signature(a) == N.signature(b)).mean() - j)
        assert abs(np.mean(agree)) < 0.05


def test_stars_bound_the_pairs(spark):
    members = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7)], "bucket long, id long")
    assert N._stars(members).count() == 499


def test_texts_of_repeated_ids_all_count(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    near_c = c.replace("c7", "x7")
    rows = [(1, a), (5, b), (5, a), (7, a), (9, b), (12, c), (3, near_c), (12, "quite another text of more words"), (20, "quite another text of more words")]
    got = {}
    for r in N.near_components(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {1: {1}, 5: {1}, 7: {1}, 9: {1}, 12: {3}, 3: {3}, 20: {3}}
    kept = N.keep_first(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]
    # of the rows of a kept id that of the smallest text stays
    rows = [(2, b), (2, a), (2, a), (4, c)]
    assert {(r["doc_id"], r["text"]) for r in N.keep_first(docs(spark, rows)).collect()} == {(2, a), (4, c)}


def test_a_stranger_among_many_of_one_component(spark):
    """A bucket of 20,000 members of one component and one stranger gives a pair for each member at most, never their square."""
    members = spark.range(20_000).selectExpr("1L AS bucket", "id", "40L AS n", "1L AS place", "0L AS label")
    members = members.union(spark.createDataFrame([(1, 50_000, 41, 1, 50_000)], members.schema))
    none = spark.createDataFrame([], "a long, b long")
    assert N._across(members, False, none).count() == 20_000
    assert N._across(members, True, none).count() == 20_000
    far = members.withColumn("n", F.when(F.col("label") == 0, 40).otherwise(80).cast("long"))
    assert N._across(far, True, none).count() == 0


def test_pairs_across_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(b, 100 * b + i, rnd.randrange(20, 60), rnd.randrange(1, 12), rnd.randrange(3)) for b in range(6) for i in range(30)]
    members = spark.createDataFrame(rows, "bucket long, id long, n long, place long, label long")
    none = spark.createDataFrame([], "a long, b long")
    want = set()
    for b, i, n, p, c in rows:
        for b2, j, m, q, d in rows:
            if b == b2 and i < j and c != d and 100 * min(n, m) >= 75 * max(n, m):
                place = p if n < m else q if m < n else min(p, q)
                if 7 * place <= min(n, m) + 7 and 175 * (1 + min(n - p, m - q)) >= 75 * (n + m):
                    want.add((i, j))
    got = N._across(members, True, none).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_odd_input(spark):
    got = N.near_components(odd(spark)).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_shingles"], by[1]["component_id"], by[1]["kept"]) == (0, 1, True)
    assert by[2]["component_id"] == 2 and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert [r["component_id"] for r in got if r["doc_id"] == 7] == [7, 7]
    assert N.near_components(empty(spark)).count() == 0
    kept = N.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id = 7").count() == 1 and kept.count() == 9
