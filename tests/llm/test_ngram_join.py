"""The n-gram join against all pairs of plain Python sets."""

import random

import pytest

from quern.llm import ngram_join as N
from quern.llm.near_dedup import shingle_set
from tests.llm.helpers import docs, empty, odd


def plain_set(text):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def plain_components(rows, percent=80):
    """{doc_id: smallest id reachable} by all pairs; rows without an id are left out."""
    known = [(i, plain_set(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in known}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, p) in enumerate(known):
        for j, q in known[:k]:
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in low}


def family(rng, base, copies, most):
    """Copies of a text with up to ``most`` words replaced."""
    out = []
    for _ in range(copies):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    """Near copies at all distances around the threshold, a passage that all share, templates, chains, short and repeated texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(300)}"
    passage = " ".join(word() for _ in range(60))
    texts = []
    for size in (30, 80, 200, 400):
        base = " ".join(word() for _ in range(size))
        texts += family(rng, base, 12, size // 12)
        texts += [base + " " + " ".join(word() for _ in range(k)) for k in range(0, size // 3, 5)]
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(30)]
    texts += ["one two", "ONE  two", "a b c d", "a b c d e", "a b c d e f", "", None] + texts[:5]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("tile", [N.TILE, 7])
def test_components_equal_all_pairs(spark, tile):
    rows = corpus(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(docs(spark, rows), tile=tile).collect()}
    want = plain_components(rows)
    assert got == {i: (len(plain_set(t)), want[i]) for i, t in rows}


def test_pairs_equal_all_pairs(spark):
    rows = corpus(2)
    got = {(r.a, r.b, r.shared, r.joint) for r in N.similar_pairs(docs(spark, rows), tile=16).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(plain_set(t), i)
    want = set()
    for p, i in first.items():
        for q, j in first.items():
            if i < j and p and q and 100 * len(p & q) >= 80 * len(p | q):
                want.add((i, j, len(p & q), len(p | q)))
    assert got == want and len(want) > 50


def test_threshold_is_met_exactly(spark):
    # 8 of 10 shingles in common: 100 * 8 = 80 * 10; and 7 of 9, just below
    a = " ".join(f"x{k}" for k in range(13))
    rows = [(1, a), (2, a + " y"), (3, a + " y z"), (4, " ".join(f"q{k}" for k in range(12))), (5, " ".join(f"q{k}" for k in range(14)))]
    rows += [(6, " ".join(f"r{k}" for k in range(12))), (7, " ".join(f"r{k}" for k in range(13)) + " s")]
    got = {r.doc_id: r.component_id for r in N.jaccard_components(docs(spark, rows)).collect()}
    assert got == plain_components(rows) and got[5] == 4


def test_bound_of_bitmaps_never_falls_short():
    rng = random.Random(3)
    for _ in range(200):
        words = [f"v{rng.randrange(50)}" for _ in range(rng.randint(5, 400))]
        other = list(words)
        for _ in range(rng.randint(0, 60)):
            other[rng.randrange(len(other))] = "z"
        p, q = shingle_set(" ".join(words)), shingle_set(" ".join(other + ["e"] * rng.randint(0, 50)))
        x, y = N.folded([N.bitmap(p), N.bitmap(q)])
        assert (len(p) + len(q) - int(N.np.bitwise_count(x ^ y).sum())) // 2 >= N.overlap(p, q)


def test_all_texts_of_a_repeated_id_count(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [(1, a), (5, b), (5, a), (7, a), (9, b), (9, ""), (None, a)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in N.jaccard_components(docs(spark, rows)).collect())
    assert got == [(0, 16, None), (1, 16, 1), (5, 16, 1), (5, 16, 1), (7, 16, 1), (9, 0, 1), (9, 16, 1)]


def test_one_stranger_in_a_large_group_meets_it_in_blocks(spark):
    rng = random.Random(4)
    base = " ".join(f"c{rng.randrange(10**6)}" for _ in range(60))
    texts = family(rng, base, 120, 1) + [" ".join(base.split()[:40] + [f"s{k}" for k in range(20)])]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in N.jaccard_components(docs(spark, rows), tile=10).collect()}
    assert got == plain_components(rows)


def test_odd_rows(spark):
    found = N.jaccard_components(odd(spark)).collect()
    assert len(found) == 10
    assert {r.doc_id: r.component_id for r in found if r.doc_id} == {k: k for k in range(1, 9)}
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert N.jaccard_components(empty(spark)).count() == 0 and N.similar_pairs(empty(spark)).count() == 0


def test_members_of_classes(spark):
    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (4, ""), (None, "a b c d e f")]
    assert sorted((r.doc_id or 0, r.class_id) for r in N.class_members(docs(spark, rows)).collect() if r.doc_id) == [(2, 2), (3, 2), (4, None)]


@pytest.mark.parametrize("cells", [N.CELLS if hasattr(N, "CELLS") else 0, 1500])
def test_texts_that_share_a_passage_but_do_not_link_give_no_rows_for_each_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(N, "CELLS", cells, raising=False)
    made, plain = {}, N.written

    def written(df, name, *rest):
        out = plain(df, name, *rest)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(N, "written", written)
    passage = " ".join(f"p{k}" for k in range(60))
    # 56 of 72 shingles in common, which the bitmaps let pass; the last three texts link
    rows = [(i, f"{passage} " + " ".join(f"t{min(i, 100)}x{k}" for k in range(7)) + f" t{i}") for i in range(103)]
    got = {r.doc_id: r.component_id for r in N.jaccard_components(docs(spark, rows)).collect()}
    assert got == plain_components(rows) and got[102] == 100
    assert max(made.values()) <= max(made["tiles"], len(rows)), made
