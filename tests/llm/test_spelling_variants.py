"""Spelling variants against plain loops over all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np

from quern.llm import spelling_variants as S
from quern.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import docs, empty, odd


def plain_words(rows):
    found = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                found[run] += 1
                run = ""
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(rows):
    n = plain_words(rows)
    near = {w: [] for w in n}
    by = {}
    for w in n:
        for k in range(len(w)):
            by.setdefault((len(w) - 1, w[:k] + w[k + 1 :]), set()).add(w)
    for w in n:
        mates = set().union(*(by[len(w) - 1, w[:k] + w[k + 1 :]] for k in range(len(w)))) | by.get((len(w), w), set())
        for v in mates:
            if v != w and one_edit(w, v):
                near[w].append(v)
                if len(v) > len(w):
                    near[v].append(w)
    near = {w: set(v) for w, v in near.items()}
    form = {}
    for w, mates in near.items():
        best = min(mates, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def groups(spark, rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.spelling_groups(docs(spark, rows)).collect()}


def test_documents_against_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = plain_groups(rows)
    assert groups(spark, rows) == want and sum(x[2] is not None for x in want.values()) > 20


def test_chains_runs_and_letters_beyond_ascii(spark):
    rng = random.Random(5)
    words = ["banana", "bannana", "bananna", "banaana", "anana", "grüße", "grüsse", "GRÜSSE", "straße", "strasse", "ab×cde", "ab÷cde", "abcde"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    # counts double along a chain: each is one letter longer
    texts += [" ".join(["zzzzzz"] * 3 + ["zzzzzzz"] * 6 + ["zzzzzzzz"] * 12 + ["zzzzzzzzz"] * 24 + ["zzzzzzzzzz"] * 48)]
    rows = list(enumerate(texts))
    want = plain_groups(rows)
    assert groups(spark, rows) == want
    assert want["zzzzzz"][4] == "zzzzzzzzzz"


def test_long_words_go_in_blocks(spark):
    word = "abcdefghij" * 300
    rows = [(1, " ".join([word] * 3 + [word[:-1]] * 7 + [word + "a"] * 3))]
    assert groups(spark, rows) == plain_groups(rows)


def test_edits_are_distinct_and_complete():
    made = S.Neighbours([ord(c) for c in "abc"])
    for word in ("aabbc", "aaaaa", "abcab"):
        found = []
        for kind, lo, hashes, first in made.edits(made.places([word])):
            for k in np.flatnonzero(first):
                _, p, *c = np.unravel_index(k, hashes.shape)
                text = made.edited(word, kind, lo + int(p), int(c[0]) if c else 0)
                assert made.heads(made.places([text]))[1][0, -1] == hashes.reshape(-1)[k]
                found.append(text)
        want = {word[:k] + word[k + 1 :] for k in range(5)} | {word[:k] + c + word[k + 1 :] for k in range(5) for c in "abc"} | {word[:k] + c + word[k:] for k in range(6) for c in "abc"}
        assert len(found) == len(set(found)) and set(found) == want - {word}


def test_odd_rows(spark):
    assert S.spelling_groups(empty(spark)).count() == 0
    assert S.spelling_groups(odd(spark)).count() == len(plain_words([(4, "alpha beta gamma delta " * 5000)]))
