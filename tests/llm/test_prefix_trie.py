"""The prefix trie against a plain dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from quern.llm import prefix_trie as T
from quern.llm.common import ship

SCHEMA = "conv_id long, turn long, role string, text string, depth long, p1 long, words string, conv string"


def rows(spark, data):
    ship(spark)
    return spark.createDataFrame([(*r, 3, 4, "x", "y") for r in data], SCHEMA)


def plain(data):
    own = {}
    for c, t, r, x in data:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, data, **how):
    return sorted(map(tuple, T.prefix_trie(rows(spark, data), **how).collect()), key=str)


def corpus(seed):
    """A first turn that most share, copies of conversations, conversations that begin others, one long, ties, nulls."""
    rng = random.Random(seed)
    say = [(rng.choice(("user", "assistant", None)), rng.choice(("hello there", "a  b\tc", "", None, "ü 日本", f"t{k} x"))) for k in range(6)]
    data = []
    for c in range(0, 130):
        if c % 7 == 3:
            continue
        n = rng.randint(1, 7)
        for t in range(n):
            r, x = say[0] if t == 0 and c % 3 else rng.choice(say[: 2 + t % 3])
            data.append((c, t, r, x))
    for c in (200, 201, 202, 221, 222):  # one chain of which each is a beginning, and copies of it
        data += [(c, t, "user", f"step {t}") for t in range(40 - 3 * (c % 3))]
    data += [(300, None, "user", "first"), (300, 1, "b", "z"), (300, 1, "a", "y"), (300, 1, "a", "x"), (300, 1, "a", "x")]
    data += [(None, 0, "user", "nobody"), (-5, 0, "user", "below"), (-5, 1, "user", "zero")]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("most", [T.MOST_NODES, 5])
def test_nodes_equal_plain_prefixes(spark, most):
    data = corpus(1)
    assert trie(spark, data, most=most) == plain(data)


def test_long_conversations_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 8)
    data = [(c, t, "user", f"{min(t, 30 + c)}") for c in (40, 41, 60) for t in range(50)]
    assert trie(spark, data, most=20) == plain(data)


def test_conversations_without_turns_end_at_the_root(spark):
    # no first conversation of the block, and fewer own turns than are replaced
    data = [(c, 0, "user", "only") for c in range(1, 20)]
    want = plain(data)
    assert trie(spark, data) == want
    assert any(r[1] == 0 and r[7] != T.EMPTY_SHA for r in want)


def test_empty_and_null_tables(spark):
    assert T.prefix_trie(rows(spark, [(None, 1, "a", "b")])).count() == 0
    assert T.prefix_trie(rows(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
