import random

import pyarrow.parquet as pq
import sentencepiece

from quern.llm import sentencepiece_codec as C
from quern.llm.common import ship
from tests.conftest import SF
from tests.llm.helpers import docs, empty, odd

LIB = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)


def samples():
    out = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:60]
    rnd = random.Random(2)
    out += ["".join(rnd.choice("abcdefghe  tionr\n.é😀,#") for _ in range(200)) for _ in range(80)]
    return out + ["", " ", "   ", "  a  b ", "\n\n x\t", "日本語 テキスト", "a" * 400, "abcab" * 200, "x = 1;   // c"]


def test_ids_equal_the_public_library():
    m = C.Model.load(C.MODEL)
    for t in samples():
        assert m.encode(t) == LIB.encode(t), t[:80]
        assert m.decode(m.encode(t)) == t


def test_memo_generations_change_nothing(monkeypatch):
    for name in ("MEMO", "PAIRS", "HEADS"):
        monkeypatch.setattr(C, name, 20)
    m = C.Model.load(C.MODEL)
    for t in samples()[:40]:
        assert m.encode(t) == LIB.encode(t)
    assert len(m.memo) <= 20 and len(m.memo.old) <= 20 and len(m.pairs) <= 21


def test_stream_is_bounded_and_equal():
    m = C.Model.load(C.MODEL)
    text = "▁" + "thequickbrownfoxjumpsoverthelazydog" * 400
    seen = []

    def chunks():
        for i in range(0, len(text), 64):
            seen.append(sum(len(p) for p in out))
            yield text[i : i + 64]

    out: list[str] = []
    for piece in m.stream(chunks()):
        out.append(piece)
    assert [i for p in out for i in m.ids_of(p)] == LIB.encode(text[1:])
    # pieces are committed while the text is read: what is pending never grows with the text
    assert max(64 * k - done for k, done in enumerate(seen)) <= 64 * 2 + 4 * m.longest


def test_unigram_lattice_against_full_viterbi():
    m = C.Model.load(C.MODEL)
    m.bpe = False
    unknown = min(m.scores) - 10
    for t in samples()[:12]:
        t = t[:1500]
        best = [(0.0, 0)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - m.longest), e):
                p = t[s:e]
                if p in m.ids or e - s == 1:
                    v = best[s][0] + (m.scores[m.ids[p]] if p in m.ids else unknown)
                    if best[e] is None or v > best[e][0]:
                        best[e] = (v, s)
        want, e = [], len(t)
        while e:
            want.append(t[best[e][1] : e])
            e = best[e][1]
        assert list(m.stream([t[i : i + 50] for i in range(0, len(t), 50)])) == want[::-1]


def test_frames_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(samples())]
    got = C.encode(docs(spark, rows))
    assert got.where("not round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in C.decode(got).collect()}
    assert all(back[i] == t for i, t in rows)
    ids = {r["doc_id"]: (r["n_ids"], r["ids"]) for r in got.collect()}
    assert all(ids[i] == (len(LIB.encode(t)), LIB.encode(t)) for i, t in rows)


def test_odd_input(spark):
    rows = C.encode(odd(spark)).collect()
    assert len(rows) == 10
    null = next(r for r in rows if r["doc_id"] == 1)
    assert null["ids"] is None and null["n_ids"] is None and null["round_trip"] is None
    assert next(r for r in rows if r["doc_id"] == 2)["ids"] == []
    assert all(r["round_trip"] for r in rows if r["doc_id"] != 1)
    assert C.encode(empty(spark)).count() == 0
    assert C.decode(C.encode(odd(spark))).where("text is null").count() == 1


def test_decode_of_odd_ids(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, [None, -1, 1_000_000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in C.decode(rows).collect()} == {1: "", 2: None, 3: ""}
