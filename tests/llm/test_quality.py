import re
import zlib
from collections import Counter

import numpy as np

from quern.llm import quality_classifier as Q
from quern.llm import quality_rules as R
from quern.llm.common import table
from tests.conftest import SF2
from tests.llm.helpers import docs, empty, odd


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(hit),
    }


def test_base_counts_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF2, "documents").limit(250).collect()]
    rows += [(10_001, "a b c a b c\na b c"), (10_002, None), (10_003, "\x1c x\x85y z  \x0b\x0c #|"), (10_004, "x\nx\n\nx "), (10_005, "p q p q p q")]
    got = {r["doc_id"]: r.asDict() for r in R.assess(docs(spark, [(*r, "en") for r in rows])).collect()}
    for i, text in rows:
        want = brute_counts(text)
        assert {k: got[i][k] for k in want} == want, i
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i]["base_failed"] == failed
        assert not (failed and got[i]["kept"])


def test_divergence_separates_junk_and_keeps_clean_text(spark):
    d, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    got = R.assess(d).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    junk = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.4


def test_short_junk_is_dropped_and_short_text_with_a_key_is_kept(spark):
    d, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    references = R.learn_references(d)
    clean = [r["text"] for r in d.join(labels, "doc_id").where("quality = 1 and lang = 'en'").orderBy("doc_id").limit(30).collect()]
    for text in clean:
        words = text.split()
        for n in (60, 90, 150):
            part = words[:n]
            if len(part) < n or R.verdict(" ".join(part), references)["base_failed"]:
                continue
            key = 'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"'
            assert R.verdict(" ".join([*part, key]), references)["kept"]
            assert not R.verdict(" | ".join(part), references)["kept"]
    got = R.judge(d, references).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] for r in got if r["quality"] == 0) <= 1
    assert all(r["kept"] for r in got if r["quality"] == 1)


def test_references_cover_all_documents(spark):
    rows = [(i, " ".join(f"w{i % 7} the x{j}" for j in range(60)), "en") for i in range(40)]
    counts = {(r["kind"], bytes(r["key"])): r["n"] for r in R.corpus_counts(docs(spark, rows)).collect()}
    want = Counter(w.encode() for _, t, _ in rows for w in t.split())
    assert {k[1]: n for k, n in counts.items() if k[0] == "word"} == want
    assert counts[("total", b"")] == sum(want.values())


def test_jensen_shannon():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert R.jensen_shannon(p, q) == 1.0 and R.jensen_shannon(p, p) == 0.0
    assert abs(R.jensen_shannon(np.array([0.5, 0.5]), p) - R.jensen_shannon(p, np.array([0.5, 0.5]))) < 1e-12


def test_rules_on_odd_input(spark):
    rows = R.assess(odd(spark)).collect()
    assert len(rows) == 10
    assert all(r["base_failed"] and not r["kept"] for r in rows)
    assert R.assess(empty(spark)).count() == 0
    kept = R.keep_good(odd(spark), R.learn_references(odd(spark)))
    assert kept.columns == odd(spark).columns and kept.count() == 0


def test_classifier_held_out(spark):
    d, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    got = Q.classify(d, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_classifier_never_sees_held_out_labels(spark):
    d, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = Q.learn(d, labels), Q.learn(d, flipped)
    assert np.allclose(a.weights, b.weights) and a.cut == b.cut


def test_pairs_learn_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(Q.FEATURES)))
    y = (x[:, 3] - x[:, 5] > 0.4).astype(int)
    s = Q.fit(x, y).scores(x)
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.99
    assert abs((s < Q.MARK).mean() - (y == 0).mean()) < 0.02


def test_classifier_on_odd_input(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(odd(spark), labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in Q.classify(odd(spark), labels.limit(0)).collect()} == {0.5}


def test_sample_size_holds_for_any_number_of_rows(spark, monkeypatch):
    from quern.llm import language_id as L
    from quern.llm.common import hash_mark

    assert hash_mark(1e-10) == int(1e-10 * 2**63) > 0 and hash_mark(2.0) == 2**63 - 1
    rows = [(i, f"word{i} and some more", "en" if i % 2 else "fr") for i in range(3000)] + [(3001, "the same again", "en")] * 2000
    monkeypatch.setattr(L, "TRAIN_DOCS", 200)
    seen = []
    monkeypatch.setattr(L, "Hierarchy", lambda x, langs: seen.append(langs))
    L.learn(docs(spark, rows))
    assert 100 < len(seen[0]) < 300
    labels = spark.createDataFrame([(i, i % 2) for i in range(3002)], "doc_id long, quality int")
    monkeypatch.setattr(Q, "TRAIN_DOCS", 200)
    monkeypatch.setattr(Q, "fit", lambda x, y: len(x))
    assert 100 < Q.learn(docs(spark, rows), labels) < 300


def test_rare_languages_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(R, "LANG_SHARE", 0.2)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, "en") for i in range(20)] + [(100 + i, text, f"x{i}") for i in range(5)]
    references = R.learn_references(docs(spark, rows))
    assert set(references.langs) == {"en", R.POOLED}
    assert all(abs(s[:-1].sum() - 1) < 1e-9 for s in references.word_shares)


def test_verdict_against_a_plain_reading(spark):
    """Distances and verdicts again, by counting characters and words one by one."""
    import math

    from quern.llm.textstats import STOPS, SYMBOLS

    def kind(c):
        if ord(c) > 127:
            return "other"
        for name, test in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit), ("space", str.isspace)):
            if test(c) and not 0x1C <= ord(c) <= 0x1F:
                return name
        if c.encode() in [bytes([b]) for b in SYMBOLS]:
            return "symbol"
        if c.encode() in [bytes([b]) for b in STOPS]:
            return "stop"
        return "control" if ord(c) < 32 or ord(c) == 127 else "mark"

    def distance(p, q):
        total = 0.0
        for k in set(p) | set(q):
            a, b = p.get(k, 0.0), q.get(k, 0.0)
            m = (a + b) / 2
            total += sum(x * math.log2(x / m) for x in (a, b) if x > 0) / 2
        return math.sqrt(max(0.0, total))

    d = table(spark, SF2, "documents")
    references = R.learn_references(d)
    seen = Counter()
    for r in d.orderBy("doc_id").limit(300).collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        chars = Counter(map(kind, text))
        tokens = Counter(kind(c) for w in words if len(w.encode()) >= R.LONG_TOKEN and re.search("[0-9]", w) for c in w)
        if tokens and sum(tokens.values()) <= R.TOKEN_SHARE * sum(chars.values()):
            chars = chars - tokens
        plain = [w.encode().strip(R._STRIP).lower() for w in words]
        best = None
        for own, shares, classes in zip(references.words, references.word_shares, references.class_shares, strict=True):
            known = {w: s for (w, _), s in zip(own, shares, strict=False)}
            count = Counter(w if w in known else None for w in plain)
            mine = {w: n / max(1, len(words)) for w, n in count.items()}
            by_word = distance(mine, known | {None: float(shares[-1])})
            share = {c: n / max(1, sum(chars.values())) for c, n in chars.items()}
            pair = (by_word, distance(share, dict(zip(R.CLASSES, map(float, classes), strict=True))))
            best = pair if best is None or pair < best else best
        base = brute_counts(text)
        failed = base["n_words"] < 50 or 100 * base["n_repeat_words"] > 50 * base["n_words"]
        bad = len(text) >= R.LEAST_CHARS and best[1] > R.MOST_CLASS + R.CLASS_SPREAD / math.sqrt(len(text))
        got = R.verdict(r["text"], references)
        assert got["kept"] == (not (failed or bad or best[0] > R.MOST_WORD)), r["doc_id"]
        if words:
            assert abs(got["word_distance"] - best[0]) < 1e-6 and abs(got["class_distance"] - best[1]) < 1e-6, r["doc_id"]
        seen[got["kept"]] += 1
    assert seen[True] > 100 and seen[False] > 10


def test_scores_against_a_plain_reading(spark):
    """The classifier's score from its weights, term by term."""
    import math

    d, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    ranker = Q.learn(d, labels)
    got = {r["doc_id"]: r for r in Q.score(d, ranker).collect()}
    for r in d.limit(200).collect():
        x = Q.features(r["text"])
        strength = sum((float(v) - m) / s * w for v, m, s, w in zip(x, ranker.mean, ranker.spread, ranker.weights, strict=True))
        z = max(-40.0, min(40.0, (strength - ranker.cut) / ranker.width + math.log(0.3 / 0.7)))
        want = 1 / (1 + math.exp(-z))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
