import corpus_pipeline as P
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import decontaminate as D
from quern.llm import quality_rules as R
from quern.llm import secret_scan as S
from quern.llm import sentencepiece_codec as C
from quern.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import empty, odd
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_secret_scan import all_spans


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    P.ship(spark)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    references = R.learn_references(docs)
    left = {i for i, r in rows.items() if R.verdict(r["text"], references)["kept"]}
    out = P.quality(spark, docs, SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == left

    comp = components([(i, rows[i]["text"]) for i in left])
    left = {i for i in left if comp[i][1] == i}
    out = P.dedup(spark, P.written(out, "t"), SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == left

    index = D.Index(D.load_items(table(spark, SF, "benchmark")))
    left = {i for i in left if not index.matches(rows[i]["text"])}
    out = P.decontaminated(spark, P.written(out, "t"), SF)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == left

    def masked(text):
        parts, at = [], 0
        for a, _, b in all_spans(text):
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(parts) + text[at:]

    out = P.secrets(spark, P.written(out, "t"), SF)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {i: (masked(rows[i]["text"]), len(masked(rows[i]["text"]))) for i in left}

    lib = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    got = P.tokens(spark, P.written(out, "t"), SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: lib.encode(masked(rows[i]["text"])) for i in left}
    whole = {r["doc_id"]: r["ids"] for r in P.run(spark, SF).collect()}
    assert whole == {r["doc_id"]: r["ids"] for r in got}


def test_odd_input(spark):
    for make in (odd, empty):
        docs = make(spark)
        for name, stage in P.STAGES:
            out = stage(spark, make(spark), SF)
            assert name == "sentencepiece" or out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()
    assert S.redact_secrets(odd(spark)).where(F.col("text").isNull()).count() == 1
