import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.llm import sharding as S
from quern.llm.common import table
from tests.conftest import SF2
from tests.llm.helpers import docs, empty, odd


def brute(rows, shards):
    by = defaultdict(list)
    for i, source in rows:
        by[source].append((hashlib.md5(f"{S.SEED}:{i}".encode()).hexdigest(), i))
    order = []
    for source, members in by.items():
        for k, (h, i) in enumerate(sorted(members)):
            order.append(((2 * k + 1) / (2 * len(members)), source, h, i))
    order.sort()
    return {i: (p, p * shards // len(order)) for p, (_, _, _, i) in enumerate(order)}


def test_against_brute_force(spark):
    d = table(spark, SF2, "documents")
    want = brute([(r["doc_id"], r["source"]) for r in d.select("doc_id", "source").collect()], 40)
    got = S.digest(d).collect()
    assert all((r["position"], r["shard"]) == want[r["doc_id"]] for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 1


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "en", "big" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = S.assign_shards(docs(spark, rows), 8).groupBy("shard", "source").count().collect()
    whole = Counter(r[3] for r in rows)
    for r in got:
        assert abs(r["count"] - whole[r["source"]] / 8) <= 2


def test_size_and_checksum(spark):
    got = {r["doc_id"]: r for r in S.digest(docs(spark, [(1, "é😀"), (2, None), (3, "")])).collect()}
    assert (got[1]["size"], got[2]["size"], got[3]["size"]) == (6 + 16, 16, 16)
    assert got[1]["text_crc32"] == zlib.crc32("é😀".encode()) and got[2]["text_crc32"] == 0


def test_odd_input(spark):
    rows = S.digest(odd(spark)).collect()
    assert len(rows) == 10 and sorted(r["position"] for r in rows) == list(range(10))
    assert S.digest(empty(spark)).count() == 0
    assert S.digest(docs(spark, [(5, "x", "en", "a")] * 100)).select("slot", "shard").distinct().count() == 100


def test_no_python_in_the_plan(spark):
    plan = S.digest(odd(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|SinglePartition.*Window.*rows", plan)


def test_write_shards_keeps_every_row(spark, tmp_path):
    d = table(spark, SF2, "documents").limit(200)
    S.write_shards(d, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_write_shards_with_odd_ids_and_clashing_names(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), (7, "c"), (7, "c"), (7, "d"), (8, None)]
    d = docs(spark, rows).withColumn("shard", F.lit("x")).withColumn("Slot", F.lit(3))
    S.write_shards(d, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["input_shard"], r["input_slot"]) for r in back.collect()) == sorted(
        (i or 0, t or "", "x", 3) for i, t in rows
    )
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [2, 2, 2]
