"""Queries over logs, chains, write-ahead logs, snapshots and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import logs as L
from quern.operators import memory as M
from quern.sources import json_logs, wal
from quern.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WAL = """w AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 AND event_id < 5000 THEN 'commit' WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS type, user_id, value FROM events)"""


def _wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when((e % 97 == 0) & (e < 5000), "commit").when(F.col("event_type") == "error", "delete").otherwise("write")
    rows = table(spark, sf_dir, "events").select(e.alias("seq"), kind.alias("type"), "user_id", "value")
    return rows.withColumn("hash", wal.entry_hash("seq", "type", "user_id"))


@query(f"WITH {_WAL} SELECT seq, user_id FROM w WHERE type = 'write' AND seq > (SELECT coalesce(max(seq), -1) FROM w WHERE type = 'commit')")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid writes after the last commit."""
    return wal.replay(_wal(spark, sf_dir), ("seq", "type", "user_id")).select("seq", "user_id")


_CHAIN = """h AS (SELECT event_id AS seq, user_id AS chain, md5(event_id::VARCHAR) AS hash, CASE WHEN event_id % 113 = 0 THEN 'x' ELSE lag(md5(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id) END AS prev_hash FROM events)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string"))
    before = F.lag(h).over(Window.partitionBy("user_id").orderBy("event_id"))
    prev = F.when(F.col("event_id") % 113 == 0, "x").otherwise(before)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("chain"), h.alias("hash"), prev.alias("prev_hash"))


@query(f"WITH {_CHAIN}, b AS (SELECT *, lag(hash) OVER (PARTITION BY chain ORDER BY seq) AS expected FROM h) SELECT chain, count(*)::BIGINT AS n, min(seq) FILTER (expected IS NOT NULL AND prev_hash IS DISTINCT FROM expected) AS first_break FROM b GROUP BY 1")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken link of each chain."""
    return wal.chain_verdict(_chain(spark, sf_dir), "chain")


@query(f"WITH {_CHAIN} SELECT seq, hash FROM h WHERE chain = 7 ORDER BY seq DESC LIMIT 5")
def chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the last entries of a chain."""
    return wal.last_of_chain(_chain(spark, sf_dir), F.col("chain") == 7, 5).select("seq", "hash")


_ITEMS = """i AS (SELECT user_id AS entity, epoch_us(ts) // 86400000000 AS day, event_type AS key, count(*)::VARCHAR AS value FROM events GROUP BY 1, 2, 3)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), day.alias("day"), F.col("event_type").alias("key"))
    return rows.agg(F.count(F.lit(1)).cast("string").alias("value"))


@query(f"""WITH {_ITEMS}, n AS (SELECT entity, day, row_number() OVER (PARTITION BY entity ORDER BY day) AS no FROM (SELECT DISTINCT entity, day FROM i)),
x AS (SELECT i.entity, no, key, value FROM i JOIN n ON i.entity = n.entity AND i.day = n.day), m AS (SELECT entity, max(no) AS last_no FROM n GROUP BY 1),
a AS (SELECT x.entity, no + 1 AS no, key, value FROM x JOIN m ON x.entity = m.entity WHERE no < last_no), b AS (SELECT * FROM x WHERE no > 1)
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.no, b.no)::INT AS no, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.entity = b.entity AND a.no = b.no AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value <> b.value""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from each snapshot to the next."""
    return wal.consecutive_diffs(_items(spark, sf_dir), "entity", "day").select("entity", "no", "key", "change")


@query("""WITH s AS (SELECT event_id, event_type AS label, event_id % 50 = 0 AS rb, sum((event_id % 50 <> 0)::INT) OVER (PARTITION BY event_type ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS rk FROM events)
SELECT event_id, label FROM s WHERE rb OR rk <= 20""")
def retention_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshots of each label; rollback points stay."""
    s = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), (F.col("event_id") % 50 == 0).alias("is_rollback"))
    return wal.retained(s, "label", "event_id", 20).select("event_id", "label")


@query("SELECT event_id, event_type FROM events WHERE event_id % 50 = 0 ORDER BY event_id DESC LIMIT 12")
def rollback_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the newest rollback points."""
    return table(spark, sf_dir, "events").where("event_id % 50 = 0").orderBy(F.desc("event_id")).limit(12).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND event_type = 'purchase' ORDER BY ts, event_id LIMIT 50")
def ledger_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range with equality filters, the first fifty."""
    e = table(spark, sf_dir, "events")
    rows = e.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz")) & (F.col("event_type") == "purchase"))
    return rows.orderBy("ts", "event_id").limit(50).select("event_id")


@query("SELECT event_id, round(value, 6)::DOUBLE AS confidence FROM events WHERE event_type = 'view' AND value >= 100 ORDER BY value DESC, event_id LIMIT 20")
def annotation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotations by type and least confidence."""
    e = table(spark, sf_dir, "events").where("event_type = 'view' AND value >= 100")
    return e.orderBy(F.desc("value"), "event_id").limit(20).select("event_id", F.round("value", 6).alias("confidence"))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'purchase' AND (event_type <> 'error' OR ts < TIMESTAMP '2024-01-20') ORDER BY value DESC, event_id LIMIT 1")
def next_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open gap with the highest priority."""
    open_ = (F.col("event_type") != "purchase") & ((F.col("event_type") != "error") | (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return table(spark, sf_dir, "events").where(open_).orderBy(F.desc("value"), "event_id").limit(1).select("event_id", "user_id")


@query("SELECT 'doc' AS origin, doc_id AS id FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'turn', conv_id * 100 + turn FROM conversations WHERE contains(lower(text), 'license') UNION ALL SELECT 'item', item_id FROM benchmark WHERE contains(lower(text), 'license')")
def corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a union of sources, filtered."""
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("origin"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("origin"), F.col("item_id").alias("id"), "text")
    return M.containing(d.unionByName(c).unionByName(b), "license", "text").select("origin", "id")


@query("SELECT key, arg_min(pos, pos) AS pos FROM (SELECT user_id AS key, event_id AS pos FROM events WHERE user_id % 10 <> 0) GROUP BY 1 UNION ALL SELECT NULL, event_id FROM events WHERE user_id % 10 = 0")
def first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each id, rows without one all stay."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("key"), F.lit("f").alias("file"), F.col("event_id").alias("pos"))
    return json_logs.first_by_id(rows, "key").select("key", "pos")


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: floor(greatest(0e0, least(1e0, x::DOUBLE + 0.5e0)) * 15 + 0.5)))::BIGINT AS code_sum, round(list_sum(list_transform(embedding, lambda x: floor(greatest(0e0, least(1e0, x::DOUBLE + 0.5e0)) * 15 + 0.5) / 15)), 6)::DOUBLE AS back_sum FROM embeddings")
def quantize4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as four-bit codes and back."""
    shifted = F.transform("embedding", lambda x: x.cast("double") + 0.5)
    codes = S.quantize4(shifted)
    back = F.aggregate(S.dequantize4(codes), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(back, 6).alias("back_sum"))


_IPS = r"'([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})'"


@query(f"""WITH i AS (SELECT DISTINCT unnest(regexp_extract_all(text, {_IPS}, 1)) AS ip FROM documents UNION SELECT unnest(['10.1.2.3', '172.16.0.1', '172.32.0.1', '192.168.9.9', '127.0.0.1', '169.254.1.1', '8.8.8.8'])),
p AS (SELECT ip, string_split(ip, '.')[1]::INT AS a, string_split(ip, '.')[2]::INT AS b, string_split(ip, '.')[3]::INT AS c, string_split(ip, '.')[4]::INT AS d FROM i)
SELECT ip, a > 255 OR b > 255 OR c > 255 OR d > 255 OR a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224 AS blocked FROM p""")
def cidr_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """private, local and malformed addresses among those in the texts."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IPS.strip("'")), 1)).alias("ip"))
    extra = spark.createDataFrame([(x,) for x in ("10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.9.9", "127.0.0.1", "169.254.1.1", "8.8.8.8")], "ip string")
    return found.union(extra).distinct().select("ip", S.blocked_ip(F.col("ip")).alias("blocked"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text || ' ', '[^.!?;]*[.!?;]+\\s*|[^.!?;]+$'), lambda x: trim(x, ' \n\r\t')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n, round(list_avg(list_transform(s, lambda x: length(x))), 6)::DOUBLE AS mean_length FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences and their mean length."""
    s = S.sentences(F.col("text"))
    out = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    mean = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.size("s")
    return out.select("doc_id", F.size("s").cast("long").alias("n"), F.round(mean, 6).alias("mean_length"))


@query("""WITH b AS (SELECT conv_id * 100 + turn AS id, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM conversations)
SELECT id, len(list_distinct(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))))::BIGINT AS bigrams FROM b""")
def char_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct character bigrams."""
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.size(M.char_bigrams(F.col("text"))).cast("long").alias("bigrams"))


@query("""SELECT k, round(value, 6)::DOUBLE AS value FROM (SELECT event_type AS k, -sum(p * log2(p)) AS value FROM (SELECT event_type, count(*) / sum(count(*)) OVER (PARTITION BY event_type)::DOUBLE AS p FROM events GROUP BY event_type, user_id) GROUP BY 1)""")
def entropy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of users within each type."""
    c = L.counts_by(table(spark, sf_dir, "events"), "event_type", "user_id")
    p = F.col("n") / F.sum("n").over(Window.partitionBy("event_type"))
    out = c.withColumn("p", p).groupBy(F.col("event_type").alias("k")).agg(F.sum(S.entropy_term(F.col("p"))).alias("value"))
    return out.select("k", F.round("value", 6).alias("value"))
