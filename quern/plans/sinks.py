"""Sinks as queries: a given table is written, read back by the tolerant readers, moved or erased, and what is there then is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.plans.graph import _RAW, _raw
from quern.plans.tables import EXP, MEM, experiences, memories, table
from quern.sources import json_logs as J
from quern.sources.scratch import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH l AS (SELECT event_id, user_id, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS whole FROM events),
c AS (SELECT *, CASE event_id % 11 WHEN 3 THEN substring(whole, 1, 15) WHEN 5 THEN 'not json ' || event_id WHEN 7 THEN '  ' ELSE whole END AS line FROM l)
SELECT 'row' AS kind, event_id, user_id, NULL AS line FROM c WHERE line = whole UNION ALL SELECT 'dead', NULL, NULL, line FROM c WHERE line <> whole AND trim(line) <> ''""")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with torn, foreign and blank lines, read back as rows and dead letters."""
    whole = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"user_id":'), F.col("user_id"), F.lit("}"))
    at = F.col("event_id") % 11
    line = F.when(at == 3, F.substring(whole, 1, 15)).when(at == 5, F.concat(F.lit("not json "), F.col("event_id"))).when(at == 7, "  ").otherwise(whole)
    path = scratch_path(spark, "jsonl")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows, dead = J.read_jsonl(spark, path, "event_id long, user_id long")
    none = F.lit(None)
    out = rows.select(F.lit("row").alias("kind"), "event_id", "user_id", none.cast("string").alias("line"))
    return out.unionByName(dead.select(F.lit("dead").alias("kind"), none.cast("long").alias("event_id"), none.cast("long").alias("user_id"), F.col("value").alias("line")))


def _daily(spark: SparkSession, sf_dir: str) -> str:
    """The events as a daily log, in two appends."""
    path = scratch_path(spark, "daily")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"))
    for late in (False, True):
        J.append_daily(e.where((F.col("user_id") % 2 == 1) == F.lit(late)), path)
    return path


@query("""SELECT event_id, user_id, category, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, event_type AS category FROM events) WHERE category = 'error' AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-11'""")
def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a log appended by category and day, read back for a week of one category."""
    rows = J.scan_days(spark, _daily(spark, sf_dir), "event_id long, user_id long, ts timestamp, category string, day string", "error", "2024-01-05", "2024-01-11")
    return rows.select("event_id", "user_id", "category", "day")


@query("""SELECT CASE WHEN strftime(ts, '%Y-%m-%d') < '2024-01-15' THEN 'archive' ELSE 'live' END AS place, event_type AS category, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL""")
def archived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days beyond the retention move to the archive, once, though it is asked for twice."""
    path, old = _daily(spark, sf_dir), scratch_path(spark, "archive")
    for _ in range(2):
        J.archive(spark, path, old, "event_id long, user_id long, ts timestamp", "2024-02-14", 30)
    out = None
    for place, where in (("live", path), ("archive", old)):
        rows = spark.read.schema("event_id long, category string, day string").json(where)
        counts = rows.groupBy(F.lit(place).alias("place"), "category", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
        out = counts if out is None else out.unionByName(counts)
    return out


@query(f"WITH {MEM}, e AS (SELECT *, lang = 'fr' OR id % 10 = 3 AND lang = 'en' AS gone FROM mem) SELECT lang, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids, sum(length(content))::BIGINT AS chars FROM e WHERE NOT gone GROUP BY 1")
def memory_erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memories are written, those of a scope erased in place, and what is left read back: one language goes whole, of one a part."""
    path = scratch_path(spark, "memories")
    rows = memories(spark, sf_dir).select("id", "content").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    rows.write.partitionBy("lang").json(path)
    schema = "id long, content string, lang string"
    gone = (F.col("lang") == "fr") | ((F.col("id") % 10 == 3) & (F.col("lang") == "en"))
    J.erase(spark, path, schema, ["lang"], gone)
    left = spark.read.schema(schema).json(path)
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(F.length("content")).alias("chars"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 2")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a file, over several lines; torn ones give no row."""
    path = scratch_path(spark, "documents")
    body = F.concat(F.lit('{\n "n_nationkey": '), F.col("n_nationkey"), F.lit(',\n "n_name": "'), F.col("n_name"), F.lit('"\n'), F.when(F.col("n_nationkey") % 5 == 2, "").otherwise("}"))
    table(spark, sf_dir, "nation").select(body.alias("value"), F.col("n_nationkey").alias("file")).repartition("file").write.partitionBy("file").text(path)
    return J.read_document(spark, path, "n_nationkey long, n_name string").where("n_nationkey is not null").select("n_nationkey", "n_name")


@query("SELECT role, count(*)::BIGINT AS n, sum(length(conv_id::VARCHAR || '-' || turn::VARCHAR))::BIGINT AS chars FROM conversations GROUP BY 1")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files of a tree of folders, without those of version control."""
    path = scratch_path(spark, "tree")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("value"), "role")
    rows.write.partitionBy("role").text(f"{path}/src")
    rows.write.partitionBy("role").text(f"{path}/.git/src")
    files = J.scan_files(spark, path, "*.txt").select(F.regexp_extract("path", "role=([^/]+)", 1).alias("role"), F.explode(F.split("text", "\n")).alias("line"))
    return files.where("line <> ''").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query(f"""WITH {_RAW}, r AS (SELECT * REPLACE (CASE WHEN seq % 50 = 1 THEN '' ELSE subject END AS subject) FROM raw),
g AS (SELECT lower(subject || '|' || predicate || '|' || object) AS key, arg_min(object, seq) AS object, arg_max(confidence, seq) AS c, count(*)::BIGINT AS writes FROM r WHERE subject <> '' GROUP BY 1)
SELECT key, object, round(greatest(0e0, least(1e0, c)), 6)::DOUBLE AS confidence, writes FROM g""")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples saved and loaded, incomplete ones left out."""
    path = scratch_path(spark, "triples")
    G.save_triples(_raw(spark, sf_dir).withColumn("subject", F.when(F.col("seq") % 50 == 1, "").otherwise(F.col("subject"))), path)
    return G.load_triples(spark, path).select("key", "object", F.round("confidence", 6).alias("confidence"), "writes")


@query(f"WITH {EXP} SELECT event_id AS id, event_type AS task, success FROM xp WHERE event_id % 13 <> 4 AND event_id % 17 <> 5")
def import_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiences exported and imported again, those without an id or a task refused."""
    path = scratch_path(spark, "export")
    e = F.col("event_id")
    J.export(experiences(spark, sf_dir).select(F.when(e % 13 != 4, e).alias("id"), F.when(e % 17 != 5, F.col("event_type")).alias("task"), "success"), path)
    return J.import_valid(spark.read.schema("id long, task string, success boolean").json(path))
