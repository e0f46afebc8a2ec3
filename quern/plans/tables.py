"""How the driver tables stand in for the entities that the operators work on, in Spark and as SQL common table expressions.

Time is never the wall clock: ages are taken against a fixed instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of the first memory, and of the instant that ages are taken against.
EPOCH = 1_704_067_200
AS_OF = EPOCH + 1000 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input a core: below it the input's splits may be fewer than the cores.
SPLIT_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows over all cores where the input is small, by the plan's estimate of its bytes; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def settled(df: DataFrame) -> DataFrame:
    """The rows, each column computed once where it stands.

    A filter on a computed column is otherwise pushed below the dealing out of the
    rows, and what it needs is computed there and a second time above it. No filter
    passes through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as memory records."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("type"),
        F.element_at(F.array(F.lit("CORE"), F.lit("LEARNED"), F.lit("EPHEMERAL")), (F.col("doc_id") % 3 + 1).cast("int")).alias("layer"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("importance"),
        (F.lit(EPOCH) + (F.col("doc_id") % 1000) * 3600).alias("created_s"),
        (F.col("n_chars") % 25).alias("access_count"),
    )


MEM = f"""mem AS (
  SELECT d.doc_id AS id, d.source AS type, ['CORE','LEARNED','EPHEMERAL'][(d.doc_id % 3 + 1)::INT] AS layer, d.text AS content,
         [d.lang, d.source] AS tags, d.lang AS lang, coalesce(l.quality::DOUBLE, 0.5) AS importance,
         {EPOCH} + (d.doc_id % 1000) * 3600 AS created_s, d.n_chars % 25 AS access_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as experiences: (event_id, ts, user_id, event_type, success, value, k)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        (F.col("event_type") != "error").alias("success"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EXP = """xp AS (
  SELECT event_id, ts, user_id, event_type, event_type <> 'error' AS success, value, (json_extract_string(props, '$.k'))::INT AS k
  FROM events)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer, nation and region as triples with a confidence: (seq, subject, predicate, object, confidence)."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    lives = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("seq"),
        F.col("c_name").alias("subject"),
        F.lit("lives_in").alias("predicate"),
        F.col("n_name").alias("object"),
        (F.abs("c_acctbal") / 10000.0).alias("confidence"),
    )
    part = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 10_000_000).cast("long").alias("seq"),
        F.col("n_name").alias("subject"),
        F.lit("part_of").alias("predicate"),
        F.col("r_name").alias("object"),
        F.lit(1.0).alias("confidence"),
    )
    return lives.unionByName(part)


TRI = """tri AS (
  SELECT c_custkey AS seq, c_name AS subject, 'lives_in' AS predicate, n_name AS object, abs(c_acctbal) / 10000.0 AS confidence
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT n_nationkey + 10000000, n_name, 'part_of', r_name, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey)"""
