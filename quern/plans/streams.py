"""Streams as queries: a table is replayed in order as a file stream into a written table and held against the batch's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import breaker as B
from quern.plans.tables import EXP, experiences, table
from quern.sources.scratch import scratch_path
from quern.streaming import stateful as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Events are minutes apart, so a window of half a day and a cool-down of six hours stand for the minute of each.
_BREAKER = {"window": 43_200, "cooldown": 21_600, "critical": 200.0}

_BREAKER_SQL = """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY s) AS k FROM (
  SELECT user_id % 10 AS service, epoch_us(ts) AS s, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, max(value) >= 200 AS hot FROM events GROUP BY 1, 2)),
r AS (SELECT service, k, s, s AS ws, n AS total, bad, CASE WHEN hot THEN s END AS tripped FROM i WHERE k = 1
  UNION ALL
  SELECT service, k, s, ws, CASE WHEN closes THEN 0 ELSE total END, CASE WHEN closes THEN 0 ELSE bad END, CASE WHEN closes THEN NULL WHEN due AND hot THEN s ELSE tripped END FROM (
    SELECT i.service, i.k, i.s, i.hot, r.tripped, CASE WHEN i.s - r.ws > 43200000000 THEN i.s ELSE r.ws END AS ws,
      i.n + CASE WHEN i.s - r.ws > 43200000000 THEN 0 ELSE r.total END AS total, i.bad + CASE WHEN i.s - r.ws > 43200000000 THEN 0 ELSE r.bad END AS bad,
      r.tripped IS NULL OR i.s - r.tripped >= 21600000000 AS due, r.tripped IS NOT NULL AND i.s - r.tripped >= 21600000000 AND NOT i.hot AS closes
    FROM r JOIN i ON i.service = r.service AND i.k = r.k + 1)),
f AS (SELECT *, CASE WHEN total >= 10 THEN bad / total::DOUBLE ELSE 0 END AS rate FROM r)
SELECT service, s, CASE WHEN tripped IS NOT NULL THEN 'TRIPPED' WHEN rate >= 0.5 THEN 'OPEN' WHEN rate >= 0.3 THEN 'HALF_OPEN' ELSE 'CLOSED' END AS state FROM f"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("service"), s.alias("s"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("load"))


@query(_BREAKER_SQL)
def circuit_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips, checks after the cool-down and resets of ten services' breakers."""
    return B.breaker_states(_outcomes(spark, sf_dir), "service", F.col("s"), F.col("ok"), F.col("load"), **_BREAKER)


@query(_BREAKER_SQL)
def circuit_reset_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream."""
    return S.drained(S.breaker_states(S.replayed(_outcomes(spark, sf_dir), "s"), "service", "s", "ok", "load", **_BREAKER)).drop("batch")


@query(f"""WITH {EXP}, s AS (SELECT user_id, list(value / 500e0 ORDER BY event_id) AS v, list((CASE WHEN success THEN 1e0 ELSE -1e0 END) ORDER BY event_id) AS r FROM xp GROUP BY 1)
SELECT user_id, len(v)::BIGINT AS n, round(list_reduce(v, lambda a, x: x * 0.1e0 + a * 0.9e0), 9)::DOUBLE AS ema, round(list_reduce(v, lambda a, x: x * 0.2e0 + a * 0.8e0), 9)::DOUBLE AS mood,
  round(list_reduce(list_prepend(0e0, r), lambda q, x: q + 0.1e0 * (x + 0.9e0 * q - q)), 9)::DOUBLE AS q FROM s""")
def online_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, mood and Q value of each user, online."""
    rows = experiences(spark, sf_dir).select("user_id", "event_id", (F.col("value") / 500).alias("v"), F.when(F.col("success"), 1.0).otherwise(-1.0).alias("r"))
    out = S.drained(S.online_state(S.replayed(rows, "event_id"), "user_id", "event_id", "v", "r"), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "ema", "mood", "q"), "batch").alias("x"))
    return last.select("user_id", "x.n", *[F.round(f"x.{c}", 9).alias(c) for c in ("ema", "mood", "q")])


@query("""WITH l AS (SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || CASE WHEN value > 200 THEN '' ELSE '}' END AS line, value > 200 AS torn FROM events)
SELECT CASE WHEN torn THEN NULL ELSE event_id END AS event_id, CASE WHEN torn THEN line END AS dead FROM l""")
def dead_letters_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a stream that cannot be parsed are set aside and stop nothing."""
    line = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"user_id":'), F.col("user_id"), F.when(F.col("value") > 200, "").otherwise("}"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    out = S.drained(S.with_dead_letters(S.replayed(rows, "event_id"), "event_id long, user_id long"))
    return out.select("row.event_id", "dead")


@query("""WITH d AS (SELECT user_id, event_id, value FROM events) SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last_id, round(sum(value), 4)::DOUBLE AS total FROM d GROUP BY 1""")
def consolidation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes over what has come since the last one, as soon as it is twenty rows or more; together they cover each row once."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    path = scratch_path(spark, "consolidated")

    def consolidate(waiting: DataFrame, number: int) -> None:
        sums = waiting.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/pass={number}")

    S.periodic(S.replayed(rows, "event_id"), consolidate, scratch_path(spark, "passes"), every=None).awaitTermination()
    passes = spark.read.schema("user_id long, n long, last_id long, total double, pass long").parquet(path)
    return passes.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"), F.round(F.sum("total"), 4).alias("total"))
