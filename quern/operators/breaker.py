"""A circuit breaker with trip and reset over a log, without replaying it row by row.

Outcomes of one instant are judged together. A failure window starts with the first
instant later than the last window's start by more than the window. A critical load
trips the breaker; the first instant after the cool-down checks the load again: it trips
anew, or the breaker closes and counts from there. Window starts and trips are both what
a step from each to the next one reaches, so both are found by ``logs.orbit``; what lies
between them are islands of at most a window's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.logs import first_at_or_after, orbit
from quern.sources.scratch import written

SECOND = 1_000_000


def last_at_or_before(events: DataFrame, times: DataFrame, entity: str, width: int) -> DataFrame:
    """(entity, s, last): for each time (entity, s) the last event (entity, s) that is not later; null if there is none."""
    turned = first_at_or_after(events.select(entity, (-F.col("s")).alias("s")), times.select(entity, F.col("s").alias("t"), (-F.col("s")).alias("at")), entity, width)
    return turned.select(entity, F.col("t").alias("s"), (-F.col("next")).alias("last"))


def fail_state(total: Column, failures: Column, least: int, warn: float, trip: float) -> Column:
    rate = F.when(total >= least, failures / total).otherwise(F.lit(0.0))
    return F.when(rate >= trip, "OPEN").when(rate >= warn, "HALF_OPEN").otherwise("CLOSED")


def breaker_states(
    rows: DataFrame, entity: str, micros: Column, success: Column, load: Column, window: int = 60, cooldown: int = 60, least: int = 10, warn: float = 0.3, trip: float = 0.5, critical: float = 95.0
) -> DataFrame:
    """(entity, s, state) after each instant: TRIPPED, OPEN, HALF_OPEN or CLOSED.

    ``window`` and ``cooldown`` in seconds. Rows without entity or time are left out; a null load is none, a null outcome a failure.
    """
    wide, cool = window * SECOND, cooldown * SECOND
    instants = rows.select(F.col(entity), micros.alias("s"), success.alias("ok"), load.alias("load")).where(F.col(entity).isNotNull() & F.col("s").isNotNull())
    instants = instants.groupBy(entity, "s").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce("ok", F.lit(False)), 1)).alias("bad"), F.coalesce(F.max("load") >= critical, F.lit(False)).alias("hot"))
    instants = written(instants, "instants")
    times, hot = instants.select(entity, "s"), instants.where("hot").select(entity, "s")
    least_of = lambda df: df.groupBy(entity).agg(F.min("s").alias("s"))
    after = lambda df, by: df.select(entity, F.col("s").alias("t"), (F.col("s") + by).alias("at"))
    starts = orbit(least_of(times), first_at_or_after(times, after(times, wide + 1), entity, wide), entity)
    checks = written(first_at_or_after(times, after(hot, cool), entity, cool).select(entity, "t", F.col("next").alias("check")), "checks")
    again = first_at_or_after(hot, checks.where("check is not null").select(entity, "t", F.col("check").alias("at")), entity, cool)
    trips = orbit(least_of(hot), again, entity)
    trips = written(trips.join(checks.withColumnRenamed("t", "s"), [entity, "s"]), "trips")
    placed = instants.join(last_at_or_before(starts, times, entity, wide).withColumnRenamed("last", "w"), [entity, "s"])
    placed = placed.join(last_at_or_before(trips.select(entity, "s"), times, entity, cool).withColumnRenamed("last", "tripped"), [entity, "s"])
    placed = placed.join(trips.select(entity, F.col("s").alias("tripped"), "check"), [entity, "tripped"], "left")
    down = F.col("tripped").isNotNull() & (F.col("check").isNull() | (F.col("s") < F.col("check")))
    reset = F.when(F.col("check") <= F.col("s"), F.col("check"))
    placed = placed.withColumn("reset", reset).withColumn("since", F.when(F.col("reset") >= F.col("w"), F.col("reset")))
    run = Window.partitionBy(entity, "w", "since").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    counted = lambda c: F.sum(F.when(F.col("s") == F.col("reset"), 0).otherwise(F.col(c))).over(run)
    return placed.select(entity, "s", F.when(down, "TRIPPED").otherwise(fail_state(counted("n"), counted("bad"), least, warn, trip)).alias("state"))
