"""Structured Streaming twins: tumbling breaker windows, running averages, bounded histories, periodic passes.

Watermarks bound the state; what comes later than the watermark is dropped,
which is this engine's rule. Batch and stream share their Columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.logs import circuit_windows
from quern.sources.scratch import scratch_path, shared_dir


def deduplicated(events: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """One event a key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def breaker(events: DataFrame, ts: str, success: Column, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """Breaker states by tumbling window of a stream; a window is final when the watermark has passed it."""
    return circuit_windows(events.withWatermark(ts, delay), ts, success, seconds)


def running_ema(events: DataFrame, entity: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """(entity, n, ema) after each batch: one number of state an entity, sorted within the batch by ``order``."""
    kind = dict(events.dtypes)[entity]

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[value]:
            ema = float(x) if ema is None else alpha * float(x) + (1 - alpha) * ema
        n += len(rows)
        state.update((n, ema))
        yield pd.DataFrame({entity: [key[0]], "n": [n], "ema": [ema]})

    return (
        events.select(entity, order, value)
        .groupBy(entity)
        .applyInPandasWithState(step, f"{entity} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
    )


def breaker_states(
    events: DataFrame, entity: str, micros: str, success: str, load: str, window: int = 60, cooldown: int = 60, least: int = 10, warn: float = 0.3, trip: float = 0.5, critical: float = 95.0
) -> DataFrame:
    """(entity, s, state) after each instant, as ``operators.breaker`` gives for the whole log: five numbers of state an entity.

    An instant's rows come in one batch, batches in order of time; within a batch rows may come in any order.
    """
    kind, wide, cool = dict(events.dtypes)[entity], window * 1_000_000, cooldown * 1_000_000

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, total, bad, tripped = state.get if state.exists else (None, 0, 0, None)
        rows = pd.concat(list(frames))
        rows = rows.assign(fails=~rows[success].fillna(False).astype(bool)).groupby(micros).agg(n=("fails", "size"), fails=("fails", "sum"), load=(load, "max")).sort_index()
        out = []
        for at, n, fails, most in rows.itertuples():
            if start is None or at - start > wide:
                start, total, bad = at, 0, 0
            total, bad = total + n, bad + int(fails)
            hot = bool(most >= critical)
            if tripped is not None and at - tripped >= cool and not hot:
                tripped, total, bad = None, 0, 0
            elif hot and (tripped is None or at - tripped >= cool):
                tripped = at
            rate = bad / total if total >= least else 0.0
            out.append("TRIPPED" if tripped is not None else "OPEN" if rate >= trip else "HALF_OPEN" if rate >= warn else "CLOSED")
        state.update((int(start), int(total), int(bad), None if tripped is None else int(tripped)))
        yield pd.DataFrame({entity: [key[0]] * len(out), "s": rows.index.to_numpy(), "state": out})

    return (
        events.select(entity, micros, success, load)
        .groupBy(entity)
        .applyInPandasWithState(step, f"{entity} {kind}, s long, state string", "start long, total long, bad long, tripped long", "append", GroupStateTimeout.NoTimeout)
    )


def online_state(events: DataFrame, entity: str, order: str, value: str, reward: str, alpha: float = 0.1, blend: float = 0.2, rate: float = 0.1, discount: float = 0.9) -> DataFrame:
    """(entity, n, ema, mood, q) after each batch: average, blended mood and Q value of an entity in one state, sorted within the batch by ``order``."""
    kind = dict(events.dtypes)[entity]

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema, mood, q = state.get if state.exists else (0, None, None, 0.0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x, r in zip(rows[value].tolist(), rows[reward].tolist(), strict=True):
            ema = x if ema is None else alpha * x + (1 - alpha) * ema
            mood = x if mood is None else blend * x + (1 - blend) * mood
            q += rate * (r + discount * q - q)
        n += len(rows)
        state.update((n, ema, mood, q))
        yield pd.DataFrame({entity: [key[0]], "n": [n], "ema": [ema], "mood": [mood], "q": [q]})

    numbers = "n long, ema double, mood double, q double"
    return events.select(entity, order, value, reward).groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, {numbers}", numbers, "update", GroupStateTimeout.NoTimeout)


def replayed(rows: DataFrame, order: str, batches: int = 4) -> DataFrame:
    """The rows as a file stream of ``batches`` micro-batches in order: no batch begins before the one ahead of it ends."""
    spark = rows.sparkSession
    path = scratch_path(spark, "replay")
    rows.repartitionByRange(batches, order).sortWithinPartitions(order).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    where = hadoop(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    files = sorted(x.getPath().toString() for x in store.listStatus(where) if x.getPath().getName().startswith("part-"))
    for k, name in enumerate(files):
        # a file stream takes files in the order of their times
        store.setTimes(hadoop(name), 1_000_000_000_000 + 60_000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is into a written table: its rows and ``batch``. A batch that is run again overwrites its own rows."""
    spark = stream.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, "drained")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def last_values(events: DataFrame, entity: str, order: str, value: str, most: int = 100) -> DataFrame:
    """(entity, values): the latest ``most`` values of each entity; older ones are dropped from the state."""
    kind = dict(events.dtypes)[entity]

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order)
        held = (held + [float(x) for x in rows[value]])[-most:]
        state.update((held,))
        yield pd.DataFrame({entity: [key[0]], "values": [held]})

    return (
        events.select(entity, order, value)
        .groupBy(entity)
        .applyInPandasWithState(step, f"{entity} {kind}, values array<double>", "values array<double>", "update", GroupStateTimeout.NoTimeout)
    )


def periodic(events: DataFrame, consolidate: Callable[[DataFrame, int], None], checkpoint: str, least: int = 20, every: str | None = "1 hour"):
    """Runs ``consolidate`` on all rows since its last run, as soon as they are ``least`` or more.

    ``every`` None: starts at once, takes all that there is and ends; else the writer is returned for its caller to start.

    Each micro-batch is kept below ``checkpoint``/pending before its offsets are
    committed. A batch that is run again overwrites its own rows; a mark with the
    batch's number, set after ``consolidate``, says which rows are done. After a
    failure before the mark, ``consolidate`` gets the same rows and number again.
    """
    pending, marks = f"{checkpoint.rstrip('/')}/pending", f"{checkpoint.rstrip('/')}/consolidated"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        store = path(checkpoint).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        numbers = lambda where: [int(x.getPath().getName()) for x in store.listStatus(path(where))] if store.exists(path(where)) else []
        done = max(numbers(marks), default=-1)
        for old in numbers(pending):
            if old <= done:
                store.delete(path(f"{pending}/{old}"), True)
        if number <= done:
            return
        rows.write.mode("overwrite").parquet(f"{pending}/{number}")
        if spark.read.schema(rows.schema).parquet(f"{pending}/{number}").limit(1).count() == 0:
            store.delete(path(f"{pending}/{number}"), True)
        held = [f"{pending}/{x}" for x in sorted(numbers(pending)) if x <= number]
        if not held:
            return
        waiting = spark.read.schema(rows.schema).parquet(*held)
        if waiting.limit(least).count() < least:
            return
        consolidate(waiting, number)
        store.create(path(f"{marks}/{number}"), True).close()
        for name in held:
            store.delete(path(name), True)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if every is None else writer.trigger(processingTime=every)


def with_dead_letters(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """(row, dead): parsed rows, and the line itself where it cannot be parsed."""
    parsed = F.from_json(column, schema)
    bad = F.get_json_object(column, "$").isNull()
    return lines.select(F.when(~bad, parsed).alias("row"), F.when(bad, F.col(column)).alias("dead"))
