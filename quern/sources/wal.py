"""Write-ahead logs, hash chains and snapshots: replay, verification, comparison, retention."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_hash(*columns: str) -> Column:
    """First sixteen hexadecimal digits of the SHA-256 of the columns as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def replay(entries: DataFrame, hashed: tuple[str, ...] | None = None) -> DataFrame:
    """WRITE entries after the last commit, with a valid hash if ``hashed`` names the columns it covers."""
    committed = entries.where("type = 'commit'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("through"))
    rows = entries.where("type = 'write'")
    rows = rows.where(F.col("hash") == entry_hash(*hashed)) if hashed else rows
    return rows.join(F.broadcast(committed), F.col("seq") > F.col("through")).drop("through")


def chain_breaks(entries: DataFrame, chain: str, order: str = "seq") -> DataFrame:
    """Entries whose previous hash is not the hash of the entry before."""
    by = Window.partitionBy(chain).orderBy(order)
    before = F.lag("hash").over(by)
    return entries.withColumn("expected", before).where(F.col("expected").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("expected")))


def chain_verdict(entries: DataFrame, chain: str, order: str = "seq") -> DataFrame:
    """(chain, n, first_break): null for an intact chain."""
    broken = chain_breaks(entries, chain, order).groupBy(chain).agg(F.min(order).alias("first_break"))
    return entries.groupBy(chain).agg(F.count(F.lit(1)).alias("n")).join(broken, chain, "left")


def last_of_chain(entries: DataFrame, condition: Column, limit: int, order: str = "seq") -> DataFrame:
    return entries.where(condition).orderBy(F.desc(order)).limit(limit)


def hmac_sha256(key: str, text: Column) -> Column:
    """HMAC in hexadecimal: two SHA-256 digests over the key's two paddings, both in the JVM."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytes(x ^ byte for x in secret))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, old, new) of two (keys, value) tables: added, removed or changed."""
    a = before.select(*keys, F.col("value").alias("old"), F.lit(True).alias("in_old"))
    b = after.select(*keys, F.col("value").alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "old", "new")


def state_items(snapshots: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """(keys, key, value) of map states."""
    return snapshots.select(*keys, F.explode(state).alias("key", "value"))


def consecutive_diffs(items: DataFrame, entity: str, order: str) -> DataFrame:
    """Changes from each snapshot of an entity to the next, of (entity, order, key, value) items.

    Snapshots get a running number, so the previous one is an equi-join and not a search.
    """
    numbers = items.select(entity, order).distinct()
    numbers = numbers.withColumn("no", F.row_number().over(Window.partitionBy(entity).orderBy(order)))
    named = items.join(numbers, [entity, order])
    later = named.where("no > 1").select(entity, "no", "key", "value")
    last = numbers.groupBy(entity).agg(F.max("no").alias("last_no"))
    earlier = named.join(last, entity).where("no < last_no").select(entity, (F.col("no") + 1).alias("no"), "key", "value")
    return diff(earlier, later, [entity, "no", "key"])


def retained(snapshots: DataFrame, label: str, order: str, keep: int, rollback: str = "is_rollback") -> DataFrame:
    """The newest ``keep`` snapshots of each label; rollback points always stay and do not count."""
    normal = F.when(~F.col(rollback), 1)
    rank = F.count(normal).over(Window.partitionBy(label).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return snapshots.withColumn("rank", rank).where(F.col(rollback) | (F.col("rank") <= keep)).drop("rank")
