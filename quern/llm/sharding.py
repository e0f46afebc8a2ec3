"""Sharding by proportional stratified interleaving, on DataFrame functions alone.

Rows are shuffled within each source by a seeded hash and ranked; the fractional
rank (rank + 1/2) / rows of the source spreads every source evenly over 0 to 1;
all rows are ordered by it and the order is cut into shards of equal counts, so
each shard holds the sources in the proportions of the whole. Law: ``rows``.

No window ever holds a whole source or the whole table. A rank is the number of
rows in earlier buckets (a small table of counts with running sums) plus the
place within a bucket of about ``BUCKET_ROWS`` rows, so a source with a third
of all rows is ranked by as many tasks as any other rows.

Results for odd input: a null text has size 16 and the checksum of the empty
text; a null source is a source of its own; rows that agree in id, text size and
checksum are interchangeable and get neighbouring places; an empty table gives
an empty table; further columns are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, written

SHARDS = 40
SEED = "interleave-1"

#: Rows aimed at in a bucket, and the most buckets there are (running sums are taken over so many rows).
BUCKET_ROWS = 64
MOST_BUCKETS = 16_384

#: Bytes that a row takes beside its text.
OVERHEAD = 16


def shuffle_key(id_col: Column, seed: str = SEED) -> Column:
    """The seeded hash that orders the rows of a source: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """Adds ``rank`` (from 0) within ``group``: rows of earlier buckets plus the place in the bucket."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*[F.col(c) for c in group]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    inner = rows.withColumn("__place", place)
    same = [inner[c].eqNullSafe(offsets[c]) for c in [*group, bucket]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = inner.join(offsets, on, "inner").select(*[inner[c] for c in inner.columns], offsets["__before"])
    return joined.withColumn(rank, F.col("__before") + F.col("__place") - 1).drop("__before", "__place")


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One thin row a document: (doc_id, source, size, text_crc32, position, shard, slot) and the columns ``carry``.

    The text is read once, for the thin table that all else works on, and never shuffled.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = shuffle_key(F.col(id_col), seed)
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("__key"),
        *carry,
    )
    thin = written(thin, "thin")
    total = thin.count()
    buckets = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))
    first = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    thin = thin.withColumn("__bucket", F.floor(first * buckets / F.lit(2**32)).cast("int"))
    ties = ["doc_id", "text_crc32", "size", *carry]
    within = _ranked(thin, ["source"], "__bucket", ["__key", *ties], "__rank").drop("__bucket")
    sums = thin.groupBy("source").agg(F.count(F.lit(1)).alias("__rows"))
    spread = (
        within.join(sums.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("__share", (2 * F.col("__rank") + 1) / (2 * F.col("__rows")))
        .withColumn("__part", F.floor(F.col("__share") * buckets).cast("int"))
        .withColumn("__all", F.lit(0))
    )
    order = ["__share", F.col("source").asc_nulls_first(), "__key", *ties]
    placed = _ranked(spread, ["__all"], "__part", order, "position")
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    begins = F.expr(f"((position * {shards}) div {max(total, 1)} * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.col("position"),
        shard.cast("int").alias("shard"),
        (F.col("position") - begins).cast("long").alias("slot"),
        *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", **columns) -> None:
    """Writes whole rows into ``shard=N`` folders below ``path``, in slot order within a shard's files.

    Every row is written once, also rows with a null or repeated id: the rows are
    written with a number first, and the assignment is joined back on it. Columns of
    ``docs`` named shard or slot are kept as ``input_shard`` and ``input_slot``.
    """
    names = {c: f"input_{c.lower()}" for c in docs.columns if c.lower() in ("shard", "slot")}
    held = written(docs.withColumnsRenamed(names).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    thin = assign_shards(held, shards, names.get(id_col, id_col), **columns, carry=("__row",)).select("__row", "shard", "slot")
    rows = held.join(thin, "__row").drop("__row")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    discard(held)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The registered result: law ``rows``, so ``grown_shard`` is null."""
    return assign_shards(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "position",
    )
