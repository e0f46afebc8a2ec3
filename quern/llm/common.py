"""Shared plumbing: tables, the shared scratch folder, sized joins, Arrow slices."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast may hold (about 16 MB on each executor); beyond it the join shuffles.
BROADCAST_IDS = 500_000

#: Rows that are turned into Python objects at a time.
SLICE = 256


#: Rows and bytes in an Arrow batch, unless the session has its own settings.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20

#: Bytes of a row group of a scratch table: what a task's writer holds back.
GROUP_BYTES = 16 << 20

#: Rows that a file of a narrow scratch table has at least, where their number is known.
FILE_ROWS = 100_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python through Spark's file server, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="quern-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    # whole texts are wide rows: smaller batches bound what a Python worker holds at a time
    settings = spark._jsparkSession.sessionState().conf()  # noqa: SLF001
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not settings.contains(f"spark.sql.execution.arrow.{key}"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset in a local session, as in tests, a folder of our own is made
    and set; on a cluster a folder of one machine would not be shared, so that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system; a session that has ended is left alone."""
    if spark.sparkContext._jsc is None:  # noqa: SLF001
        return
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def written(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; lost executors lose nothing of it.

    Where the caller knows about how many narrow rows there are, small tables get as many files as
    there are cores and large ones a file for FILE_ROWS rows, however many partitions a shuffle has.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if most_rows is not None:
        files = max(spark.sparkContext.defaultParallelism, most_rows // FILE_ROWS)
        # an estimate may be the largest number there is, for a plan whose size is unknown
        df = df.coalesce(min(files, 2**31 - 1))
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def plan_bytes(df: DataFrame) -> int:
    """The plan's estimate of the bytes of the rows: for a table that is read, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Marks ``ids`` for broadcast if a count shows that it is small; else the join shuffles it."""
    small = ids.limit(most + 1).count() <= most
    return F.broadcast(ids) if small else ids


def joined(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` on a whole-number key that may hold a large share of ``rows``.

    Both sides are dealt out by the inverted key. If ``keyed`` comes from an
    aggregation on the key, a plain join would reuse that dealing, and Spark's skew
    join can split neither side; dealt anew, it splits the rows of a hot key.
    """
    left = rows.withColumn("__key", F.bitwise_not(F.col(key)))
    right = keyed.withColumn("__key", F.bitwise_not(F.col(key))).drop(key)
    return left.join(right, "__key", how).drop("__key")


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[list]:
    """The column as lists of Python objects, a few rows at a time."""
    for i in range(0, len(column), size):
        yield column.slice(i, size).to_pylist()


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    for part in slices(column):
        yield from part


def text_test(test: Callable[[str | None], bool]) -> Callable[[Column], Column]:
    """A condition on one column that is tested in Python, in Arrow batches: the other columns stay with Spark."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([test(text) for text in texts(batch)], pa.bool_())

    # Spark looks the types of the hints up, which postponed annotations hide
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")


def crc_fold(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``: the held-out split (a null id falls in fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def hash63(column) -> Column:
    """63 bits of a hash of the column, not negative."""
    return F.shiftrightunsigned(F.xxhash64(column), 1)


def hash_mark(share: float) -> int:
    """The value below which ``share`` of all 63-bit hashes lie, in full precision: no floor at any size."""
    return min(2**63 - 1, int(max(0.0, share) * 2**63))
