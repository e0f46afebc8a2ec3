"""Tables that a job writes for itself, in the folder that driver and executors share, and the package for executors' Python."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast may hold, unless its caller knows how wide they are.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a folder is made on a local master and refused elsewhere: one machine's folder is not shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system; a session that has ended is left alone."""
    if spark.sparkContext._jsc is None:  # noqa: SLF001
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


class Grown:
    """A table that grows by steps. Each step is written once and never read to be written again, and a read is one scan of all of them."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.name, self.paths = first.sparkSession, first.schema, name, []
        self.add(first)

    def add(self, rows: DataFrame) -> bool:
        """Whether the step has rows. One that has none is not kept."""
        path = scratch_path(self.spark, self.name)
        rows.select(*self.schema.names).write.parquet(path)
        self.paths.append(path)
        if self.last().limit(1).count():
            return True
        if len(self.paths) > 1:
            remove(self.spark, self.paths.pop())
        return False

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; a lost executor loses nothing of it."""
    return Grown(df, name).last()


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks rows for broadcast if a count shows that they are few; else the join shuffles them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python through Spark's file server, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="quern-core-")) / "quern-core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
