"""JSON documents and JSONL logs: tolerant readers, daily appends, rotation, directory scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.scratch import sized, written

# Directories that a recursive scan leaves out.
SKIPPED_DIRS = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "target")


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON; a corrupt file gives no row, a missing one an empty table."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of JSONL files. Corrupt and blank lines never stop a scan; they are the dead letters."""
    lines = spark.read.text(path).withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_none"}))
    valid = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.col("row").isNotNull() & F.get_json_object("value", "$").isNotNull()
    blank = F.trim("value") == ""
    return lines.where(valid).select("row.*"), lines.where(~valid & ~blank).select("value")


def append_daily(rows: DataFrame, path: str, category: str = "category", ts: str = "ts") -> None:
    """Appends JSONL below ``category=.../day=...``."""
    daily = rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    daily.write.mode("append").partitionBy(category, "day").json(path)


def scan_days(spark: SparkSession, path: str, schema: str, category: str, first: str, last: str, limit: int | None = None) -> DataFrame:
    """Rows of a category between two days (partition pruned), in time order, up to ``limit``."""
    rows = spark.read.schema(schema).json(path).where((F.col("category") == category) & F.col("day").between(first, last))
    return rows.orderBy("ts").limit(limit) if limit else rows


def rotate(spark: SparkSession, path: str, archive: str, schema: str, as_of_day: str, retention_days: int = 180) -> DataFrame:
    """Copies days older than the retention to gzip JSON and returns the rows that stay; removing the old partitions is the caller's step."""
    rows = spark.read.schema(schema).json(path)
    old = F.col("day") < F.date_sub(F.lit(as_of_day).cast("date"), retention_days).cast("string")
    rows.where(old).write.mode("append").partitionBy("category", "day").option("compression", "gzip").json(archive)
    return rows.where(~old)


def _store(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the maker of its paths)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make  # noqa: SLF001


def _delete_files(spark: SparkSession, files: DataFrame) -> None:
    """Deletes the files of the first column, names as ``input_file_name`` gives them; those that are gone count as deleted."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    for r in files.toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r[0]))
        _store(spark, r[0])[0].delete(where, False)


def archive(spark: SparkSession, path: str, target: str, schema: str, as_of_day: str, retention_days: int = 180) -> None:
    """Moves days older than the retention to gzip JSON below ``target``, a folder for each file that is moved.

    Safe to repeat after a failure: a file is deleted after it is archived, and one that is archived again
    is written over itself. Files that come meanwhile, or later for a day that is archived, are left for the next run.
    """
    rows = spark.read.schema(f"{schema}, category string, day string").json(path).withColumn("__file", F.input_file_name())
    old = rows.where(F.col("day") < F.date_sub(F.lit(as_of_day).cast("date"), retention_days).cast("string"))
    files = written(old.select("__file").distinct(), "moved")
    moved = old.join(sized(files), "__file", "left_semi").withColumn("move", F.md5("__file")).drop("__file")
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("category", "day", "move").json(target)
    _delete_files(spark, files)


def _finish_erasures(spark: SparkSession, path: str) -> None:
    """Completes or drops what an earlier erasure left: with its list of files it is carried through, without it nothing was changed."""
    root = f"{path.rstrip('/')}/_erase"
    store, make = _store(spark, path)
    if not store.exists(make(root)):
        return
    for stage in [x.getPath().toString() for x in store.listStatus(make(root))]:
        if store.exists(make(f"{stage}/files/_SUCCESS")):
            _delete_files(spark, spark.read.text(f"{stage}/files"))
            found = store.listFiles(make(f"{stage}/rows"), True)
            while found.hasNext():
                name = found.next().getPath()
                if name.getName().startswith("part-"):
                    to = make(f"{path.rstrip('/')}/{name.toString().split('/rows/', 1)[1]}")
                    store.mkdirs(to.getParent())
                    if not store.rename(name, to):
                        raise OSError(f"cannot move {name} to {to}")
        store.delete(make(stage), True)
    store.delete(make(root), True)


def erase(spark: SparkSession, path: str, schema: str, keys: list[str], scope: Column) -> DataFrame:
    """Erases the rows of ``scope`` from JSON partitioned by ``keys`` and gives one row with the counts erased and kept.

    Only files that hold such rows are rewritten. What stays of them is written aside, then the list of the
    old files; only then are those deleted and the new ones put in place. A run that
    fails before the list has changed nothing, one that fails after it is carried through by the next. One
    writer at a time. A null scope erases nothing.
    """
    _finish_erasures(spark, path)
    rows = spark.read.schema(schema).json(path).withColumn("__file", F.input_file_name())
    hit = F.coalesce(scope, F.lit(False))
    counts = written(rows.agg(F.count(F.when(hit, 1)).alias("erased"), F.count(F.when(~hit, 1)).alias("kept")), "erased")
    files = written(rows.where(hit).select("__file").distinct(), "files")
    stage = f"{path.rstrip('/')}/_erase/{uuid.uuid4().hex}"
    rows.join(sized(files), "__file", "left_semi").where(~hit).drop("__file").write.partitionBy(*keys).json(f"{stage}/rows")
    files.select(F.col("__file").alias("value")).write.text(f"{stage}/files")
    _finish_erasures(spark, path)
    return counts


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of all files below a directory, without version control, vendor and build directories."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(path)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    return files.where(~F.col("path").rlike(f"/({skipped})/"))


def first_by_id(rows: DataFrame, id_col: str = "id", order: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """The first row of each id in file order; rows without an id all stay."""
    rn = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("rn", rn).where((F.col("rn") == 1) | F.col(id_col).isNull()).drop("rn")


def import_valid(rows: DataFrame) -> DataFrame:
    """Rows of an export that have an id and a task."""
    return rows.where(F.col("id").isNotNull() & F.col("task").isNotNull())


def export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
