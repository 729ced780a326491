"""What a Spark session needs before the library's jobs run on its executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders that new_folder has named.
_FOLDERS: list[str] = []
#: Those that this thread has named since a call of `settled` began, the innermost last.
_OPEN = threading.local()

#: Spark's setting by which a finished job's shuffle files go at once, not when the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of an Arrow batch on its way to Python: texts are long, and both sides hold a batch or two for each task.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each Spark context, and bound the Arrow batches."""
    context = spark.sparkContext
    if not getattr(context, "_offerloom_shipped", False):
        for key, most in ARROW_BATCH.items():
            spark.conf.set(key, str(most))
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "offerloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._offerloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    if open_ := getattr(_OPEN, "calls", None):
        open_[-1].append(folder)
    return folder


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors. What was shuffled for it leaves the disks
    as soon as it is written, as nothing reads that again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """make() as a shared table. The tables that it wrote on its way are removed: it must not hand them on by other ways than its result."""
    calls = _OPEN.calls = getattr(_OPEN, "calls", [])
    calls.append([])
    try:
        rows = make()
        made = list(calls[-1])
        out = shared_table(rows, tag)
    finally:
        last = calls.pop()
        if calls:
            calls[-1] += last
    _remove(spark, made)
    return out


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so it is never sent whole through the driver: files of a shared table are small beside its
    rows, as equal texts are stored once, and Spark would go by the files."""
    return df.hint("merge")


def spread(rows: DataFrame, *keys: str, mb: int = 4) -> DataFrame:
    """Deal rows out by keys to so many tasks that each has about `mb` MB of the files they come from: what a task sorts or groups then
    stays as large when the input grows, whatever the number of shuffle partitions."""
    spark, size = rows.sparkSession, 0
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for name in rows.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(hadoop).getFileStatus(path).getLen()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, size // (mb << 20)), *keys)


def forget_tables(spark: SparkSession) -> int:
    """Remove the tables that jobs of this process have left in the shared folder; for sessions that run many, once results are stored."""
    gone = _remove(spark, _FOLDERS)
    _FOLDERS.clear()
    return gone


def _remove(spark: SparkSession, folders: list[str]) -> int:
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(folder) for folder in folders]
    return sum([path.getFileSystem(hadoop).delete(path, True) for path in paths])
