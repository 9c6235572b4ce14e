"""Session helpers: a ready-made local session, the package for the executors, lineage cuts in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to Python, and the setting that bounds them.
BATCH_BYTES, _BATCH_LIMIT = 6 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cpus: str = "8", app: str = "portlake") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else the context's checkpoint folder.

    Only a session inside one JVM (`local[...]`) may do without either; it gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; `release` deletes what was written there."""
    path = os.path.join(shared_folder(spark), "portlake-" + uuid.uuid4().hex)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the scratch paths of this application, once the frames that read them are done with."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that no installation is needed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "portlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of some `BATCH_BYTES`, unless the session has a limit of its own.

    Without it 10,000 rows are one batch, however long their texts, and each task holds it in the JVM, outside the heap, and in
    its worker.  All rows still go, only in more batches; a longer row is a batch by itself.
    """
    if _BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    What follows no longer depends on the plan that made the rows, so it stays the same rows when an
    executor is lost, and a frame used in several branches is computed once.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
