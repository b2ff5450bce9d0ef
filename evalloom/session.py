"""Session helpers: local sessions for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import hashlib
import io
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evalloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where a local session has none."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"evalloom-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", folder)
    _delete_at_end(spark, folder)
    return folder


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM delete the folder when it ends."""
    fs, target = _file_system(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder of its own in the shared folder, for tables that the run writes and reads; it goes with the application."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _delete_at_end(spark, folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that no earlier shuffle is needed again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    if not getattr(sc, "_evalloom_checkpoints", False):
        _delete_at_end(df.sparkSession, sc.getCheckpointDir())  # Spark's own folder, unique to this application
        sc._evalloom_checkpoints = True
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, by a zip file in the shared folder; done once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_evalloom_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.md5(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    path = f"{scratch(spark, 'package')}/evalloom-{mark}.zip"
    write_bytes(spark, path, data.getvalue())
    fs, target = _file_system(spark, path)
    sc.addPyFile(fs.makeQualified(target).toString())
    sc._evalloom_shipped = True


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there, for loops.

    A checkpoint keeps the constraints that the optimizer inferred, and in a loop of joins they double every few rounds; a table that is
    read has none. See forget; a table that is never forgotten goes with the application.
    """
    path = scratch(df.sparkSession, "stored")
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._evalloom_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes the table behind a stored frame that is not read any more; does nothing for other frames."""
    path = getattr(df, "_evalloom_path", None)
    if path:
        fs, target = _file_system(df.sparkSession, path)
        fs.delete(target, True)
        fs.cancelDeleteOnExit(target)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in the shared folder; written under another name first, so that it is there whole or not at all."""
    fs, target = _file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part)
    stream.write(bytearray(data))
    stream.close()
    if not fs.rename(part, target):
        fs.delete(part, False)  # another run has written it


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file, null if there is none."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
