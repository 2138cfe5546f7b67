"""Session helpers: a tuned local session for tests, and durable work tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from keyspan.model import KeyspanError

_LOCAL_DIR: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("keyspan")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KEYSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Wide projections are then compiled in pieces the JVM can optimise.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir`` of the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise KeyspanError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="keyspan-")
    return _LOCAL_DIR[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{work_dir(spark)}/keyspan/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drop_work_tables(spark: SparkSession) -> bool:
    """Delete all work tables of this application. DataFrames that read them become unusable."""
    return delete_path(spark, f"{work_dir(spark)}/keyspan/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a second pass must see exactly the rows of the first one (sampled range bounds,
    staged loads). The written table survives the loss of any executor and cuts the lineage.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete one path this library wrote (an old table version or a work table)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(hadoop, True)


def rename_path(spark: SparkSession, src: str, dst: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    if not source.getFileSystem(conf).rename(source, target):
        raise KeyspanError(f"could not move {src} to {dst}")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def file_names(spark: SparkSession, path: str) -> set[str]:
    """Names of the files directly in a folder; none if it is not there."""
    fs, name = _file(spark, path)
    return {status.getPath().getName() for status in fs.listStatus(name)} if fs.exists(name) else set()


def _file(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, replacing one that is there."""
    fs, name = _file(spark, path)
    stream = fs.create(name, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None if it is not there."""
    fs, name = _file(spark, path)
    if not fs.exists(name):
        return None
    stream = fs.open(name)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
