"""The Spark session that jobs and tests use when none is given, and tables that a job writes for itself."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tidewell", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}  # the temporary folder of each local session that names none
_WRITTEN: list[tuple[SparkSession, str]] = []  # tables that go when the job ends


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that the cluster names for checkpoints, which driver and executors share."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidewell-"))
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and read back from a table, which cuts its lineage. Results may read the table for as long as the job lasts; it goes at its end, or by `release`."""
    spark = df.sparkSession
    path = new_path(spark, "settled")
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that `settled` has written so far. For a job that has used all results that read them."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(release)
