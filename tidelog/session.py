"""A session with the settings the library expects, and the table loader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Stateful processors need a store with column families; it also keeps large state off the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(app: str = "tidelog", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; any setting can be overridden.  The master
    and the sizes of executors and shuffles belong to the cluster, so none are set here."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A local one is made only where none is set
    and driver and executors are one process; on a cluster a missing setting is an error."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        here = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", here)
    return here.rstrip("/")


def saved_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables go."""
    return f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and
    survives the loss of any executor."""
    path = f"{saved_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    """The path and the file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, store = _file(spark, path)
    store.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _file(spark, path)
    return store.exists(at)


def stamp(spark: SparkSession, folder: str, name: str) -> tuple:
    """What tells one state of a table's files from another: their names, lengths and times."""
    at, store = _file(spark, f"{folder}/{name}.parquet")
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(at))


def drop_saved(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them are written."""
    delete(spark, saved_dir(spark))
