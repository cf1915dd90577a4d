"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "asklens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution picks broadcast or sort-merge from measured sizes, splits
    skewed join partitions and merges small ones, so no operator forces a broadcast.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see and that written intermediates go to.

    ``spark.checkpoint.dir`` where the session names one, else this library's own setting ``spark.asklens.dir``. Where driver
    and executors are one machine, a folder of the warehouse will do; on a cluster that may be a local disk, so there one
    of the two has to be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.asklens.dir", None)
    if not named:
        master = spark.conf.get("spark.master", None) or spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_asklens"
    return named.rstrip("/")


_MADE: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark)}/asklens-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediates this process has written; call it when no result reads them any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        count += bool(path.getFileSystem(hadoop).delete(path, True))
    return count


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The result survives lost executors and is computed once however often it is used.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
