"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor then costs a
re-read, never a recomputation. Only a local session that has no such folder (a test) gets one of its own.
All tables of an application lie in one folder, ``pagegrain-<application id>``; what was built from them reads
them until its last action, so it is the caller who removes them, with ``clean_up`` or a rule on the folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh temporary folder if a local session names none."""
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_KEY, path)
    return path.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pagegrain-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stash``, with the rows of a key in one of some buckets, so that a later join or grouping by it reads them where they are.

    Writing deals no rows: each task appends to the buckets of its keys. The catalog holds no entry afterwards.
    """
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def clean_up(spark: SparkSession) -> None:
    """Removes all tables that this application wrote; results built from them can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
