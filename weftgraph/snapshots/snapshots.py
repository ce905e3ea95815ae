"""Incremental maintenance: staging, freshness and coverage of document sets."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("project", "path")


def prepare(df: DataFrame) -> str:
    """The shared checkpoint folder of the session. A local session without one gets a temporary folder; a cluster must name one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a columnar table and read it again: lineage ends there, and later reads take the columns that they need."""
    path = f"{prepare(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` wrote, once nothing reads them any more."""
    for table in tables:
        if "_settled_at" in vars(table):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._settled_at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: it does once the driver's JVM finds them unused."""
    gc.collect()
    spark._jvm.System.gc()


def stage(documents: DataFrame, removed: DataFrame, upserts: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The next snapshot: documents without the removed and replaced ones, and the new rows."""
    keys = removed.select(*key).unionByName(upserts.select(*key)).distinct()
    return documents.join(keys, list(key), "left_anti").unionByName(upserts)


def freshness(stored: DataFrame, current: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, status): added, removed or changed, by checksum."""
    a = stored.select(*key, F.col("checksum").alias("was"), F.lit(True).alias("had"))
    b = current.select(*key, F.col("checksum").alias("is"), F.lit(True).alias("has"))
    both = a.join(b, list(key), "full_outer")
    status = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select(*key, status.alias("status")).filter("status is not null")
