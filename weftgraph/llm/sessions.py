"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to Python (about; a longer row goes alone).
BATCH_BYTES = 16 << 20
_BATCH, _DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Tables written by this process that haven't been dropped.
_written: list[str] = []
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Give Python workers the package path, and a checkpoint folder where the session names none.

    ``spark.checkpoint.dir`` is read first: on a cluster it names a folder that
    every executor shares. Where it is unset, a local session gets a temporary
    folder; a cluster has no folder to fall back to, so that is an error. Arrow
    batches get a smaller bound of bytes, unless the session names one: many long
    texts in one batch would be held several times over.
    """
    if spark.conf.get(_BATCH) == _DEFAULT_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as a columnar table, and read it again: lineage ends there.

    Later reads take the columns that they need, put small files together into few
    tasks, and know the table's size, by which Spark may broadcast it.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more. Other tables are left alone."""
    for table in tables:
        if "_stored_at" in vars(table):
            delete(table.sparkSession, table._stored_at)
            if table._stored_at in _written:
                _written.remove(table._stored_at)


def kept() -> int:
    """How many stored tables there are; with ``sweep``, those that a step needed can be deleted after it."""
    return len(_written)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the tables stored since ``kept`` gave ``since``, once what was computed from them is written elsewhere."""
    while len(_written) > since:
        delete(spark, _written.pop())


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: it does once the driver's JVM finds them unused."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(name: str, columns: list[str]) -> str:
    """``name``, or if a column has it, the next like it that none has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
