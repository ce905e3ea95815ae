"""The stored graph: revisions as Parquet folders and a pointer to the current one.

A revision is written whole before the pointer moves, by a rename, so readers
see the old or the new graph and a failed write leaves the old one.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.errors import AnalysisError
from weftgraph.operators import model
from weftgraph.sources import paths

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf)


def revision(spark: SparkSession, folder: str) -> str | None:
    """The current revision's name; None before the first save."""
    at, fs = _fs(spark, f"{folder}/{POINTER}")
    return spark.read.text(f"{folder}/{POINTER}").first()["value"] if fs.exists(at) else None


def location(solution_path: str) -> str:
    """The folder of a solution's graph: beside the solution, named after it."""
    folder, name = posixpath.split(solution_path)
    return f"{folder}/.weftgraph/{name.removesuffix('.sln')}.graph"


def save(documents: DataFrame, folder: str, baseline: dict | None = None) -> str:
    """Writes the documents, in order and parted by project, and the baseline as a new revision and makes it the current one. Gives its name."""
    spark, name = documents.sparkSession, uuid.uuid4().hex
    ordered = documents.repartitionByRange("project_order", "document_order", "project", "path").sortWithinPartitions("project_order", "document_order", "project", "path")
    ordered.write.parquet(f"{folder}/rev-{name}/documents")
    spark.createDataFrame([(json.dumps(baseline or {}),)], "value string").coalesce(1).write.text(f"{folder}/rev-{name}/baseline")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    temp, fs = _fs(spark, f"{folder}/.{POINTER}-{name}")
    goal, _ = _fs(spark, f"{folder}/{POINTER}")
    try:
        out = fs.create(temp, True)
        out.write(bytearray(name.encode()))
        out.close()
        over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(temp, goal, over)
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)
    return name


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the current revision, with a fixed schema; the empty graph before the first save. A revision stays as it is, so a reader keeps what it has loaded."""
    name = revision(spark, folder)
    if name is None:
        return spark.createDataFrame([], model.DOCUMENT)
    return spark.read.schema(model.DOCUMENT).parquet(f"{folder}/rev-{name}/documents")


def baseline(spark: SparkSession, folder: str) -> dict:
    """The baseline of the current revision; empty before the first save."""
    name = revision(spark, folder)
    return json.loads(spark.read.text(f"{folder}/rev-{name}/baseline").first()["value"]) if name else {}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents from their JSON form, one text with ``documents`` and ``baseline``; without documents, the empty graph. A malformed text raises AnalysisError, and nothing changes."""
    content = paths.text(spark, path) or ""
    try:
        found = json.loads(content)
        rows = found.get("documents") or []
    except (json.JSONDecodeError, AttributeError) as e:
        raise AnalysisError("graph_load", f"{path} can't be read: {e}", path) from e
    return spark.createDataFrame(rows, model.DOCUMENT) if rows else spark.createDataFrame([], model.DOCUMENT)


class Cache:
    """Loaded graphs by folder; a graph is loaded again only if its revision has changed."""

    def __init__(self):
        self.held: dict[str, tuple[str | None, DataFrame]] = {}

    def load(self, spark: SparkSession, folder: str) -> DataFrame:
        name = revision(spark, folder)
        if folder not in self.held or self.held[folder][0] != name:
            self.held[folder] = (name, load(spark, folder))
        return self.held[folder][1]


def as_json(rows: DataFrame) -> DataFrame:
    """One compact JSON text per row; nulls are left out, empty arrays stay."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("json"))


def status_line(status: str, nodes: int, edges: int, coverage: str) -> str:
    return f"Scan {status}. {nodes} nodes, {edges} edges. Coverage: {coverage}"
