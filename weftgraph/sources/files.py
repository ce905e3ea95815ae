"""Source files: scans, guarded reads and contracts of C# files."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftgraph.errors import AnalysisError
from weftgraph.functions import text
from weftgraph.sources import csharp, paths

PARAMETER = "struct<type:string,name:string>"
METHOD = f"struct<name:string,access:string,return_type:string,start_line:int,end_line:int,parameters:array<{PARAMETER}>,attributes:array<string>,generic_constraints:array<string>,modifiers:array<string>>"
PROPERTY = "struct<name:string,type:string,access:string,is_required:boolean,accessors:string>"
TYPE = f"struct<name:string,kind:string,access:string,base:string,implements:array<string>,attributes:array<string>,constructor_dependencies:array<{PARAMETER}>,methods:array<{METHOD}>,properties:array<{PROPERTY}>,members:array<string>,is_partial:boolean,generic_constraints:array<string>,events:array<{PROPERTY}>>"
FILE = f"file string, namespace string, namespaces array<string>, usings array<string>, types array<{TYPE}>, parse_errors array<string>"
#: Most files that one context takes.
MOST_FILES = 15


def scan(spark: SparkSession, folder: str | list[str], before: str | None = None, pattern: str = "*.[cC][sS]", sources: bool = True) -> DataFrame:
    """(path, checksum, content) of the C# documents below folders, or with ``sources`` unset of all files that the pattern names; ``before`` (a timestamp) leaves out files that changed since.

    Spark's readers give no row for files of no bytes; these are listed and added.
    """
    folders = [folder] if isinstance(folder, str) else folder
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if before:
        reader = reader.option("modifiedBefore", before)
    rows = reader.load(folders).select("path", F.col("content").cast("binary").alias("content"))
    empty = [x.path for f in folders for x in paths.below(spark, f) if not x.size and fnmatch.fnmatchcase(x.path.rpartition("/")[2], pattern) and (not before or x.modified < before)]
    if empty:
        rows = rows.unionByName(spark.createDataFrame([(p, b"") for p in empty], "path string, content binary"))
    rows = rows.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    kept = rows.filter(text.is_source(F.col("path"))) if sources else rows
    return kept.select("path", text.checksum(F.col("content")).alias("checksum"), F.col("content").cast("string").alias("content"))


def candidates(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path) of all C# documents below the folders, each once, in order of their bytes."""
    rows = [(p,) for f in folders for p in (x.path for x in paths.below(spark, f)) if p.lower().endswith(".cs")]
    listed = spark.createDataFrame(rows, "path string")
    return listed.filter(text.is_source(F.col("path"))).distinct().orderBy("path")


def listed(spark: SparkSession, wanted: list[str], most: int = MOST_FILES) -> DataFrame:
    """(pos, path, content, error) of a short list of paths, repeated entries included. error: file_not_found, not_a_cs_file or read_failed, in that order."""
    guarded(spark, wanted, most, missing=False)
    states = [(i, p, *paths.state(spark, p)) for i, p in enumerate(wanted)]
    errors = [(i, p, p.lower(), "file_not_found" if not there else "not_a_cs_file" if not p.lower().endswith(".cs") else None if readable else "read_failed") for i, p, there, readable in states]
    rows = spark.createDataFrame(errors, "pos int, path string, key string, error string")
    good = sorted({p for _, p, _, e in errors if e is None})
    if not good:
        return rows.select("pos", "path", F.lit(None).cast("string").alias("content"), "error")
    read = spark.read.format("binaryFile").load(good).select(F.lower(F.regexp_replace("path", "^file:/+", "/")).alias("key"), F.col("content").cast("string").alias("content")).dropDuplicates(["key"])
    found = rows.withColumn("key", F.regexp_replace("key", "^file:/+", "/")).join(F.broadcast(read), "key", "left")  # at most ``most`` files
    return found.select("pos", "path", F.when(F.col("error").isNull(), F.coalesce("content", F.lit(""))).alias("content"), "error")


def guarded(spark: SparkSession, wanted: list[str], most: int = MOST_FILES, missing: bool = True) -> list[str]:
    """The list itself, if it isn't too long and, with ``missing``, all of its files exist; AnalysisError names the first that doesn't."""
    if len(wanted) > most:
        raise AnalysisError("too_many_files", f"{len(wanted)} files, {most} are allowed")
    for p in wanted if missing else ():
        if not paths.state(spark, p)[0]:
            raise AnalysisError("file_not_found", f"no file {p}", p)
    return wanted


def contracts(files: DataFrame) -> DataFrame:
    """The contract of each file of (path, content). One narrow pass; a file is parsed alone."""
    schema = StructType.fromDDL(FILE)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([csharp.inspect(r["path"], r["content"]) for r in batch.to_pylist()], arrow)

    return files.select("path", "content").mapInArrow(run, FILE)


def type_rows(contract_rows: DataFrame) -> DataFrame:
    """One row per type, in order of declaration."""
    return contract_rows.select("file", "namespace", F.posexplode("types").alias("pos", "t")).select("file", "namespace", "pos", "t.*")
