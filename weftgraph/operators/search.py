"""Ranked name search over files and their methods."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.errors import AnalysisError
from weftgraph.operators import model
from weftgraph.snapshots.snapshots import settle

LIMIT, LEAST = 50, 3


def terms(queries: list[str | None]) -> list[str]:
    """Trimmed terms; an error if there is none or one is under three UTF-16 units."""
    out = [(q or "").strip() for q in queries]
    if not out or any(len(t.encode("utf-16-le")) // 2 < LEAST for t in out):
        raise AnalysisError("invalid_query", f"every term needs {LEAST} characters or more")
    return out


def stem(path: str):
    """File name without its last extension."""
    return F.regexp_extract(F.col(path), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def search(candidates: DataFrame, queries: list[str | None], limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` matches (file, is_method, method_seq, rn, truncated), with the columns of ``keep``.

    candidates: (file, file_seq, is_method, method_seq, name). Exact matches of
    all files come before partial ones; within a file its name comes before its
    methods. Only limit + 1 rows are ordered together.
    """
    wanted = [t.lower() for t in terms(queries)]
    low = F.lower("name")
    exact = F.lit(False)
    part = F.lit(False)
    for t in wanted:
        exact, part = exact | (low == t), part | low.contains(t)
    hits = candidates.filter(part).withColumn("pass", F.when(exact, 0).otherwise(1))
    order = ["pass", "file_seq", "is_method", "method_seq"]
    first = hits.orderBy(*order).limit(limit + 1)
    ranked = first.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.filter(F.col("rn") <= limit).select("file", "is_method", "method_seq", "rn", *keep, (F.col("total") > limit).alias("truncated"))


def candidates(documents: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What a graph's documents offer to a search: (file, file_seq, is_method, method_seq, name, node_id).

    Files come in the order of documents, then those that only nodes name, each once
    whatever projects it is in; methods in the order of nodes. found: the documents'
    nodes, where they are known.
    """
    found = model.nodes(documents) if found is None else found
    paths = documents.select(F.col("path").alias("file"), F.struct(F.lit(0).alias("late"), "project_order", "document_order", "project", "path").alias("s"))
    place = F.col("seq")
    named = found.filter("file is not null").select("file", F.struct(F.lit(1).alias("late"), place.getField("project_order").alias("project_order"), place.getField("document_order").alias("document_order"), place.getField("project").alias("project"), place.getField("path").alias("path")).alias("s"))
    files = paths.unionByName(named).groupBy("file").agg(F.min("s").alias("file_seq"))
    own = files.select("file", "file_seq", F.lit(0).alias("is_method"), F.lit(None).alias("method_seq"), stem("file").alias("name"), F.lit(None).cast("string").alias("node_id"))
    methods = found.filter("kind = 'Method' and file is not null and name is not null").select("file", F.struct("is_reference", "seq").alias("method_seq"), "name", F.col("id").alias("node_id"))
    return methods.join(files, "file").select("file", "file_seq", F.lit(1).alias("is_method"), "method_seq", "name", "node_id").unionByName(own)


def namespaces(documents: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(file, namespaces): of each file all its namespaces over documents and nodes, each once, in order. found: the documents' nodes, where they are known."""
    of_documents = documents.select(F.col("path").alias("file"), F.struct(F.lit(0).alias("late"), "project_order", "document_order", "project").alias("s"), F.posexplode("namespaces").alias("pos", "name"))
    placed = (model.nodes(documents) if found is None else found).filter("namespace is not null and file is not null")
    of_nodes = placed.select("file", F.struct(F.lit(1).alias("late"), F.col("seq.project_order").alias("project_order"), F.col("seq.document_order").alias("document_order"), F.col("seq.project").alias("project")).alias("s"), F.col("seq.pos").alias("pos"), F.col("namespace").alias("name"))
    first = of_documents.unionByName(of_nodes).groupBy("file", "name").agg(F.min(F.struct("s", "pos")).alias("at"))
    return first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("x")).select("file", F.col("x.name").alias("namespaces"))


def grouped(documents: DataFrame, queries: list[str | None], limit: int = LIMIT) -> DataFrame:
    """(rank, file, namespaces, file_matched, methods, truncated): the matches by file, each file where its first match is. At most ``limit`` matches come in, so at most as many files."""
    found = settle(model.nodes(documents))  # read three times
    hits = search(candidates(documents, found), queries, limit, ("name", "node_id"))
    method = F.when(F.col("is_method") == 1, F.struct("rn", "name", "node_id"))
    by_file = hits.groupBy("file").agg(F.min("rn").alias("first"), (F.max(F.col("is_method") == 0)).alias("file_matched"), F.sort_array(F.collect_list(method)).alias("m"), F.max("truncated").alias("truncated"))
    out = by_file.join(namespaces(documents, found), "file", "left").withColumn("rank", F.row_number().over(Window.orderBy("first")) - 1)
    return out.select(F.col("rank").cast("long").alias("rank"), "file", F.coalesce("namespaces", F.array().cast("array<string>")).alias("namespaces"), "file_matched", F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["node_id"].alias("node_id"))).alias("methods"), "truncated")
