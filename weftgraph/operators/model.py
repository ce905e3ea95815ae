"""Derived tables of a snapshot: nodes, edges and owners from documents.

A document row is (project, path, checksum, project_order, document_order,
nodes, edges, namespaces). Encounter order is data: a node or edge is placed by
(project_order, document_order, position), which orders as a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<id:string,kind:string,file:string,name:string,namespace:string>"
EDGE = f"struct<source:{NODE},target:{NODE},type:string>"
DOCUMENT = f"project string, path string, checksum string, project_order int, document_order int, nodes array<{NODE}>, edges array<{EDGE}>, namespaces array<string>"


def _place(position: str, sub: int | None = None) -> Column:
    parts = [F.col("project_order"), F.col("document_order"), F.col("project"), F.col("path"), F.col(position)]
    return F.struct(*parts, *([F.lit(sub).alias("sub")] if sub is not None else []))


def edges(documents: DataFrame) -> DataFrame:
    """(src, dst, type, seq): each triple once, placed at its first mention."""
    rows = documents.select("project_order", "document_order", "project", "path", F.posexplode("edges").alias("pos", "e"))
    return rows.groupBy(F.col("e.source.id").alias("src"), F.col("e.target.id").alias("dst"), F.col("e.type").alias("type")).agg(F.min(_place("pos")).alias("seq"))


def nodes(documents: DataFrame) -> DataFrame:
    """(id, kind, file, name, namespace, is_reference, seq): a declaration beats any reference; among equals the first wins."""
    own = documents.select("project_order", "document_order", "project", "path", F.posexplode("nodes").alias("pos", "n"))
    declared = own.select(F.struct(F.lit(False).alias("is_reference"), _place("pos", 0).alias("seq"), F.col("n").alias("n")).alias("x"))
    first = declared.unionByName(references(documents)).groupBy(F.col("x.n.id").alias("id")).agg(F.min("x").alias("x"))
    return first.select("id", "x.n.kind", "x.n.file", "x.n.name", "x.n.namespace", "x.is_reference", "x.seq")


def references(documents: DataFrame) -> DataFrame:
    """(x: is_reference, seq, n) of the ends of edges, without those that their own document declares: a declaration beats them anyway, and most ends are such."""
    used = documents.select("project_order", "document_order", "project", "path", F.col("nodes.id").alias("own"), F.posexplode("edges").alias("pos", "e"))
    ends = used.select("own", F.explode(F.array(*[F.struct(F.lit(True).alias("is_reference"), _place("pos", i).alias("seq"), F.col(f"e.{end}").alias("n")) for i, end in enumerate(("source", "target"))])).alias("x"))
    return ends.filter(~F.coalesce(F.array_contains("own", F.col("x.n.id")), F.lit(False))).select("x")


def owners(edge_rows: DataFrame) -> DataFrame:
    """(member, owner): the source of a member's first CONTAINS edge. Edges without a seq column are taken in order of their source."""
    contains = edge_rows.filter("type = 'CONTAINS'")
    order = F.col("seq") if "seq" in edge_rows.columns else F.col("src")
    return contains.groupBy(F.col("dst").alias("member")).agg(F.min(F.struct(order.alias("o"), "src")).alias("x")).select("member", F.col("x.src").alias("owner"))


def members(edge_rows: DataFrame, owner_rows: DataFrame) -> DataFrame:
    """(owner, member): CONTAINS edges whose source is the member's owner."""
    return edge_rows.filter("type = 'CONTAINS'").select(F.col("src").alias("owner"), F.col("dst").alias("member")).join(owner_rows, ["owner", "member"], "left_semi")


def node(node_rows: DataFrame, id: str) -> DataFrame:
    """The row of one node, if there is one."""
    return node_rows.filter(F.col("id") == id)


def coverage(documents: DataFrame) -> DataFrame:
    """(node_count, edge_count): distinct counts as one row."""
    return nodes(documents).agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges(documents).agg(F.count(F.lit(1)).alias("edge_count")))


def loaded(rows: DataFrame, by: str) -> DataFrame:
    """Coverage of documents by project. rows: (by, loaded, supported), one row per document; gives total, loaded, skipped, unsupported and status."""
    count = lambda c: F.count(F.when(c, 1))
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), count(F.col("loaded")).alias("loaded"), count(~F.col("loaded")).alias("skipped"), count(~F.col("supported")).alias("unsupported"))
    return sums.withColumn("status", F.when(F.col("loaded") == 0, "empty").when(F.col("loaded") < F.col("total"), "partial").otherwise("complete"))


def first_largest(rows: DataFrame, group: str, size: str, order: list[str], keep: list[str]) -> DataFrame:
    """Of each group the row of the greatest size, the first in order among equals: how a constructor is chosen. One aggregation, no window."""
    best = rows.groupBy(group).agg(F.min(F.struct((-F.col(size)).alias("q"), *order)).alias("x"))
    return best.select(group, *[F.col(f"x.{c}") for c in keep], (-F.col("x.q")).alias(size))
