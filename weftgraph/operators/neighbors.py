"""Aggregated neighbors, rolled up to declaring types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import model


def rolled(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges but CONTAINS, with both ends and the types they roll up to (src, dst, type, s, d).

    The owner table is joined by shuffle or broadcast as its measured size allows.
    """
    so = owners.select(F.col("member").alias("src"), F.col("owner").alias("so"))
    do = owners.select(F.col("member").alias("dst"), F.col("owner").alias("do"))
    plain = edges.filter("type <> 'CONTAINS'")
    return plain.join(so, "src", "left").join(do, "dst", "left").select("src", "dst", "type", F.coalesce("so", "src").alias("s"), F.coalesce("do", "dst").alias("d"))


def all_types(edges: DataFrame) -> DataFrame:
    """(node_id, neighbor_id, direction, edge_kind, n) of every type at once. Both directions come from one grouping."""
    sums = rolled(edges, model.owners(edges)).filter("s <> d").groupBy("s", "d", "type").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("s").alias("node_id"), F.col("d").alias("neighbor_id"), F.lit("out").alias("direction")), F.struct(F.col("d").alias("node_id"), F.col("s").alias("neighbor_id"), F.lit("in").alias("direction")))
    return sums.select(F.explode(both).alias("x"), F.col("type").alias("edge_kind"), "n").select("x.*", "edge_kind", "n")


def of(edges: DataFrame, node: str) -> DataFrame:
    """(neighbor_id, direction, edge_kind, n, place) of one node: with its members if it is a type, alone if it is a member.

    place orders the entries as they are met: out before in, the node's own edges
    before those of its members, which come in the order they are contained, and
    edges in encounter order; it is the same for all kinds of one entry. Only edges
    that touch the node or its members are read beyond the CONTAINS edges.
    """
    seq = F.col("seq") if "seq" in edges.columns else F.struct("src", "dst", "type")
    contains = edges.filter("type = 'CONTAINS'")
    inner = contains.filter(F.col("src") == node).select(F.col("dst").alias("id")).distinct()
    held = contains.join(inner, F.col("dst") == F.col("id"), "left_semi").withColumn("s", seq).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("s", "src")).alias("x"))
    holder = contains.filter(F.col("dst") == node).select(F.lit(True).alias("is_member")).limit(1)
    mine = held.filter(F.col("x.src") == node).select("id", F.lit(1).alias("turn"), F.col("x.s").alias("at"))
    mine = mine.join(F.broadcast(holder), F.lit(True), "left_anti")  # one row at most
    own = edges.sparkSession.range(1).select(F.lit(node).alias("id"), F.lit(0).alias("turn"), F.lit(None).alias("at"))
    scope = own.unionByName(mine)
    plain = edges.filter("type <> 'CONTAINS'")
    out = None
    for direction, near, far in (("out", "src", "dst"), ("in", "dst", "src")):
        rows = plain.withColumn("s", seq).select(F.col(near).alias("id"), F.col(far).alias("far"), "type", "s").join(scope, "id")
        part = rows.join(scope.select(F.col("id").alias("far")), "far", "left_anti").select("far", F.lit(direction).alias("direction"), F.col("type").alias("edge_kind"), "turn", "at", "s")
        out = part if out is None else out.unionByName(part)
    touched = out.select(F.col("far").alias("member")).distinct()
    roll = contains.join(touched, F.col("dst") == F.col("member"), "left_semi").withColumn("s", seq).groupBy(F.col("dst").alias("far")).agg(F.min(F.struct("s", "src")).alias("x")).select("far", F.col("x.src").alias("owner"))
    place = F.struct((F.col("direction") == "in").alias("entering"), "turn", "at", "s")
    kinds = out.join(roll, "far", "left").groupBy(F.coalesce("owner", "far").alias("neighbor_id"), "direction", "edge_kind").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return kinds.withColumn("place", F.min("first").over(Window.partitionBy("neighbor_id", "direction"))).drop("first")


def listed(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(id, kind, direction, edge_kinds, file, place): one row per neighbor and direction, with the counts by kind as a map and the node's own columns."""
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("edge_kind", F.col("n").cast("int")))))
    entries = of(edges, node).groupBy(F.col("neighbor_id").alias("id"), "direction", "place").agg(counts.alias("edge_kinds"))
    return entries.join(nodes.select("id", "kind", "file"), "id", "left").select("id", "kind", "direction", "edge_kinds", "file", "place")


def implemented(edges: DataFrame, node: str) -> DataFrame:
    """(id, place) of the interfaces that a node implements, in order."""
    return _along(edges, "src", "dst", node)


def implementors(edges: DataFrame, node: str) -> DataFrame:
    """(id, place) of what implements a node, in order."""
    return _along(edges, "dst", "src", node)


def _along(edges: DataFrame, near: str, far: str, node: str) -> DataFrame:
    seq = F.col("seq") if "seq" in edges.columns else F.struct("src", "dst", "type")
    return edges.filter((F.col("type") == "IMPLEMENTS") & (F.col(near) == node)).select(F.col(far).alias("id"), seq.alias("place"))
