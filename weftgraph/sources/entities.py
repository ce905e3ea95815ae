"""The entity graph: driver tables read as a typed property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ids(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, file, name): one row per entity; file is the table's path."""
    parts = (("region", "r", "R", "Interface", "regionkey"), ("nation", "n", "N", "Interface", "nationkey"), ("supplier", "s", "S", "Class", "suppkey"), ("customer", "c", "C", "Class", "custkey"), ("part", "p", "P", "Class", "partkey"))
    out = None
    for name, p, letter, kind, key in parts:
        rows = table(spark, sf_dir, name).select(_ids(letter, f"{p}_{key}").alias("id"), F.lit(kind).alias("kind"), F.lit(f"/{name}").alias("file"), F.col(f"{p}_name").alias("name"))
        out = rows if out is None else out.unionByName(rows)
    orders = table(spark, sf_dir, "orders").select(_ids("O", "o_orderkey").alias("id"), F.lit("Method").alias("kind"), F.lit("/orders").alias("file"), F.lit(None).cast("string").alias("name"))
    return out.unionByName(orders)


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst, type) of the entity graph."""
    read = lambda name: table(spark, sf_dir, name)
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    by_flag = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "REFERENCES").otherwise("RETURNS")
    by_status = F.when(F.col("l_linestatus") == "O", "CALLS").otherwise("REFERENCES")
    plain = (
        edge(read("nation"), _ids("N", "n_nationkey"), _ids("R", "n_regionkey"), "INHERITS")
        .unionByName(edge(read("supplier"), _ids("S", "s_suppkey"), _ids("N", "s_nationkey"), "IMPLEMENTS"))
        .unionByName(edge(read("customer"), _ids("C", "c_custkey"), _ids("N", "c_nationkey"), "INJECTS"))
        .unionByName(edge(read("orders"), _ids("C", "o_custkey"), _ids("O", "o_orderkey"), "CONTAINS"))
    )
    ends = F.array(F.struct(_ids("P", "l_partkey").alias("dst"), by_flag.alias("type")), F.struct(_ids("S", "l_suppkey").alias("dst"), by_status.alias("type")))
    items = lines.select(_ids("O", "l_orderkey").alias("src"), F.explode(ends).alias("e")).select("src", "e.dst", "e.type")
    return plain.unionByName(items).distinct()
