"""C# sources written from the driver tables, so that the parser and the binder can be held against SQL.

Regions and nations are interfaces, suppliers classes that implement their nation,
and customers classes that get their nation injected, with a method for each order
that calls a supplier. Every file has comments and strings that look like code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOURCE rows: one solution with a project for each of the namespaces Geo, Trade and Sales."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    suppliers = read("supplier").agg(F.count(F.lit(1)).alias("n"))
    region = read("region").select(F.lit("Geo").alias("project"), _text("/Geo/Region", F.col("r_regionkey"), ".cs").alias("path"), F.lit(0).alias("project_order"), F.col("r_regionkey").cast("int").alias("document_order"), _text("namespace Geo;\n\npublic interface Region", F.col("r_regionkey"), " { } // class Nothing { }\n").alias("content"))
    nation = read("nation").select(
        F.lit("Geo").alias("project"), _text("/Geo/Nation", F.col("n_nationkey"), ".cs").alias("path"), F.lit(0).alias("project_order"), (100 + F.col("n_nationkey")).cast("int").alias("document_order"),
        _text("namespace Geo\n{\n    public interface Nation", F.col("n_nationkey"), " : Region", F.col("n_regionkey"), "\n    {\n        string Name { get; }\n    }\n}\n").alias("content"),
    )
    supplier = read("supplier").select(
        F.lit("Trade").alias("project"), _text("/Trade/Supplier", F.col("s_suppkey"), ".cs").alias("path"), F.lit(1).alias("project_order"), F.col("s_suppkey").cast("int").alias("document_order"),
        _text("using Geo;\nnamespace Trade;\n/* class Hidden : Region0 { } */\n[Serializable]\npublic sealed class Supplier", F.col("s_suppkey"), " : Nation", F.col("s_nationkey"), "\n{\n    public string Name => \"class Fake { }\";\n    public static void Ship(int units, string? note = null) { if (units > 1) { Ship(units - 1); } }\n    private int _stock;\n}\n").alias("content"),
    )
    calls = read("orders").crossJoin(F.broadcast(suppliers)).select("o_custkey", F.struct("o_orderkey", _text("    public void Order", F.col("o_orderkey"), "()\n    {\n        Supplier", F.col("o_orderkey") % F.col("n"), ".Ship(", F.length("o_orderpriority"), ");\n    }\n").alias("t")).alias("m"))
    methods = calls.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["t"]), "").alias("methods"))
    customer = read("customer").join(methods, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.lit("Sales").alias("project"), _text("/Sales/Customer", F.col("c_custkey"), ".cs").alias("path"), F.lit(2).alias("project_order"), F.col("c_custkey").cast("int").alias("document_order"),
        _text("using Geo;\nusing Trade;\nnamespace Sales;\n\npublic class Customer", F.col("c_custkey"), "(Nation", F.col("c_nationkey"), " home)\n{\n    public string Place() => home.Name;\n", F.coalesce("methods", F.lit("")), "}\n").alias("content"),
    )
    rows = region.unionByName(nation).unionByName(supplier).unionByName(customer)
    return rows.withColumn("solution", F.lit("tables"))


#: One file with every kind of declaration; ``@k`` is a nation's key.
RICH = """using System;
namespace Rich.N@k;
[Serializable, Obsolete("n@k")]
public abstract partial class Thing@k<T> : Base@k, IThing, IDisposable where T : class, new()
{
    public const int Max = @k;
    public static readonly string Tag = "t;{";
    private int hidden;
    public Thing@k(int a) { }
    public Thing@k(int a, string b) : base(a) { }
    public event Action Moved, Gone;
    public required string Name { get; private set; } = "x";
    public int Twice => 2;
    internal static async Task<int> Run(ref int x, params string[] rest)
    {
        await Task.Yield();
        return 1;
    }
    void IThing.Clear() { }
    private void Secret() { }
    public enum Color { Red = 1, Green }
}
public readonly record struct Point@k(int X, int Y);
public record Line@k(int From) { public string Note { get; init; } }
public delegate int Fold@k(int a, int b);
interface IThing { int Count { get; set; } void Clear(); }
#if DEBUG
public class Never@k { }
#else
internal static class Always@k { private class Inner { } }
#endif
"""


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one file for each nation."""
    key = F.col("n_nationkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(_text("/Rich/", key, ".cs").alias("path"), F.replace(F.lit(RICH), F.lit("@k"), key).alias("content"))
