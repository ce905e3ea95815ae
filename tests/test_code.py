"""Edges from code and context views, on sources of our own."""

import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.operators import context, extract, model, traverse
from weftgraph.sources import binder, facts

SHOP = """
using System.Collections.Generic;
namespace Shop;
public interface IStore<T> { T Get(int id); }
public interface IClock { int Now { get; } }
public enum Mode { Fast, Slow }
public delegate int Fold(int a, int b);
public class Item { public decimal Price { get; set; } public string Name { get; set; } = ""; }
public readonly record struct Point(int X, int Y);
public record Line(Point From, Point To) : Shape { }
public abstract record Shape;
public class Store<T> : IStore<T> where T : class { public T Get(int id) => null; }
public static class Tools
{
    public static void Touch<T>(this T value) { }
    public static void Run() { }
    public static int Size(this Item[] items) => items.Length;
}
public class Base { protected readonly IClock clock; public Base(IClock clock) { this.clock = clock; } public virtual void Go() { Tools.Run(); } }
public class Cart(IStore<Item> store, List<Point> points, Mode mode) : Base(null), System.IDisposable
{
    private readonly Item first = new Item { Price = 1, Name = "x" };
    public Item[] Items { get { Tools.Run(); return []; } }
    public Item Best => store.Get(1);
    public Point? Where { get; } = new Point(1, 2);
    public decimal Total(IEnumerable<Item> items, params int[] rest)
    {
        var best = store.Get(2);
        best.Touch();
        decimal sum = best.Price;
        foreach (var i in Items) { sum += i.Price; }
        int Inner(int k) => k + 1;
        Inner(3);
        System.Func<Item, string> naming = Describe;
        Pick(1); Pick("a"); this.Pick(1, 2);
        clock.Now.ToString();
        if (items is Line { From: var p } || items is not Store<Item>) { return 0; }
        switch (sum) { case 1: break; default: break; }
        object t = typeof(IStore<>);
        return sum switch { 0 => new Item().Price, _ => 2 };
    }
    private static string Describe(Item item) => $"{item}";
    void Pick(int a) { }
    void Pick(string a) { }
    void Pick(int a, int b) { }
    public override void Go() { base.Go(); Items.Size(); }
    public class Nested { public Cart Owner; }
}
"""


def bound(**files):
    found = [facts.Facts(f"/{name}.cs", text) for name, text in files.items()]
    symbols = binder.Symbols(found)
    out = {f.path[1:-3]: binder.extract(f, symbols) for f in found}
    edges = [(e["source"]["id"], e["type"], e["target"]["id"]) for r in out.values() for e in r["edges"]]
    return out, edges


def test_declarations_give_nodes():
    out, _ = bound(shop=SHOP)
    nodes = {n["id"]: n for n in out["shop"]["nodes"]}
    kinds = {i: n["kind"] for i, n in nodes.items() if n["kind"] not in ("Method", "Property")}
    assert kinds == {"Shop.IStore<T>": "Interface", "Shop.IClock": "Interface", "Shop.Item": "Class", "Shop.Point": "Record", "Shop.Line": "Record", "Shop.Shape": "Record", "Shop.Store<T>": "Class", "Shop.Tools": "Class", "Shop.Base": "Class", "Shop.Cart": "Class", "Shop.Cart.Nested": "Class"}
    assert nodes["Shop.Item.Item()"]["name"] == "Item" and nodes["Shop.Cart.Nested"]["namespace"] == "Shop"
    assert "Shop.Cart.Total(System.Collections.Generic.IEnumerable<Shop.Item>, params int[])" in nodes
    assert "Shop.Cart.Cart(Shop.IStore<Shop.Item>, System.Collections.Generic.List<Shop.Point>, Shop.Mode)" in nodes
    assert "Shop.Tools.Tools()" not in nodes and "Shop.Line.Line(Shop.Line)" in nodes and "Shop.Point.Point()" in nodes


def test_edges_of_declarations():
    _, edges = bound(shop=SHOP)
    has = lambda s, k: {t.removeprefix("Shop.") for a, b, t in edges if a == f"Shop.{s}" and b == k}
    assert has("Store<T>", "IMPLEMENTS") == {"IStore<T>"} and has("Line", "INHERITS") == {"Shape"}
    assert has("Cart", "INHERITS") == set() and has("Cart", "IMPLEMENTS") == set()
    assert has("Cart", "INJECTS") == {"IStore<T>"} and has("Base", "INJECTS") == {"IClock"} and has("Line", "INJECTS") == set()
    assert {"Item", "Point"} <= has("Cart", "REFERENCES") and "Mode" not in has("Cart", "REFERENCES")
    assert has("Line", "CONTAINS") == {"Line.Line(Shop.Point, Shop.Point)", "Line.Line(Shop.Line)", "Line.From", "Line.To"}
    assert has("Line", "REFERENCES") == {"Point"} and has("Cart.Nested", "REFERENCES") == {"Cart"}
    assert not any(t.startswith("System") for _, _, t in edges)


def test_edges_of_bodies():
    _, edges = bound(shop=SHOP)
    total = "Shop.Cart.Total(System.Collections.Generic.IEnumerable<Shop.Item>, params int[])"
    has = lambda s, k: {t.removeprefix("Shop.") for a, b, t in edges if a == s and b == k}
    assert has(total, "CALLS") == {"IStore<T>.Get(int)", "Tools.Touch<T>(T)", "Cart.Describe(Shop.Item)", "Cart.Pick(int)", "Cart.Pick(string)", "Cart.Pick(int, int)", "Item.Item()"}
    assert has(total, "REFERENCES") == {"Item", "Item.Price", "Cart.Items", "IClock.Now", "Line", "Store<T>", "IStore<T>"}
    assert has("Shop.Cart", "CALLS") == {"Item.Item()"} and {"Item.Price", "Item.Name"} <= has("Shop.Cart", "REFERENCES")
    assert has("Shop.Cart.Items", "CALLS") == {"Tools.Run()"} and has("Shop.Cart.Best", "CALLS") == {"IStore<T>.Get(int)"}
    assert has("Shop.Cart.Where", "CALLS") == {"Point.Point(int, int)"}
    assert has("Shop.Cart.Go()", "CALLS") == {"Base.Go()", "Tools.Size(Shop.Item[])"}
    assert has("Shop.Cart.Total(System.Collections.Generic.IEnumerable<Shop.Item>, params int[])", "RETURNS") == set() and has("Shop.IStore<T>.Get(int)", "RETURNS") == set()
    assert not any("Inner" in t for _, _, t in edges)


def test_names_are_found_by_scope():
    files = dict(
        a="namespace A { public class T { public void Own() { } } namespace B { public class T { public void Inner() { } } public class U { public T One; void M() { One.Inner(); } } } }",
        c="using A.B; using Alias = A.T; namespace C { public class V { public T Two; public Alias Three; public A.B.T Four; public T? Five; public Gone Six; void M(Alias x) { x.Own(); A.T y = new(); y.Own(); } } }",
        p="using C; var v = new V(); v.ToString(); for (int i = 0; i < 2; i++) { new A.T().Own(); }",
        q="partial class P { Q one; } class Q { } ",
        r="partial class P { Q two; }",
    )
    out, edges = bound(**files)
    has = lambda s, k: [t for a, b, t in edges if a == s and b == k]
    assert has("A.B.U", "REFERENCES") == ["A.B.T"] and has("A.B.U.M()", "CALLS") == ["A.B.T.Inner()"]
    assert set(has("C.V", "REFERENCES")) == {"A.B.T", "A.T"} and set(has("C.V.M(A.T)", "CALLS")) == {"A.T.Own()", "A.T.T()"}
    assert set(has("Program.<Main>$(string[])", "CALLS")) == {"C.V.V()", "A.T.T()", "A.T.Own()"}
    assert [n["id"] for n in out["p"]["nodes"]] == ["Program", "Program.<Main>$(string[])"] and out["p"]["nodes"][1]["namespace"] is None
    assert out["a"]["namespaces"] == ["A", "A.B"] and has("P", "REFERENCES") == ["Q", "Q"]


def test_odd_texts_do_not_raise():
    for n in range(0, len(SHOP), 5):
        bound(x=SHOP[:n])
        bound(x=SHOP[n:])


def test_documents_of_solutions(spark):
    rows = [("s1", "p", "/a.cs", 0, 0, "namespace N; public class A { public void M() { B.Run(); } }"), ("s1", "q", "/b.cs", 1, 0, "namespace N; public static class B { public static void Run() { } }"), ("s1", "q", "/obj/c.cs", 1, 1, "class C { }"), ("s2", "p2", "/d.cs", 0, 0, "namespace N; public class D { void M() { B.Run(); } }"), ("s2", "p2", "/e.cs", 0, 1, None)]
    table = spark.createDataFrame(rows, extract.SOURCE)
    docs = extract.documents(table)
    got = {(r.src, r.type, r.dst) for r in model.edges(docs).collect()}
    assert ("N.A.M()", "CALLS", "N.B.Run()") in got and not any("C" == s[0] for s in got) and ("N.D.M()", "CALLS", "N.B.Run()") not in got
    assert docs.count() == 4 and docs.filter("path = '/e.cs'").first().nodes == []
    some = extract.documents(table, spark.createDataFrame([("p", "/a.cs")], "project string, path string"))
    assert [r.path for r in some.collect()] == ["/a.cs"] and ("N.A.M()", "CALLS", "N.B.Run()") in {(r.src, r.type, r.dst) for r in model.edges(some).collect()}
    assert extract.documents(table.limit(0)).count() == 0


def test_context():
    service = "using System.Threading;\nnamespace App;\npublic class Service : BaseService, IService\n{\n    public Service(IRepo repo, ILogger<Service> log, int n) { }\n    [Fast]\n    public Task<Order> Place(CreateOrder dto, CancellationToken ct, string? note) => null;\n    internal void Keep(Order[] orders, Gone<Order> gone) { }\n    private void Hide(Hidden h) { }\n}\n"
    repo = "namespace App;\npublic interface IRepo { Order Get(int id); }\npublic class Order { }\npublic interface IService { }\npublic abstract class BaseService { }\n"
    got = context.analyze([("/s.cs", service), ("/r.cs", repo), ("/s.cs", service)])
    refs = [(r["from"], r["to"], r["via"], r["resolved_file"]) for r in got["references"]]
    assert refs == [
        ("Service", "BaseService", "base", "/r.cs"), ("Service", "IService", "implements", "/r.cs"), ("Service", "IRepo", "constructor", "/r.cs"), ("Service", "ILogger<Service>", "constructor", None),
        ("Service", "CreateOrder", "parameter", None), ("Service", "CancellationToken", "parameter", None), ("Service", "Order[]", "parameter", None), ("Service", "Gone<Order>", "parameter", None),
    ]
    assert got["unresolved"] == ["ILogger<Service>", "CreateOrder", "Order[]", "Gone<Order>"]
    assert [f["file"] for f in got["files"]] == ["/s.cs", "/r.cs", "/s.cs"]
    view = got["files"][0]["types"][0]
    assert (view["base"], view["implements"], view["constructor_dependencies"]) == ("BaseService", ["IService"], ["IRepo", "ILogger<Service>", "int"])
    assert view["methods"] == ["Place(dto:CreateOrder, ct:CancellationToken, note:string?): Task<Order>", "internal Keep(orders:Order[], gone:Gone<Order>): void"]


def test_contexts_are_bound_alone(spark):
    rows = [(1, 0, "/a.cs", "class A : B { }"), (1, 1, "/b.cs", "class B { }"), (2, 0, "/a.cs", "class A : B { }")]
    got = {r.context: r for r in context.inspect(spark.createDataFrame(rows, "context int, pos int, path string, content string")).collect()}
    assert [(x["to"], x["resolved_file"]) for x in got[1].references] == [("B", "/b.cs")] and got[1].unresolved == []
    assert [x["resolved_file"] for x in got[2].references] == [None] and got[2].unresolved == ["B"]


PARTED = {
    "/usings.cs": "global using Deep.Er;\nglobal using Two = Deep.Er.Far;",
    "/base.cs": "namespace Lib { public class Base<T> { public T Held; public class Inside { public void In() { } } } public partial class Part { public Lib.Base<Other> Made() => null; } }",
    "/part.cs": "namespace Lib { public partial class Part : Base<Other> { public Inside Nest() => null; } public class Other { public Next Go { get; } } }",
    "/next.cs": "namespace Lib { public class Next { public Last Deeper() => null; } } namespace Deep.Er { public class Far { public static void Run(this Lib.Next n) { } } }",
    "/last.cs": "namespace Lib { public class Last { public int N { get; } } public static class Ext { public static Next Back(this Last l) => null; } public class Unused { } }",
    "/use.cs": "using Lib; namespace App { class U : Part { void M() { Made().Held.Go.Deeper().Back().Deeper().N.ToString(); Nest().In(); Far f = new(); Deep.Er.Far g; Two h; new Lib.Base<Last>.Inside().In(); } } }",
    "/top.cs": "using Lib; var p = new Part(); p.Made().Held.Go.Deeper();",
    "/program.cs": "partial class Program { void Own() { } }",
}


def test_documents_are_the_same_however_files_are_dealt(spark, monkeypatch):
    rows = [("s", "p", path, 0, i, content) for i, (path, content) in enumerate(PARTED.items())] + [("s", "q", "/shop.cs", 1, 0, SHOP), ("s", "q", "/none.cs", 1, 1, None), ("t", "r", "/use.cs", 0, 0, "namespace Lib { class Last { } class U { Last l; } }")]
    table = spark.createDataFrame(rows, extract.SOURCE)
    taken = lambda: {(r.project, r.path): r.asDict(recursive=True) for r in extract.documents(table).collect()}
    whole = taken()
    calls = {(e["source"]["id"], e["target"]["id"]) for d in whole.values() for e in d["edges"] if e["type"] == "CALLS"}
    assert {("App.U.M()", "Lib.Ext.Back(Lib.Last)"), ("App.U.M()", "Lib.Base<T>.Inside.In()"), ("App.U.M()", "Lib.Next.Deeper()"), ("Program.<Main>$(string[])", "Lib.Next.Deeper()")} <= calls
    assert len(whole) == len(rows)
    for files, rounds in ((1, 40), (3, 40), (1, 1)):
        monkeypatch.setattr(extract, "FILES", files)
        monkeypatch.setattr(extract, "ROUNDS", rounds)
        assert taken() == whole
    some = extract.documents(table, spark.createDataFrame([("p", "/use.cs"), ("p", "/top.cs")], "project string, path string"))
    assert {(r.project, r.path): r.asDict(recursive=True) for r in some.collect()} == {k: whole[k] for k in (("p", "/use.cs"), ("p", "/top.cs"))}


def test_a_task_gets_the_declarations_that_it_can_look_up(spark, monkeypatch):
    """Each of 300 files calls one other; what is sent stays in proportion to the files, whatever the number of tasks."""
    sent = []
    monkeypatch.setattr(extract, "FILES", 10)
    monkeypatch.setattr(extract, "_bind", lambda rows: sent.append(rows) or rows)
    rows = [("s", "p", f"/{i}.cs", 0, i, f"namespace N; public class C{i} {{ public static void Go() {{ C{(i + 7) % 300}.Go(); }} }}") for i in range(300)]
    extract.documents(spark.createDataFrame(rows, extract.SOURCE))
    counts = {r["turn"]: r["count"] for r in sent[0].groupBy("turn").count().collect()}
    assert sent[0].select("task").distinct().count() >= 20 and counts[3] == 300 and 300 <= counts[0] <= 600


def test_only_the_documents_stay_on_disk(spark, monkeypatch):
    from pathlib import Path

    from weftgraph.snapshots.snapshots import prepare

    monkeypatch.setattr(extract, "FILES", 2)
    rows = [("s", "p", f"/{i}.cs", 0, i, f"namespace N; public class C{i} {{ C{(i + 1) % 9} next; }}") for i in range(9)]
    table = spark.createDataFrame(rows, extract.SOURCE)
    at = Path(prepare(table).removeprefix("file:"))
    before = set(at.iterdir())
    docs = extract.settled(table)
    assert len(set(at.iterdir()) - before) == 1 and docs.count() == 9


def test_references_to_own_declarations_are_left_out_early(spark):
    rows = [("s", "p", "/a.cs", 0, 0, "class A { void M() { B.Run(); } }"), ("s", "p", "/b.cs", 0, 1, "static class B { public static void Run() { } }")]
    docs = extract.documents(spark.createDataFrame(rows, extract.SOURCE))
    assert [r.x.n.id for r in model.references(docs).collect()] == ["B.Run()"]
    assert {r.id: (r.file, r.is_reference) for r in model.nodes(docs).collect()} == {"A": ("/a.cs", False), "A.A()": ("/a.cs", False), "A.M()": ("/a.cs", False), "B": ("/b.cs", False), "B.Run()": ("/b.cs", False)}
    alone = docs.filter("path = '/a.cs'")
    assert {r.id: (r.file, r.is_reference) for r in model.nodes(alone).collect()}["B.Run()"] == ("/b.cs", True)


def test_impact_and_search_over_dealt_files(spark, monkeypatch):
    from weftgraph.plans import catalog

    sent, bind = [], extract._bind
    monkeypatch.setattr(extract, "_bind", lambda rows: sent.append(rows.select("task").distinct().count()) or bind(rows))
    monkeypatch.setattr(extract, "FILES", 40)
    for query in ("code_impact", "code_search"):
        rows = catalog.queries()[query](spark, "/root/testdata/sf0.001").collect()
        monkeypatch.setattr(extract, "FILES", 2000)
        assert rows and sorted(map(repr, rows)) == sorted(map(repr, catalog.queries()[query](spark, "/root/testdata/sf0.001").collect()))
        monkeypatch.setattr(extract, "FILES", 40)
    assert sent == [sent[0], 1, sent[0], 1] and sent[0] > 1


def test_members_share_a_scope_and_nodes_are_made_once():
    f = facts.Facts("/a.cs", "namespace N; class A { void Go() { Run(); } void Run() { Go(); } T Of<T>(T x) => x; }")
    symbols = binder.Symbols([f])
    go, run, of = (symbols.types["N", ("A", 0)].members[i] for i in range(3))
    assert go.scope is run.scope and of.scope.names == {"T"} and not go.scope.names
    found = binder.extract(f, symbols)["edges"]
    assert len({id(e["source"]) for e in found}) == len({e["source"]["id"] for e in found})


def test_files_of_one_place_keep_their_own_texts(spark, monkeypatch):
    rows = [("s", p, "/Same.cs", 0, 0, f"namespace N; class {t} {{ void Go() {{ B.Run(); }} }}") for p, t in (("p", "A"), ("q", "C"))]
    rows += [("s", "p", "/B.cs", 0, 1, "namespace N; public class B { public static void Run() { } }"), ("s", "p", "/Top.cs", 0, 2, "N.B.Run();"), ("s", "p", "/None.cs", 0, 3, None)]
    sources = spark.createDataFrame(rows, extract.SOURCE)
    for files in (100, 2):
        monkeypatch.setattr(extract, "FILES", files)
        got = {(r.src, r.dst) for r in model.edges(extract.documents(sources)).filter("type = 'CALLS'").collect()}
        assert got == {("N.A.Go()", "N.B.Run()"), ("N.C.Go()", "N.B.Run()"), ("Program.<Main>$(string[])", "N.B.Run()")}


def test_shifts_of_ranks_need_no_python_rows(spark, monkeypatch):
    kinds, make = [], type(spark).createDataFrame
    rows = traverse.numbered(spark.range(1000).select(F.col("id").alias("x")), ["x"], "n")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: kinds.append(type(data)) or make(self, data, *a, **b))
    assert [r["rank"] for r in traverse.ranked(rows, "n", "rank").orderBy("x").collect()] == list(range(1000))
    assert kinds == [pa.Table]
