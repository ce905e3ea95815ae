import pytest

from weftgraph.errors import AnalysisError
from weftgraph.operators import model
from weftgraph.sources import csharp, files, solution, store

CODE = '''
using System;
using static System.Math;
namespace Shop.Core;
/* class Hidden { } */
[Serializable, Obsolete("a, b")]
public partial class Cart<T> : Base<T>, ICart where T : class, new()
{
    public const int Max = 3, Min = 1;
    private readonly string text = "class X { }";
    public Cart(int a) { if (a > 1) { } }
    internal Cart(int a, List<(int, string)> b, string c = "}") : base(a) { }
    public event Action Changed, Gone;
    public required string Name { get; private set; } = "x";
    public int Twice => 2;
    [Pure] protected internal virtual Task<Dictionary<string, int[]>> Run<U>(ref int x, params string[] rest) where U : T => null;
    void ICart.Clear() { }
    private void Secret() { }
    private class Inner { public enum Color { Red = 1, [Old] Green } }
    public static Cart<T> operator +(Cart<T> a, Cart<T> b) => a;
    public int this[int i] => i;
}
interface ICart { void Clear(); int Count { get; } }
public readonly record struct Point(int X, int Y);
record Line(Point From) : Shape(1), IThing { public string Note { get; init; } }
public delegate int Fold(int a, int b);
'''


def test_contract():
    got = csharp.inspect("/Cart.cs", CODE)
    assert (got["namespace"], got["usings"], got["parse_errors"]) == ("Shop.Core", ["System", "System.Math"], None)
    types = {t["name"]: t for t in got["types"]}
    assert list(types) == ["Cart<T>", "Color", "ICart", "Point", "Line", "Fold"]
    cart = types["Cart<T>"]
    assert (cart["kind"], cart["base"], cart["implements"], cart["is_partial"]) == ("class", "Base<T>", ["ICart"], True)
    assert cart["attributes"] == ["Serializable", 'Obsolete("a, b")'] and cart["generic_constraints"] == ["where T : class, new()"]
    assert [p["type"] for p in cart["constructor_dependencies"]] == ["int", "List<(int, string)>", "string"]
    assert [(p["name"], p["accessors"], p["is_required"]) for p in cart["properties"]] == [("Name", "get; private set;", True), ("Twice", None, None), ("Max", None, None), ("Min", None, None)]
    run, clear = cart["methods"]
    assert (run["access"], run["return_type"], run["modifiers"], run["attributes"]) == ("protected internal", "Task<Dictionary<string, int[]>>", ["virtual"], ["Pure"])
    assert run["parameters"] == [{"type": "int", "name": "x"}, {"type": "string[]", "name": "rest"}] and run["start_line"] == run["end_line"] == 16
    assert (clear["name"], clear["access"]) == ("ICart.Clear", "public")
    assert [e["name"] for e in cart["events"]] == ["Changed", "Gone"]
    assert types["Color"]["members"] == ["Red", "Green"] and types["ICart"]["access"] == "internal"
    assert [(p["name"], p["accessors"]) for p in types["Point"]["properties"]] == [("X", "get; init;"), ("Y", "get; init;")]
    assert types["Line"]["base"] is None and types["Line"]["implements"] == ["IThing"]
    assert types["Fold"]["methods"][0]["return_type"] == "int"


def test_unreadable_texts_do_not_raise():
    for text in (None, "", "}", "class", "class A {", "class A { int", "namespace", "using", "[", "Console.Write(1); class B { }", '"""', "delegate", "enum E", "record R(", "a < b"):
        csharp.inspect("/x.cs", text)
    for n in range(0, len(CODE), 7):
        csharp.inspect("/x.cs", CODE[:n])
    assert csharp.inspect("/x.cs", "class A {")["parse_errors"]


def test_scan_and_contracts(spark, tmp_path):
    (tmp_path / "src" / "obj").mkdir(parents=True)
    for name, text in (("src/Cart.cs", CODE), ("src/Empty.cs", "\n"), ("src/A.g.cs", CODE), ("src/obj/B.cs", CODE), ("src/Nothing.cs", ""), ("src/x.txt", "no")):
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path))
    rows = {r.file.rsplit("/", 1)[1]: r for r in files.contracts(found).collect()}
    assert set(rows) == {"Cart.cs", "Empty.cs", "Nothing.cs"} and rows["Empty.cs"].types == []
    assert files.type_rows(files.contracts(found)).count() == 6
    cart = found.filter("path like '%Cart.cs'").first().path
    cart = cart.removeprefix("file:")
    (tmp_path / "Locked.cs").write_text("class L { }")
    got = [(r.error, r.content and r.content[:8]) for r in files.listed(spark, [cart, "/none.cs", str(tmp_path / "src/x.txt"), cart, str(tmp_path / "src/Nothing.cs")]).orderBy("pos").collect()]
    assert got == [(None, CODE[:8]), ("file_not_found", None), ("not_a_cs_file", None), (None, CODE[:8]), (None, "")]
    with pytest.raises(AnalysisError) as e:
        files.guarded(spark, [cart] * 16)
    assert e.value.code == "too_many_files"
    with pytest.raises(AnalysisError) as e:
        files.guarded(spark, [cart, "/no/one.cs", "/no/two.cs"])
    assert (e.value.code, e.value.file_path) == ("file_not_found", "/no/one.cs")
    names = [r.path.rsplit("/", 1)[1] for r in files.candidates(spark, [str(tmp_path), str(tmp_path / "src")]).collect()]
    assert len(names) == len(set(names)) and {"Cart.cs", "Nothing.cs"} <= set(names) and "B.cs" not in names
    assert "Cart.cs" not in {r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), before="2001-01-01T00:00:00").collect()}


def test_unreadable_files_are_told_apart(spark, tmp_path, monkeypatch):
    (tmp_path / "Locked.cs").write_text("class L { }")
    monkeypatch.setattr(files.paths, "state", lambda *_: (True, False))  # as for a file without read permission
    assert [(r.error, r.content) for r in files.listed(spark, [str(tmp_path / "Locked.cs")]).collect()] == [("read_failed", None)]


def test_branches_of_directives():
    code = "#define FAST\n#if FAST && !SLOW\nclass A { }\n#else\nclass B { }\n#endif\n#if DEBUG\nclass C { }\n#elif (X || true)\nclass D { }\n#else\nclass E { }\n#endif\n#undef FAST\n#if FAST\n#if true\nclass F { }\n#endif\n#endif\nclass G { void M()\n{ } }\n"
    got = csharp.inspect("/x.cs", code)
    assert [t["name"] for t in got["types"]] == ["A", "D", "G"]
    assert csharp.active(code).count("\n") == code.count("\n")


def test_framework_kinds_tell_bases_apart():
    types = {t["name"]: t for t in csharp.inspect("/x.cs", "using System.IO;\nclass A : IOException, IDisposable { }\nclass B : IMystery { }\nclass C : Mystery { }\nrecord D : Mystery { }\nclass E : IEnumerable<int> { }")["types"]}
    assert {k: (t["base"], t["implements"]) for k, t in types.items()} == {"A": ("IOException", ["IDisposable"]), "B": (None, ["IMystery"]), "C": ("Mystery", None), "D": (None, ["Mystery"]), "E": (None, ["IEnumerable<int>"])}


def test_solution_order(spark, tmp_path):
    text = 'Project("{1}") = "B", "b\\B.csproj", "{2}"\nEndProject\nProject("{1}") = "Folder", "Folder", "{3}"\nEndProject\nProject("{1}") = "A", "A.csproj", "{4}"\n'
    assert solution.projects(text, "/s") == [("B", "/s/b/B.csproj"), ("A", "/s/A.csproj")]


def test_store_moves_its_pointer_last(spark, tmp_path):
    folder = str(tmp_path / "graph")
    assert store.load(spark, folder).isEmpty() and store.revision(spark, folder) is None
    one = spark.createDataFrame([("p", "/a", "X", 0, 0, [], [], None)], model.DOCUMENT)
    first = store.save(one, folder)
    second = store.save(one.unionByName(one), folder)
    assert first != second and store.revision(spark, folder) == second and store.load(spark, folder).count() == 2
    assert '"nodes":[]' in store.as_json(one).first().json and "namespaces" not in store.as_json(one).first().json


def test_malformed_json_changes_nothing(spark, tmp_path):
    good, none, bad = tmp_path / "g.json", tmp_path / "n.json", tmp_path / "b.json"
    good.write_text('{"documents": [["p", "/a", "X", 0, 0, [], [], null]]}')
    none.write_text("{}")
    bad.write_text("{ not json")
    assert store.read_json(spark, str(good)).count() == 1 and store.read_json(spark, str(none)).count() == 0
    with pytest.raises(AnalysisError):
        store.read_json(spark, str(bad))


def test_loaded_graphs_are_kept_by_revision(spark, tmp_path):
    folder, cache = str(tmp_path / "graph"), store.Cache()
    one = spark.createDataFrame([("p", "/a", "X", 0, 0, [], [], None)], model.DOCUMENT)
    store.save(one, folder)
    held = cache.load(spark, folder)
    assert cache.load(spark, folder) is held
    store.save(one.unionByName(one), folder)
    assert cache.load(spark, folder) is not held and held.count() == 1 and cache.load(spark, folder).count() == 2
