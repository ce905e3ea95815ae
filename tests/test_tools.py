"""The graph queries as JSON texts, with their orders and errors."""

import json

import pytest

from weftgraph.operators import extract, model, neighbors, search, tools

CODE = [
    ("Core", "/src/Core/Store.cs", 0, 0, "namespace Core; public interface IStore { int Load(int id); } public class Store : IStore { public int Load(int id) { Audit.Note(id); return id; } }"),
    ("Core", "/src/Core/Audit.cs", 0, 1, "namespace Core { public static class Audit { public static void Note(int id) { } public static void Login(int id) { Note(id); } } } namespace Core.More { public enum Mode { A } }"),
    ("App", "/src/App/Shop.cs", 1, 0, "using Core; namespace App; public class Shop(IStore store) { public int Sell() { Audit.Note(1); Audit.Login(2); return store.Load(1); } public void Login() { Sell(); } }"),
    ("App", "/src/Core/Audit.cs", 1, 1, "namespace Core { public static class Audit { public static void Note(int id) { } public static void Login(int id) { Note(id); } } }"),
]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("s", *r) for r in CODE]
    return tools.Graph(extract.documents(spark.createDataFrame(rows, extract.SOURCE)))


def ask(f):
    return json.loads(tools.answer(f))


def test_dependencies_in_order(graph):
    got = ask(lambda: graph.dependencies("App.Shop"))
    assert [(x["id"], x["direction"], x["edgeKinds"]) for x in got] == [("Core.IStore", "out", {"CALLS": 1, "INJECTS": 1}), ("Core.Audit", "out", {"CALLS": 2})]
    assert got[0]["kind"] == "Interface" and got[0]["file"] == "/src/Core/Store.cs"
    into = ask(lambda: graph.dependencies("Core.Audit"))
    assert [(x["id"], x["direction"], x["edgeKinds"]) for x in into] == [("Core.Store", "in", {"CALLS": 1}), ("App.Shop", "in", {"CALLS": 2})]
    assert [x["id"] for x in ask(lambda: graph.dependencies("Core.Audit.Login(int)"))] == ["Core.Audit", "App.Shop"]


def test_impact_and_paths(graph):
    got = ask(lambda: graph.impact("Core.Audit"))
    assert got["affectedIds"] == ["Core.Store", "App.Shop"] and got["affectedFiles"] == {"Core.Store": "/src/Core/Store.cs", "App.Shop": "/src/App/Shop.cs"}
    assert ask(lambda: graph.impact("App.Shop.Login()")) == {"affectedIds": []}
    assert ask(lambda: graph.path("App.Shop", "Core.Audit.Note(int)"))[0] == "App.Shop"
    assert ask(lambda: graph.path("Core.Audit", "App.Shop"))["code"] == "no_path"
    assert ask(lambda: graph.path("Nobody", "Noone"))["message"].endswith("Nobody") and ask(lambda: graph.path("App.Shop", "Noone"))["code"] == "node_not_found"
    assert ask(lambda: graph.impact("Nobody"))["code"] == ask(lambda: graph.dependencies("Nobody"))["code"] == "node_not_found"


def test_search_by_file(graph):
    got = ask(lambda: graph.search(["login", "Audit"]))
    assert got["truncated"] is False
    assert [(x["file"], x["fileMatched"], [m["nodeId"] for m in x["methods"]]) for x in got["results"]] == [("/src/Core/Audit.cs", True, ["Core.Audit.Login(int)"]), ("/src/App/Shop.cs", False, ["App.Shop.Login()"])]
    assert got["results"][0]["namespaces"] == ["Core", "Core.More"]
    assert tools.answer(lambda: graph.search(["Missing"])) == '{"results":[],"truncated":false}'
    assert ask(lambda: graph.search(["More", "src", "Shop"]))["results"][0]["methods"] == [{"name": "Shop", "nodeId": "App.Shop.Shop(Core.IStore)"}]
    for bad in (["Login", "ab"], [], ["Login", "     "], [" ab "], [None]):
        assert ask(lambda bad=bad: graph.search(bad))["code"] == "invalid_query"
    assert ask(lambda: graph.search(["\U0001f600a"])) == {"results": [], "truncated": False}  # three UTF-16 units


def test_files_of_edge_ends_are_searched(spark):
    node = lambda i, k, f, n: (i, k, f, n, "N")
    docs = spark.createDataFrame([("p", "/a.cs", "x", 0, 0, [], [(node("N.T", "Class", "/a.cs", "T"), node("N.U.Far()", "Method", "/z.cs", "Far"), "CALLS")], ["N"])], model.DOCUMENT)
    (r,) = search.grouped(docs, ["far"]).collect()
    assert (r.file, r.namespaces, r.file_matched, [tuple(m) for m in r.methods]) == ("/z.cs", ["N"], False, [("Far", "N.U.Far()")])


def test_a_search_derives_the_nodes_once(spark, monkeypatch):
    node = lambda i, k, f, n: (i, k, f, n, "N")
    docs = spark.createDataFrame([("p", "/a.cs", "x", 0, 0, [node("N.T", "Class", "/a.cs", "T")], [(node("N.T", "Class", "/a.cs", "T"), node("N.U.Far()", "Method", "/z.cs", "Far"), "CALLS")], ["N"])], model.DOCUMENT)
    made, nodes = [], model.nodes
    monkeypatch.setattr(model, "nodes", lambda d: made.append(d) or nodes(d))
    assert [r.file for r in search.grouped(docs, ["far"]).collect()] == ["/z.cs"] and len(made) == 1


def test_many_neighbors_keep_their_order(spark):
    triples = [("T", "T.Run", "CONTAINS"), *((f"C{i}", "T.Run", "CALLS") for i in range(1000))]
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(triples)], "src string, dst string, type string, seq long")
    assert [r.neighbor_id for r in neighbors.of(df, "T").orderBy("place").collect()] == [f"C{i}" for i in range(1000)]
    faces = spark.createDataFrame([("A", "I", "IMPLEMENTS", 1), ("B", "I", "IMPLEMENTS", 0), ("A", "J", "IMPLEMENTS", 2)], "src string, dst string, type string, seq long")
    assert [r.id for r in neighbors.implementors(faces, "I").orderBy("place").collect()] == ["B", "A"]
    assert [r.id for r in neighbors.implemented(faces, "A").orderBy("place").collect()] == ["I", "J"]
