"""Synchronisation on a small solution of our own: what each edit reads again, and that the result is that of a fresh scan."""

import shutil

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import AnalysisError, SyncError, chain
from weftgraph.operators import model, sync
from weftgraph.sources import solution, store

FILES = {
    "All.sln": 'Project("{1}") = "Core", "Core\\Core.csproj", "{2}"\nEndProject\nProject("{1}") = "App", "App\\App.csproj", "{3}"\nEndProject\nProject("{1}") = "Alone", "Alone\\Alone.csproj", "{4}"\nEndProject\n',
    "Core/Core.csproj": '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net9.0</TargetFramework></PropertyGroup></Project>',
    "App/App.csproj": '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><ProjectReference Include="..\\Core\\Core.csproj" /><AdditionalFiles Include="notes.txt" /></ItemGroup></Project>',
    "Alone/Alone.csproj": '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><Compile Remove="Left.cs" /></ItemGroup></Project>',
    "App/notes.txt": "notes",
    "Core/Log.cs": "namespace Core;\npublic static class Log { public const int Level = 1; public static void Write(object x) { } }\n",
    "Core/Part1.cs": "namespace Core;\npublic partial class Box { public Log2 Own { get; } = new(); }\npublic class Log2 { }\n",
    "Core/Part2.cs": "namespace Core;\npublic partial class Box { public void Open() { Log.Write(1); } }\n",
    "App/Client.cs": "using Core;\nnamespace App;\npublic class Client(Box box) { public void Run() { box.Open(); Log.Write(\"x\"); } }\n",
    "Alone/Solo.cs": "public class Solo { public void A() { B(); } void B() { } }\n",
    "Alone/Left.cs": "public class Left { }\n",
    "Alone/obj/Made.cs": "public class Made { }\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def names(result):
    return {k.rsplit("|", 1)[1]: v if v is None else {p.rsplit("/", 1)[1] for p in v} for k, v in result.selection.items()}


def state(documents):
    rows = documents.select(F.to_json(F.struct(*documents.columns)).alias("j")).collect()
    return sorted(r.j for r in rows)


def fresh(spark, root, tmp):
    """The documents of a scan without a stored graph, at the same place."""
    kept = root / ".weftgraph"
    shutil.move(kept, tmp)
    try:
        return state(sync.Synchronizer(spark).run(str(root / "All.sln")).documents)
    finally:
        shutil.rmtree(kept)
        shutil.move(tmp, kept)


def test_scan_and_edits(spark, root, tmp_path_factory):
    path, it = str(root / "All.sln"), sync.Synchronizer(spark)
    spare = tmp_path_factory.mktemp("spare") / "kept"
    first = it.run(path)
    assert first.saved and first.report | {"nodeCount": 0, "edgeCount": 0} == {"status": "complete", "totalProjects": 3, "loadedProjects": 3, "unsupportedProjects": 0, "skippedProjects": 0, "totalDocuments": 5, "loadedDocuments": 5, "skippedDocuments": 0, "nodeCount": 0, "edgeCount": 0}
    edges = {(r.src, r.type, r.dst) for r in model.edges(first.documents).collect()}
    assert {("App.Client", "INJECTS", "Core.Box"), ("App.Client.Run()", "CALLS", "Core.Box.Open()"), ("App.Client.Run()", "CALLS", "Core.Log.Write(object)"), ("Core.Box.Own", "CALLS", "Core.Log2.Log2()"), ("Solo.A()", "CALLS", "Solo.B()")} <= edges
    assert first.report["nodeCount"] == model.nodes(first.documents).count() and first.report["edgeCount"] == len(edges)
    assert sync.scan_status(first).startswith("Scan complete. ") and "5 of 5 documents" in sync.scan_status(first)
    none = it.run(path)
    assert not none.saved and none.revision == first.revision and none.selection == {}

    def edit(name, text, warm=True):
        (root / name).write_text(text) if text is not None else (root / name).unlink()
        got = (it if warm else sync.Synchronizer(spark)).run(path)
        assert state(got.documents) == fresh(spark, root, spare)
        return got

    body = edit("Core/Part2.cs", FILES["Core/Part2.cs"].replace("Log.Write(1);", ""))
    assert names(body) == {"Core": {"Part2.cs"}} and body.saved
    assert body.report["edgeCount"] == first.report["edgeCount"] - 1 and body.report["nodeCount"] == first.report["nodeCount"]
    overload = edit("Core/Log.cs", FILES["Core/Log.cs"].replace("{ }", "{ } public static void Write(string x) { }"))
    assert names(overload) == {"Core": None, "App": None}
    assert ("App.Client.Run()", "Core.Log.Write(string)") in {(r.src, r.dst) for r in model.edges(overload.documents).collect()}
    constant = edit("Core/Log.cs", FILES["Core/Log.cs"].replace("Level = 1", "Level = 2"))
    assert names(constant) == {"Core": None, "App": None}
    cold = edit("Core/Part2.cs", FILES["Core/Part2.cs"], warm=False)
    assert names(cold) == {"Core": None, "App": None}
    added = edit("App/A.cs", "namespace App; class A { }")
    assert names(added) == {"App": None} and [r.document_order for r in added.documents.filter("path like '%Client.cs'").collect()] == [1]
    gone = edit("App/A.cs", None)
    assert names(gone) == {"App": None}


def test_projects_shift_and_settings_count(spark, root, tmp_path_factory):
    path, it = str(root / "All.sln"), sync.Synchronizer(spark)
    it.run(path)
    (root / "Zero").mkdir()
    (root / "Zero/Zero.vbproj").write_text("<Project />")
    (root / "All.sln").write_text('Project("{1}") = "Zero", "Zero\\Zero.vbproj", "{9}"\nEndProject\n' + FILES["All.sln"])
    got = it.run(path)
    assert names(got) == {} and got.saved and got.report["status"] == "partial" and got.report["unsupportedProjects"] == 1
    assert {r.project.rsplit("|", 1)[1]: r.project_order for r in got.documents.collect()} == {"Core": 1, "App": 2, "Alone": 3}
    assert "unsupported projects" in sync.scan_status(got)
    (root / "Directory.Build.props").write_text("<Project />")
    assert it.run(path).selection == {} and str(root / "Directory.Build.props") in [x["path"] for x in store.baseline(spark, store.location(path))["inputs"]]
    (root / "Core/Core.csproj").write_text(FILES["Core/Core.csproj"].replace("net9.0", "net10.0"))
    assert names(it.run(path)) == {"Core": None, "App": None}
    (root / "App/notes.txt").write_text("more")
    assert names(it.run(path)) == {}


def test_failures_leave_the_graph(spark, root):
    path, it = str(root / "All.sln"), sync.Synchronizer(spark)
    good = it.run(path)
    for name in ("Core", "App", "Alone"):
        (root / name / f"{name}.csproj").write_text("<Project")
    bad = it.run(path)
    assert bad.report["status"] == "failed" and not bad.saved and store.revision(spark, store.location(path)) == good.revision
    with pytest.raises(AnalysisError) as e:
        sync.scan_status(bad)
    assert e.value.code == "scan_incomplete"
    assert it.run(str(root / "None.sln")) is None
    with pytest.raises(AnalysisError) as e:
        sync.scan_status(None)
    assert e.value.code == "graph_not_found"
    with pytest.raises(AnalysisError) as e:
        solution.evaluate(spark, str(root / "App/notes.txt"))
    assert e.value.code == "invalid_solution_path"


def test_errors_name_their_phase(spark, root, monkeypatch):
    def fail(*_):
        raise OSError("disk") from ValueError("inner")

    monkeypatch.setattr(store, "save", fail)
    with pytest.raises(SyncError) as e:
        sync.Synchronizer(spark).run(str(root / "All.sln"))
    assert e.value.phase == "persistence" and "OSError: disk --> ValueError: inner" in str(e.value)
    assert chain(ValueError("a")) == "ValueError: a"


def test_fingerprints_and_items(spark, root):
    found = solution.evaluate(spark, str(root / "All.sln"))
    core, app, alone = found.projects
    assert [p.rsplit("/", 1)[1] for p in alone.documents] == ["Solo.cs"] and app.references == [core.key] and core.key == f"{core.file}|Core"
    assert [p.rsplit("/", 1)[1] for p in app.additional] == ["notes.txt"] and len(core.fingerprint) == 64
    assert found.candidates == sorted(found.candidates) and not any("/obj/" in p for p in found.candidates) and found.inputs == sorted(found.inputs)
    (root / "Alone/Alone.csproj").write_text('<Project><ItemGroup><Compile Include="..\\Core\\**\\*.cs" /><Reference Include="lib.dll" /></ItemGroup><Import Project="own.targets" /></Project>')
    (root / "Alone/own.targets").write_text("<Project />")
    old = solution.evaluate(spark, str(root / "All.sln")).projects[2]
    assert [p.rsplit("/", 1)[1] for p in old.documents] == ["Log.cs", "Part1.cs", "Part2.cs"] and old.roots == [str(root / "Core")] and old.imports == [str(root / "Alone/own.targets")]
    (root / "Alone/lib.dll").write_text("x")
    assert solution.evaluate(spark, str(root / "All.sln")).projects[2].fingerprint != old.fingerprint
    assert solution.evaluate(spark, str(root / "All.sln"), before="2001-01-01T00:00:00").candidates == []
