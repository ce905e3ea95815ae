"""Synchronisation of a stored graph with a solution on disk: what changed, what must be read again, and the merge.

The order of a run: load the graph, check freshness against the baseline, evaluate
the solution, select, extract, merge, report, save. A run in which nothing changed
writes nothing; one that found nothing to load is reported and not saved; a failure
names its phase and leaves the graph before it in place.
"""

from __future__ import annotations

import hashlib
import posixpath
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.errors import AnalysisError, SyncError
from weftgraph.operators import extract, model, tools
from weftgraph.snapshots import snapshots
from weftgraph.sources import paths, solution, store
from weftgraph.sources.facts import Facts, surface


def closure(changed: set[str], links: set[tuple[str, str]]) -> set[str]:
    """The keys and all that refers to them over links (from, to)."""
    by_target: dict[str, set[str]] = {}
    for a, b in links:
        by_target.setdefault(b, set()).add(a)
    out, front = set(changed), set(changed)
    while front:
        front = {a for b in front for a in by_target.get(b, ())} - out
        out |= front
    return out


def surfaces(sources: DataFrame) -> dict[str, str]:
    """By path, a hash of what other files can depend on: all but bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(surface(Facts(p, c or "")).encode()).hexdigest() for p, c in zip(*(x.to_pylist() for x in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "h"])

    rows = sources.select("path", "content").dropDuplicates(["path"]).mapInArrow(run, "path string, h string")
    return {r["path"]: r["h"] for r in rows.toLocalIterator()}


@dataclass
class Session:
    """An evaluated solution that later runs go on with, as long as its evaluation and its graph's revision stand."""

    solution: solution.Solution
    revision: str | None = None
    surfaces: dict[str, str] = field(default_factory=dict)


@dataclass
class Result:
    """The graph after a run: its documents, revision and report, the baseline, and the paths read again (None: all of the project)."""

    documents: DataFrame
    revision: str | None
    report: dict
    baseline: dict
    selection: dict[str, set[str] | None]
    saved: bool


def has_search_metadata(documents: DataFrame) -> bool:
    """Whether every document has namespaces and every node a name; graphs without are read anew."""
    return tools.unnamed(documents).isEmpty()


def describe(spark: SparkSession, found: solution.Solution, loaded: dict[str, bool], extracted: dict[str, set[str]]) -> dict:
    """The baseline of an evaluated solution. loaded, extracted: by project key."""
    every = [p for x in found.projects for p in [*x.documents, *x.additional]]
    sums = solution.checksums(spark, [*every, *found.inputs])
    tracked = lambda p, key: {"path": p, "checksum": sums.get(p), "extracted": p in extracted.get(key, ())}
    projects = [
        {"key": x.key, "filePath": x.file, "language": x.language, "loaded": loaded.get(x.key, False), "fingerprint": x.fingerprint, "projectReferences": x.references}
        | ({"documents": [tracked(p, x.key) for p in x.documents], "additionalFiles": [tracked(p, "") for p in x.additional]} if x.language == "C#" else {"documents": [], "additionalFiles": []})
        for x in found.projects
    ]
    return {"solutionPath": found.path, "projects": projects, "inputs": [{"path": p, "checksum": sums.get(p)} for p in found.inputs], "candidateFiles": found.candidates, "hasWorkspaceFailures": found.failures, "sourceRoots": found.roots}


def freshness(spark: SparkSession, baseline: dict) -> tuple[bool, list[str]]:
    """(whether the evaluation may give something else, tracked files of which only the content has changed)."""
    files = [p["filePath"] for p in baseline["projects"]]
    documents = [d["path"] for p in baseline["projects"] for d in p["documents"]]
    folders = solution.top([posixpath.dirname(baseline["solutionPath"]), *(posixpath.dirname(f) for f in files), *baseline["sourceRoots"]])
    below = [x.path for f in folders for x in paths.below(spark, f)]
    known = [x["path"] for x in baseline["inputs"]]
    tracked = list(dict.fromkeys(d["path"] for p in baseline["projects"] for d in [*p["documents"], *p["additionalFiles"]]))
    read = solution.inputs(baseline["solutionPath"], files, known, documents, below + [p for p in known if p not in below and paths.state(spark, p)[0]])
    sums = solution.checksums(spark, [*read, *tracked])
    if [{"path": p, "checksum": sums.get(p)} for p in read] != baseline["inputs"]:
        return True, []
    if solution.candidates(files, baseline["sourceRoots"], below) != baseline["candidateFiles"]:
        return True, []
    was = {d["path"]: d["checksum"] for p in reversed(baseline["projects"]) for d in reversed([*p["documents"], *p["additionalFiles"]])}
    if any(p not in sums for p in tracked):
        return True, []
    return False, [p for p in tracked if sums[p] != was[p]]


def cold(previous: dict, now: dict) -> dict[str, None]:
    """Projects to read whole: new, changed, and those that refer to a changed or removed one, in the old or the new solution."""
    csharp = [p["key"] for p in now["projects"] if p["language"] == "C#"]
    if not previous:
        return dict.fromkeys(csharp)
    old, new = ({p["key"]: p for p in x["projects"]} for x in (previous, now))
    content = lambda p: [p["filePath"], p["language"], p["fingerprint"], p["projectReferences"], [(d["path"], d["checksum"]) for d in p["documents"]], [(d["path"], d["checksum"]) for d in p["additionalFiles"]]]
    changed = {k for k, p in new.items() if k not in old or content(old[k]) != content(p)} | (old.keys() - new.keys())
    links = {(p["key"], r) for x in (previous, now) for p in x["projects"] for r in p["projectReferences"]}
    wanted = closure(changed, links)
    return {k: None for k in csharp if k in wanted}


def warm(session: Session, changed: list[str], now: dict[str, str]) -> dict[str, set[str] | None]:
    """Projects and the documents to read again, of files whose content changed. now: their surfaces. A project is read whole if what it or one that it refers to shows to others has changed."""
    projects = [p for p in session.solution.projects if p.language == "C#"]
    deep = {p.key for p in projects if any(d in now and now[d] != session.surfaces.get(d) for d in p.documents)}
    whole = closure(deep, {(p.key, r) for p in projects for r in p.references})
    out: dict[str, set[str] | None] = {p.key: None for p in projects if p.key in whole}
    for p in projects:
        own = set(changed) & set(p.documents)
        if own and p.key not in whole:
            out[p.key] = own
    return out


def report(baseline: dict, nodes: int, edges: int) -> dict:
    """Coverage of a graph: status, and counts of projects, documents, nodes and edges."""
    csharp = [p for p in baseline["projects"] if p["language"] == "C#"]
    loaded, total = sum(p["loaded"] for p in csharp), sum(len(p["documents"]) for p in csharp)
    read = sum(d["extracted"] for p in csharp if p["loaded"] for d in p["documents"])
    other, skipped = len(baseline["projects"]) - len(csharp), total - read
    status = "failed" if not loaded or not read else "empty" if not nodes else "partial" if baseline["hasWorkspaceFailures"] or other or skipped else "complete"
    return {"status": status, "totalProjects": len(baseline["projects"]), "loadedProjects": loaded, "unsupportedProjects": other, "skippedProjects": len(csharp) - loaded, "totalDocuments": total, "loadedDocuments": read, "skippedDocuments": skipped, "nodeCount": nodes, "edgeCount": edges}


class Synchronizer:
    """Keeps graphs of solutions. One run at a time works on a graph; readers keep the revision that they loaded."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sessions, self.locks, self.guard = spark, {}, {}, threading.Lock()

    def run(self, path: str, reevaluate: bool = False) -> Result | None:
        """Brings the graph of the solution at ``path`` up to date; None if there is neither a solution nor a graph."""
        folder = store.location(path)
        if not paths.state(self.spark, path)[0] and store.revision(self.spark, folder) is None:
            return None
        with self.guard:
            lock = self.locks.setdefault(folder, threading.Lock())
        with lock:
            phase = ["graph_load"]
            try:
                return self._run(path, folder, reevaluate, phase)
            except (AnalysisError, KeyboardInterrupt):
                raise
            except Exception as e:
                raise SyncError(phase[0], e) from e

    def _run(self, path: str, folder: str, reevaluate: bool, phase: list[str]) -> Result:
        spark = self.spark
        stored, revision = store.load(spark, folder), store.revision(spark, folder)
        before = store.baseline(spark, folder) if revision else {}
        if before and not has_search_metadata(stored):
            before = {}
        phase[0] = "freshness"
        evaluation, changed = (True, []) if not before or reevaluate else freshness(spark, before)
        counts = lambda d: (model.nodes(d).count(), model.edges(d).count())
        if not evaluation and not changed:
            return Result(stored, revision, report(before, *counts(stored)), before, {}, False)
        phase[0] = "solution_evaluation_and_extraction"
        session = self.sessions.get(folder)
        is_warm = not evaluation and session is not None and session.revision == revision and session.solution.path == path
        found = session.solution if is_warm else solution.evaluate(spark, path)
        sources = found.sources(spark)
        if is_warm:
            now = surfaces(sources.join(spark.createDataFrame([(p,) for p in changed], "path string"), "path", "left_semi"))
            selection = warm(session, changed, now)
            known = session.surfaces | now
        else:
            selection = cold(before, describe(spark, found, {}, {}))
            known = surfaces(sources)
        merged, loaded, extracted = self._merge(found, stored, before, sources, selection)
        baseline = describe(spark, found, loaded, extracted)
        phase[0] = "index_update"
        merged = snapshots.settle(merged)
        diff = snapshots.freshness(stored.select("project", "path", _state().alias("checksum")), merged.select("project", "path", _state().alias("checksum")))
        if before and baseline == before and diff.isEmpty():
            self.sessions[folder] = Session(found, revision, known)
            return Result(stored, revision, report(before, *counts(stored)), before, selection, False)
        said = report(baseline, *counts(merged))
        if said["status"] in ("failed", "empty"):
            return Result(stored, revision, said, before, selection, False)
        phase[0] = "persistence"
        saved = store.save(merged, folder, baseline)
        self.sessions[folder] = Session(found, saved, known)
        return Result(store.load(spark, folder), saved, said, baseline, selection, True)

    def _merge(self, found: solution.Solution, stored: DataFrame, before: dict, sources: DataFrame, selection: dict[str, set[str] | None]) -> tuple[DataFrame, dict[str, bool], dict[str, set[str]]]:
        """The documents of the next snapshot: selected ones read again, others as they are stored, with the places that they have now."""
        spark = self.spark
        had = {p["key"]: p["loaded"] for p in before.get("projects", ())}
        loaded = {p.key: p.loaded if p.key in selection else had.get(p.key, False) for p in found.projects if p.language == "C#"}
        wanted = [(p.key, d) for p in found.projects if p.key in selection and p.loaded for d in p.documents if selection[p.key] is None or d in selection[p.key]]
        chosen = spark.createDataFrame(wanted, "project string, path string")
        fresh = extract.documents(sources, chosen)
        places = sources.filter(F.col("project").isin([k for k, ok in loaded.items() if ok])).select("project", "path", F.col("project_order").alias("po"), F.col("document_order").alias("do"))
        whole = [k for k, v in selection.items() if v is None]
        reused = stored.filter(~F.col("project").isin(whole)).join(chosen, ["project", "path"], "left_anti").join(places, ["project", "path"])
        moved = reused.withColumn("project_order", F.col("po")).withColumn("document_order", F.col("do")).select(*stored.columns)
        merged = snapshots.settle(moved.unionByName(fresh.select(*stored.columns)))
        extracted: dict[str, set[str]] = {}
        for r in merged.select("project", "path").toLocalIterator():
            extracted.setdefault(r["project"], set()).add(r["path"])
        return merged, loaded, extracted


def _state():
    """A digest of a whole stored document."""
    columns = [c.split()[0] for c in ("checksum", "project_order", "document_order", "nodes", "edges", "namespaces")]
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def scan_status(result: Result | None) -> str:
    """The status line of a run; AnalysisError where there is no graph to speak of."""
    if result is None:
        raise AnalysisError("graph_not_found", "neither a solution nor a stored graph")
    r = result.report
    if r["status"] in ("failed", "empty"):
        raise AnalysisError("scan_empty" if r["status"] == "empty" else "scan_incomplete", f"the scan is {r['status']}; the graph before it stays")
    coverage = f"{r['loadedProjects']} of {r['totalProjects']} projects, {r['loadedDocuments']} of {r['totalDocuments']} documents"
    if r["unsupportedProjects"]:
        coverage += f", {r['unsupportedProjects']} unsupported projects"
    return store.status_line(r["status"], r["nodeCount"], r["edgeCount"], coverage)
