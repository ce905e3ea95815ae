"""The four graph queries as a user asks them: an id or terms go in, one JSON text comes out, errors included.

Keys are in camel case and nulls are left out. Results are as long as what they
list; a search lists at most its limit.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import AnalysisError
from weftgraph.operators import model, neighbors, search, traverse


class Graph:
    """The derived tables of one snapshot's documents."""

    def __init__(self, documents: DataFrame):
        self.documents, self.nodes, self.edges = documents, model.nodes(documents), model.edges(documents)

    def known(self, id: str) -> None:
        if model.node(self.nodes, id).isEmpty():
            raise AnalysisError("node_not_found", f"no node {id}")

    def dependencies(self, id: str) -> list[dict]:
        self.known(id)
        rows = neighbors.listed(self.edges, self.nodes, id).orderBy("place").collect()
        return [_present({"id": r["id"], "kind": r["kind"], "direction": r["direction"], "edgeKinds": r["edge_kinds"], "file": r["file"]}) for r in rows]

    def impact(self, id: str) -> dict:
        self.known(id)
        found = traverse.impact(self.edges, id)
        rows = found.join(self.nodes.select("id", "file"), "id", "left").orderBy("rank").collect()
        files = {r["id"]: r["file"] for r in rows if r["file"] is not None}
        return {"affectedIds": [r["id"] for r in rows]} | ({"affectedFiles": files} if files else {})

    def path(self, source: str, target: str) -> list[str]:
        self.known(source)
        self.known(target)
        way = [r["id"] for r in traverse.path(self.edges, source, target, self.nodes).orderBy("step").collect()]
        if not way:
            raise AnalysisError("no_path", f"no path from {source} to {target}")
        return way

    def search(self, terms: list[str | None]) -> dict:
        search.terms(terms)
        rows = search.grouped(self.documents, terms).orderBy("rank").collect()
        files = [{"file": r["file"], "namespaces": r["namespaces"], "fileMatched": r["file_matched"], "methods": [{"name": m["name"], "nodeId": m["node_id"]} for m in r["methods"]]} for r in rows]
        return {"results": files, "truncated": any(r["truncated"] for r in rows)}


def _present(found: dict) -> dict:
    return {k: v for k, v in found.items() if v is not None}


def answer(ask: Callable[[], object]) -> str:
    """The JSON text of a query's result, or of its error."""
    try:
        found = ask()
    except AnalysisError as e:
        found = e.as_dict()
    return json.dumps(found, ensure_ascii=False, separators=(",", ":"))


def unnamed(documents: DataFrame) -> DataFrame:
    """Documents whose nodes lack names or which lack namespaces; a graph that has some is read anew before it is searched."""
    return documents.filter(F.col("namespaces").isNull() | F.exists("nodes", lambda n: n["name"].isNull()))
