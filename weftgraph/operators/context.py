"""Context views: a few listed files together, with the references between their types.

A context is a list of files (context, pos, path, content). Each context is bound
alone, in one task, and holds at most ``files.MOST_FILES`` different files, so many
contexts are worked on in parallel and none can grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftgraph.sources import binder, csharp, facts, framework

TYPE = "struct<name:string,kind:string,base:string,implements:array<string>,attributes:array<string>,constructor_dependencies:array<string>,methods:array<string>>"
REFERENCE = "struct<`from`:string,`to`:string,via:string,resolved_file:string>"
CONTEXT = f"files array<struct<file:string,namespace:string,types:array<{TYPE}>>>, references array<{REFERENCE}>, unresolved array<string>"


def signature(m: dict) -> str:
    """``[access ]Name(p:T, ...): R`` of a method contract."""
    head = "" if m["access"] == "public" else m["access"] + " "
    return f"{head}{m['name']}({', '.join(f'{p['name']}:{p['type']}' for p in m['parameters'] or [])}): {m['return_type']}"


def _predefined(tree: tuple) -> bool:
    """A built-in type, perhaps with a question mark: no reference."""
    inner = tree[1] if tree[0] == "maybe" else tree
    return inner[0] == "name" and len(inner[1]) == 1 and inner[1][0][0] in facts.PREDEFINED


def _external(found: tuple | None) -> bool:
    """Whether a bound type is known from elsewhere, with all its arguments bound."""
    if found is None:
        return False
    if found[0] == "array":
        return _external(found[1])
    if found[0] == "framework":
        return all(a is not None for a in found[2])
    return found[0] == "predefined"


def analyze(listed: list[tuple[str, str]]) -> dict:
    """The context of files (path, content) in the order given; a path that stands again, in any case, is parsed once and listed again."""
    parsed: dict[str, tuple[facts.Facts, str]] = {}
    for path, content in listed:
        if path.lower() not in parsed:
            parsed[path.lower()] = (facts.Facts(path, content or ""), content or "")
    symbols = binder.Symbols([f for f, _ in parsed.values()])
    kinds = {e.key[-1][0]: "interface" if e.word == "interface" else "class" for e in symbols.types.values()}
    views, references, unresolved = [], {}, {}
    for path, _ in listed:
        own, content = parsed[path.lower()]
        contract = csharp.inspect(path, content, kinds)
        views.append({"file": path, "namespace": contract["namespace"], "types": [
            {k: t[k] for k in ("name", "kind", "base", "implements", "attributes")}
            | {"constructor_dependencies": [p["type"] for p in t["constructor_dependencies"]] if t["constructor_dependencies"] else None, "methods": [signature(m) for m in t["methods"]] if t["methods"] else None}
            for t in contract["types"]
        ]})
        names = {t["name"] for t in contract["types"]}
        for t in own.types:
            name = t.key[-1][0] + (f"<{', '.join(t.own)}>" if t.own else "")
            if name not in names or t.word in ("enum", "delegate"):
                continue

            def refer(tree: tuple, text: str, via: str, scope=t.scope, name=name) -> None:
                found = symbols.bound(tree, scope)
                file = symbols.types[found[1]].file if found and found[0] == "type" else own.path if found and found[0] == "parameter" else None
                if (name, text, via) not in references:
                    references[name, text, via] = {"from": name, "to": text, "via": via, "resolved_file": file}
                    if file is None and not _external(found):
                        unresolved.setdefault(text)

            listed_bases = [(tree, text) for tree, whole, text in t.bases if whole]
            for i, (tree, text) in enumerate(listed_bases):
                refer(tree, text, "base" if not i and _is_base(t, symbols.bound(tree, t.scope), text, symbols) else "implements")
            made = [m for m in t.members if m.word == "constructor"]
            plain = t.primary is not None and not t.word.startswith("record")
            for p in t.primary if plain else max(made, key=lambda m: len(m.parameters)).parameters if made else ():
                if p.type is not None and not _predefined(p.type):
                    refer(p.type, p.text, "constructor")
            for m in t.members:
                if m.word == "method" and m.access != "private":
                    scope = facts.Scope(t.scope.namespace, t.scope.usings, t.scope.aliases, t.scope.types, t.scope.names | set(m.own))
                    for p in m.parameters:
                        if p.type is not None and not _predefined(p.type):
                            refer(p.type, p.text, "parameter", scope)
    return {"files": views, "references": list(references.values()), "unresolved": list(unresolved)}


def _is_base(t: facts.Type, found: tuple | None, text: str, symbols: binder.Symbols) -> bool:
    """Whether the first entry of a base list is a base class: known kinds decide, else, for classes, the name."""
    if t.word not in ("class", "record"):
        return False
    if found and found[0] == "type":
        return symbols.types[found[1]].word != "interface"
    if found and found[0] == "framework":
        return not framework.is_interface(found[1])
    plain = text.split("<")[0].split(".")[-1]
    return t.word == "class" and not (len(plain) > 1 and plain[0] == "I" and plain[1].isupper())


def inspect(contexts: DataFrame) -> DataFrame:
    """(context, files, references, unresolved) of rows (context, pos, path, content)."""
    fields = f"context {dict(contexts.dtypes)['context']}, {CONTEXT}"
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contexts.select("context", "pos", "path", "content").repartition(parts, "context").sortWithinPartitions("context", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, begun = None, [], False
        for batch in batches:
            for r in batch.to_pylist():
                if begun and r["context"] != at:
                    yield pa.RecordBatch.from_pylist([{"context": at} | analyze(held)], arrow)
                    held = []
                at, begun = r["context"], True
                held.append((r["path"], r["content"]))
        if begun:
            yield pa.RecordBatch.from_pylist([{"context": at} | analyze(held)], arrow)

    return rows.mapInArrow(run, fields)
