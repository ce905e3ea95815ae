"""Names by which the declarations that a file can look up are found: those it declares, uses, and uses in declarations."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

from weftgraph.sources.facts import Facts, Type


def declared(facts: Facts) -> list[str]:
    """Names of types, nested ones included, and of extension methods."""
    found = {t.key[-1][0] for t in facts.types}
    found |= {m.name for t in facts.types for m in t.members if m.word == "method" and m.parameters and "this" in m.parameters[0].words}
    return sorted(found)


def used(facts: Facts) -> list[str]:
    """All names in the text, and that of the type that top-level statements belong to."""
    s = facts.source
    found = {t.lstrip("@") for t, k in zip(s.tok, s.kind) if k == "name"}
    return sorted(found | {"Program"} if facts.statements else found)


def needed(facts: Facts) -> list[str]:
    """Names that other files may look up on account of this one's declarations: of its types, for their other parts, and of what they are written with."""
    out: set[str] = set()
    for t in facts.types:
        out.update(_of_type(t))
    return sorted(out)


def _of_type(t: Type) -> Iterator[str]:
    yield from (part[0] for part in t.key if isinstance(part, tuple))
    for _, tree, _ in t.scope.aliases:
        yield from _of_tree(tree)
    for tree, _, _ in t.bases:
        yield from _of_tree(tree)
    for p in t.primary or ():
        yield from _of_tree(p.type)
    for m in t.members:
        yield from _of_tree(m.result)
        for p in m.parameters:
            yield from _of_tree(p.type)
        if m.face:
            yield from re.findall(r"\w+", m.face)


def _of_tree(tree: tuple | None) -> Iterator[str]:
    if tree is None:
        return
    if tree[0] in ("array", "maybe"):
        yield from _of_tree(tree[1])
    elif tree[0] == "tuple":
        for t in tree[1]:
            yield from _of_tree(t)
    else:
        for name, args in tree[1]:
            yield name
            for a in args:
                yield from _of_tree(a)


def _common() -> bytes:
    """A packed sample with every kind of declaration."""
    text = "using System;\nusing System.Collections.Generic;\nnamespace N;\npublic static class E { public static int X<T>(this T a) => 1; }\npublic interface I { string Name { get; } }\npublic record R(int A);\npublic class C(I i) : B, I\n{\n    private readonly int f = 1;\n    public C(string s) { }\n    public string Name => null;\n    public void M() { }\n    public static Task<List<int>> Run(string? note = null, bool[] on) { }\n    public event Action Moved;\n}\n"
    found = Facts("/Folder/File.cs", text)
    found.source, found.statements = None, []
    return pickle.dumps(found, pickle.HIGHEST_PROTOCOL)


#: Fixed for one version of the code, in all processes: what packed declarations have in common.
COMMON = _common()
