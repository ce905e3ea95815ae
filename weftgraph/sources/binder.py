"""Binding of names: symbols of a solution, and the edges that a file's declarations and bodies give.

Without a compiler, names are bound by rules: type parameters, nested types
inside-out with those of base types, namespaces inside-out with their usings and
aliases, then a table of framework names. In bodies a value's type follows from
locals, parameters, fields, properties, calls and creations; an overload is taken
by number and types of its arguments. What can't be bound gives no edge.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from weftgraph.sources import framework
from weftgraph.sources.facts import PREDEFINED, Facts, Member, Scope, type_tree

#: Kinds of declared types in the graph; enums and delegates have none. Fixed values.
KINDS = {"interface": "Interface", "record": "Record", "record struct": "Record", "class": "Class", "struct": "Class"}
_LITERAL = {"text": "string", "number": "int"}
_STOP = frozenset("if while for foreach switch return else do try catch finally throw lock using yield await new typeof sizeof default checked unchecked in is as out ref var case when and or not where select from let get set init add remove const static break continue goto params scoped stackalloc with async delegate null true false".split())


@dataclass
class Entry:
    """A declared type: id, kind, first file, type parameters, and what its declarations hold."""

    key: tuple
    id: str
    kind: str | None
    word: str
    file: str
    own: tuple
    static: bool = False
    bases: list = field(default_factory=list)
    members: list = field(default_factory=list)


@dataclass
class Symbol:
    """A member: id, kind in the graph (or None), its declaration, and the type that holds it."""

    id: str
    kind: str | None
    name: str
    file: str
    member: Member
    scope: Scope
    holder: Entry


def node(x: Entry | Symbol) -> dict:
    """The graph node of a symbol, made once."""
    if (made := vars(x).get("node")) is None:
        holder = x if isinstance(x, Entry) else x.holder
        name = x.key[-1][0] if isinstance(x, Entry) else x.name
        made = x.node = {"id": x.id, "kind": x.kind, "file": x.file, "name": name, "namespace": holder.key[0] or None}
    return made


class Symbols:
    """Declared types and members of a solution, from the facts of its files in document order.

    Where ``files`` are only some of the solution's, spaces names namespaces of the others, and usings all global usings in order.
    """

    def __init__(self, files: list[Facts], spaces: Iterable[str] = (), usings: Iterable[str] = ()):
        self.types: dict[tuple, Entry] = {}
        self._bound: dict[int, tuple[Scope, dict]] = {}
        self._bases: dict[tuple, list[Entry]] = {}
        self._named: dict[tuple, dict[str, list[Symbol]]] = {}
        self._extending: dict[str, list[Symbol]] | None = None
        self.namespaces: set[str] = set(spaces)
        self.usings = tuple(usings) or tuple(u for f in files for u in f.global_usings)
        for f in files:
            for ns in f.namespaces:
                parts = ns.split(".")
                self.namespaces.update(".".join(parts[: i + 1]) for i in range(len(parts)))
        for f in files:
            for t in f.types:
                if t.key not in self.types:
                    outer = self.types.get(t.key[:-1])
                    head = outer.id if outer else t.key[0]
                    name = t.key[-1][0] + (f"<{', '.join(t.own)}>" if t.own else "")
                    self.types[t.key] = Entry(t.key, f"{head}.{name}" if head else name, KINDS.get(t.word), t.word, t.file, t.own)
                entry = self.types[t.key]
                entry.static |= t.static
                entry.bases += [(tree, t.scope) for tree, _, _ in t.bases]
        for f in files:
            for t in f.types:
                self._members(t)
        for entry in self.types.values():
            self._implicit(entry)

    def release(self) -> None:
        """Lets go of the members, which hold their types in turn: what is left goes without a search for circles."""
        for entry in self.types.values():
            entry.members = []
        self._named.clear()

    def _members(self, t) -> None:
        entry = self.types[t.key]
        add = lambda m, kind, id_: entry.members.append(Symbol(id_, kind, m.name, t.file, m, t.scope, entry))
        if t.primary is not None:
            m = Member("constructor", t.key[-1][0], parameters=t.primary, at=t.at)
            add(m, "Method", f"{entry.id}.{m.name}({self._listed(m, t.scope)})")
        for m in t.members:
            face = f"{self._face(m.face, t.scope)}." if m.face else ""
            if m.word in ("method", "constructor"):
                # One scope for all members without type parameters, and so one table of what names in it mean.
                scope = Scope(t.scope.namespace, t.scope.usings, t.scope.aliases, t.scope.types, t.scope.names | set(m.own)) if m.own else t.scope
                own = f"<{', '.join(m.own)}>" if m.own else ""
                add(m, "Method", f"{entry.id}.{face}{m.name}{own}({self._listed(m, scope)})")
                entry.members[-1].scope = scope
                if m.face:
                    entry.members[-1].name = face + m.name
            elif m.word == "property":
                add(m, "Property", f"{entry.id}.{face}{m.name}")
            else:
                add(m, None, f"{entry.id}.{m.name}")
        if t.word.startswith("record"):
            declared = {m.name for m in t.members if m.word in ("property", "field")}
            for p in t.primary or []:
                if p.name not in declared and p.type is not None:
                    add(Member("property", p.name, p.type, at=t.at), "Property", f"{entry.id}.{p.name}")

    def _face(self, face: str, scope: Scope) -> str:
        found = self.resolve(tuple((x, ()) for x in face.split("<")[0].split(".")), scope)
        return self.types[found[1]].id if found and found[0] == "type" else face

    def _implicit(self, entry: Entry) -> None:
        name = entry.key[-1][0]
        made = [x for x in entry.members if x.member.word == "constructor"]
        scope = Scope(entry.key[0], types=(entry.key,), names=frozenset(entry.own))
        if entry.word in ("class", "record") and not made and not entry.static or entry.word in ("struct", "record struct") and not any(not x.member.parameters for x in made):
            entry.members.append(Symbol(f"{entry.id}.{name}()", "Method", name, entry.file, Member("constructor", name), scope, entry))
        if entry.word == "record":
            own = ("name", ((name, tuple(("name", ((x, ()),)) for x in entry.own)),))
            copy = Member("constructor", name, parameters=[])
            copy.result = own
            entry.members.append(Symbol(f"{entry.id}.{name}({entry.id})", "Method", name, entry.file, copy, scope, entry))
            entry.members[-1].member.word = "copy constructor"

    def _listed(self, m: Member, scope: Scope) -> str:
        return ", ".join("".join(f"{w} " for w in p.words if w in ("ref", "out", "in", "params")) + self.shown(p.type, scope) for p in m.parameters)

    def bases(self, key: tuple) -> list[Entry]:
        """Declared base types and interfaces, nearest first."""
        if key not in self._bases:
            self._bases[key] = list(self._above(key, {key}))
        return self._bases[key]

    def _above(self, key: tuple, seen: set) -> Iterator[Entry]:
        for tree, scope in self.types[key].bases:
            found = self.bound(tree, scope)
            if found and found[0] == "type" and found[1] not in seen:
                seen.add(found[1])
                yield self.types[found[1]]
                yield from self._above(found[1], seen)

    def resolve(self, parts: tuple, scope: Scope) -> tuple | None:
        """What a qualified name means: ("type", key, args), ("parameter", name), ("framework", name, args), ("namespace", name) or None."""
        (name, args), rest = parts[0], parts[1:]
        if not args and not rest and name in scope.names:
            return ("parameter", name)
        found = None
        for outer in scope.types:
            found = self._nested(outer, name, len(args), set())
            if found:
                return self._inner(found, args, rest)
        at = scope.namespace
        while True:
            full = f"{at}.{name}" if at else name
            if (at, (name, len(args))) in self.types:
                return self._inner((at, (name, len(args))), args, rest)
            if rest and full in self.namespaces:
                return self._below(full, rest)
            for alias, tree, level in scope.aliases:
                if alias == name and level == at and tree is not None and tree[0] == "name":
                    return self.resolve((*tree[1], *rest), Scope("", names=scope.names))
            for level, using in scope.usings:
                if level == at and (using, (name, len(args))) in self.types:
                    return self._inner((using, (name, len(args))), args, rest)
            if not at:
                break
            at = at.rpartition(".")[0]
        for using in self.usings:
            if (using, (name, len(args))) in self.types:
                return self._inner((using, (name, len(args))), args, rest)
        opened = [u for _, u in scope.usings] + list(self.usings) + list(framework.IMPLICIT)
        if not rest:
            place = framework.find(name, len(args), opened)
            if place is not None:
                return ("framework", f"{place}.{name}", args)
        else:
            whole = ".".join(p[0] for p in parts[:-1])
            if framework.find(parts[-1][0], len(parts[-1][1]), [whole]) is not None:
                return ("framework", f"{whole}.{parts[-1][0]}", parts[-1][1])
        if not args and not rest and name in self.namespaces:
            return ("namespace", name)
        return None

    def _nested(self, key: tuple, name: str, arity: int, seen: set) -> tuple | None:
        if key in seen or key not in self.types:
            return None
        seen.add(key)
        if key[-1] == (name, arity):
            return key
        if (*key, (name, arity)) in self.types:
            return (*key, (name, arity))
        for tree, scope in self.types[key].bases:
            if tree is not None and tree[0] == "name" and tree[1][-1][0] != name:
                base = self.resolve(tree[1], Scope(scope.namespace, scope.usings, scope.aliases, (), scope.names))
                if base and base[0] == "type" and (found := self._nested(base[1], name, arity, seen)):
                    return found
        return None

    def _inner(self, key: tuple, args: tuple, rest: tuple) -> tuple | None:
        for name, more in rest:
            key, args = (*key, (name, len(more))), more
            if key not in self.types:
                return None
        return ("type", key, args)

    def _below(self, namespace: str, rest: tuple) -> tuple | None:
        for i, (name, args) in enumerate(rest):
            if (namespace, (name, len(args))) in self.types:
                return self._inner((namespace, (name, len(args))), args, rest[i + 1 :])
            namespace = f"{namespace}.{name}"
            if namespace not in self.namespaces:
                return None
        return ("namespace", namespace)

    def bound(self, tree: tuple | None, scope: Scope) -> tuple | None:
        """A type as written, as a bound type: ("type", key, bound args), ("framework", name, bound args), ("parameter", name), ("predefined", name), ("array", t)."""
        if tree is None:
            return None
        if (held := self._bound.get(id(scope))) is None:
            held = self._bound[id(scope)] = (scope, {})  # the scope is kept, so its id stays its own
        known = held[1]
        if tree not in known:
            known[tree] = self._bind(tree, scope)
        return known[tree]

    def _bind(self, tree: tuple, scope: Scope) -> tuple | None:
        if tree[0] == "array":
            return ("array", self.bound(tree[1], scope))
        if tree[0] == "maybe":
            inner = self.bound(tree[1], scope)
            valued = inner and (inner[0] == "type" and self.types[inner[1]].word in ("struct", "record struct", "enum") or inner[0] == "predefined" and inner[1] not in ("string", "object"))
            return ("framework", "System.Nullable", (inner,)) if valued else inner
        if tree[0] == "tuple":
            return ("framework", "System.ValueTuple", tuple(self.bound(t, scope) for t in tree[1]))
        if len(tree[1]) == 1 and tree[1][0][0] in PREDEFINED:
            return ("predefined", tree[1][0][0])
        found = self.resolve(tree[1], scope)
        if found and found[0] in ("type", "framework"):
            return (found[0], found[1], tuple(self.bound(a, scope) for a in found[2]))
        return found if found and found[0] == "parameter" else None

    def shown(self, tree: tuple | None, scope: Scope) -> str:
        """A type as written, with names in full."""
        if tree is None:
            return ""
        if tree[0] == "array":
            return self.shown(tree[1], scope) + "[]"
        if tree[0] == "maybe":
            return self.shown(tree[1], scope) + "?"
        if tree[0] == "tuple":
            return f"({', '.join(self.shown(t, scope) for t in tree[1])})"
        if len(tree[1]) == 1 and tree[1][0][0] in PREDEFINED:
            return tree[1][0][0]
        found = self.resolve(tree[1], scope)
        args = tree[1][-1][1]
        listed = f"<{', '.join(self.shown(a, scope) for a in args)}>" if args else ""
        if found and found[0] == "type":
            entry = self.types[found[1]]
            head = entry.id[: -len(f"<{', '.join(entry.own)}>")] if entry.own else entry.id
            return head + listed
        if found and found[0] == "framework":
            return framework.KEYWORDS.get(found[1], found[1] + listed)
        return ".".join(p[0] for p in tree[1]) + listed

    def members(self, key: tuple, name: str) -> list[Symbol]:
        """Members of that name of a type, or of its nearest bases that have some."""
        for entry in (self.types[key], *self.bases(key)):
            if entry.key not in self._named:
                named = self._named[entry.key] = {}
                for m in entry.members:
                    if m.member.word not in ("constructor", "copy constructor", "static constructor"):
                        named.setdefault(m.name, []).append(m)
            if name in self._named[entry.key]:
                return self._named[entry.key][name]
        return []

    def constructors(self, key: tuple) -> list[Symbol]:
        return [m for m in self.types[key].members if m.member.word in ("constructor", "copy constructor")]

    def extensions(self, name: str) -> list[Symbol]:
        if self._extending is None:
            self._extending = {}
            for m in (m for e in self.types.values() if e.static for m in e.members):
                if m.member.word == "method" and m.member.parameters and "this" in m.member.parameters[0].words:
                    self._extending.setdefault(m.name, []).append(m)
        return self._extending.get(name, [])


class Edges:
    """Nodes and edges of one file, each once, in order."""

    def __init__(self, symbols: Symbols):
        self.symbols, self.nodes, self.edges = symbols, {}, {}

    def declare(self, x: Entry | Symbol) -> None:
        if x.id not in self.nodes:
            self.nodes[x.id] = node(x)

    def add(self, source, target, kind: str) -> None:
        if target.kind is not None:
            key = (source.id, target.id, kind)
            if key not in self.edges:
                self.edges[key] = {"source": node(source), "target": node(target), "type": kind}

    def typed(self, source, found: tuple | None, kind: str) -> None:
        """Edges to a bound type: to an array's element; to a generic's definition, and from its arguments on as references (returns stay returns)."""
        if found is None or found[0] in ("parameter", "predefined"):
            return
        if found[0] == "array":
            self.typed(source, found[1], kind)
            return
        if found[0] == "type":
            self.add(source, self.symbols.types[found[1]], kind)
        for arg in found[2]:
            self.typed(source, arg, "RETURNS" if kind == "RETURNS" else "REFERENCES")


def extract(facts: Facts, symbols: Symbols) -> dict:
    """{"nodes", "edges", "namespaces"} of one file."""
    out = Edges(symbols)
    for t in facts.types:
        entry = symbols.types[t.key]
        if entry.kind is None:
            continue
        out.declare(entry)
        for tree, listed, _ in t.bases:
            found = symbols.bound(tree, t.scope) if listed else None
            if found and found[0] == "type":
                out.typed(entry, found, "IMPLEMENTS" if symbols.types[found[1]].word == "interface" else "INHERITS")
        plain = t.primary is not None and not t.word.startswith("record")
        made = [m for m in t.members if m.word == "constructor"]
        for p in t.primary if plain else max(made, key=lambda m: len(m.parameters)).parameters if made else ():
            out.typed(entry, symbols.bound(p.type, t.scope), "INJECTS")
        contain = lambda x: (out.declare(x), out.add(entry, x, "CONTAINS"))
        for x in symbols.constructors(t.key):
            contain(x)
        own = {(x.file, x.member.at, x.name.rpartition(".")[2]): x for x in entry.members}
        of = lambda m: own.get((facts.path, m.at, m.name))
        if t.word.startswith("record"):
            written = {m.name for m in t.members if m.word in ("property", "field")}
            for p in t.primary or []:
                x = next((x for x in entry.members if x.name == p.name and x.member.word == "property"), None)
                if p.name not in written and x:
                    contain(x)
                    out.typed(entry, symbols.bound(p.type, t.scope), "REFERENCES")
        for m in t.members:
            if m.word in ("method", "property"):
                contain(of(m))
        for m in t.members:
            if m.word in ("method", "property", "field"):
                scope = of(m).scope
                out.typed(entry, symbols.bound(m.result, scope), "REFERENCES")
                for p in m.parameters:
                    out.typed(entry, symbols.bound(p.type, scope), "REFERENCES")
        body = lambda source, x, m: [Body(facts, symbols, out, source, x.scope, entry, m, t.primary).scan(a, b) for a, b in m.bodies]
        for m in t.members:
            if m.word == "method":
                x = of(m)
                out.typed(x, symbols.bound(m.result, x.scope), "RETURNS")
                body(x, x, m)
        for word in ("field", "constructor", "property"):
            for m in t.members:
                if m.word == word or word == "constructor" and m.word == "static constructor":
                    x = of(m)
                    body(x if word == "property" else entry, x or Symbol("", None, "", "", m, t.scope, entry), m)
    _program(facts, symbols, out)
    return {"nodes": list(out.nodes.values()), "edges": list(out.edges.values()), "namespaces": facts.namespaces}


def _program(facts: Facts, symbols: Symbols, out: Edges) -> None:
    """Top-level statements, as the entry point of ``Program``."""
    if not facts.statements:
        return
    holder = symbols.types.get(("", ("Program", 0))) or Entry(("", ("Program", 0)), "Program", "Class", "class", facts.path, ())
    main = Member("method", "<Main>$")
    entry = Symbol("Program.<Main>$(string[])", "Method", "<Main>$", facts.path, main, facts.root, holder)
    out.declare(holder)
    out.declare(entry)
    out.add(holder, entry, "CONTAINS")
    body = Body(facts, symbols, out, entry, facts.root, None, main, None)
    body.known["args"] = ("array", ("predefined", "string"))
    for a, b in facts.statements:
        body.scan(a, b)


class Body:
    """Walks one body and adds the edges of its calls, creations, method groups, properties and type tests."""

    def __init__(self, facts: Facts, symbols: Symbols, out: Edges, source, scope: Scope, owner: Entry | None, member: Member, primary: list | None):
        self.s, self.symbols, self.out, self.source, self.scope, self.owner = facts.source, symbols, out, source, scope, owner
        self.known: dict[str, tuple | None] = {p.name: symbols.bound(p.type, scope) for p in [*(primary or []), *member.parameters]}
        self.known |= {"value": symbols.bound(member.result, scope)} if member.word == "property" else {}
        self.wanted = symbols.bound(member.result, scope)
        self.local: dict[str, tuple | None] = {}

    def scan(self, i: int, end: int) -> None:
        s = self.s
        for k in range(i, end):  # local functions are known before they are declared
            if s.kind[k] == "name" and s.at(k + 1) == "(" and k > i and s.at(k - 1) not in (".", "new") and s.at(s.close(k + 1) + 1) in ("=>", "{"):
                before = s.tok[k - 1]
                if s.kind[k - 1] == "name" and before not in _STOP or before in ("]", "?", ">"):
                    self.local[s.tok[k]] = self.symbols.bound(type_tree(s, k - 1)[0], self.scope) if s.kind[k - 1] == "name" else None
                    for p in self._parameters(k + 1):
                        self.known[p.name] = self.symbols.bound(p.type, self.scope)
        self._run(i, end, self.wanted)

    def _parameters(self, i: int) -> list:
        from weftgraph.sources.facts import parameters

        return parameters(self.s, i)

    def _run(self, i: int, end: int, wanted: tuple | None = None) -> tuple | None:
        """Walks the tokens i to end - 1; gives the type of the value they make, as far as one operand alone makes it."""
        s, value, operands, first = self.s, None, 0, i
        while i < end:
            t = s.tok[i]
            if t == "typeof":
                self.out.typed(self.source, self._bound(i + 2), "REFERENCES")
                i = s.close(i + 1) + 1
            elif t in ("is", "case"):
                i = self._pattern(i + 1, end)
                operands += 2
            elif t == "as":
                tree, i = type_tree(s, i + 1)
                value, operands = self.symbols.bound(tree, self.scope), 1
            elif t == "switch" and s.at(i + 1) == "{":
                i = self._arms(i + 1)
                operands += 2
            elif t == "return":
                i += 1
                stop = self._until(i, end, (";",))
                self._run(i, stop, self.wanted)
                i = stop
            elif t in ("(", "[", "{"):
                close = min(s.close(i), end)
                inner = None
                if t == "(" and s.at(close + 1) == "=>":
                    for p in self._lambda(i):
                        self.known[p] = None
                elif t == "{":
                    self._run(i + 1, close)
                else:
                    for a, b in s.split(i + 1, close):
                        inner = self._run(a, b)
                i = close + 1
                if t == "(":
                    i, inner = self._chain(i, end, inner)
                    value, operands = inner, operands + 1
            elif s.kind[i] == "name" and s.at(i - 1) in (",", "{") and s.at(i + 1) == "=>":
                self.known[t] = None
                i += 2
            elif s.kind[i] == "name" and (t not in _STOP or t in ("new", "var")) or t in ("this", "base") or s.kind[i] in ("text", "number"):
                after = self._declared(i, end)
                if after > i:
                    i = after
                    continue
                i, value = self._operand(i, end, wanted)
                operands += 1
            else:
                operands += t in ("==", "!=", "<", ">", "<=", "&", "|", "+", "-", "*", "/", "%")
                i += 1
                if t == "=>":
                    first = i
        return value if operands == 1 and first < end else None

    def _until(self, i: int, end: int, stops: tuple) -> int:
        s = self.s
        while i < end and s.tok[i] not in stops:
            i = s.close(i) + 1 if s.tok[i] in ("(", "[", "{") else i + 1
        return min(i, end)

    def _lambda(self, i: int) -> list[str]:
        return [self.s.tok[b - 1] for a, b in self.s.split(i + 1, self.s.close(i)) if a < b]

    def _bound(self, i: int) -> tuple | None:
        return self.symbols.bound(type_tree(self.s, i)[0], self.scope)

    def _declared(self, i: int, end: int) -> int:
        """Place after ``Type name`` or ``var name``, if a local is declared at i; else i. What it is set to is walked here."""
        s = self.s
        if s.at(i - 1) in (".", "new", "=>", "?") or s.kind[i] != "name":
            return i
        tree, j = type_tree(s, i)
        if tree is None or j >= end or s.kind[j] != "name" or s.tok[j] in _STOP or s.at(j + 1) not in ("=", ";", "in", ",", ")"):
            return i
        if s.at(j + 1) == "(":
            return i
        name, typed = s.tok[j], None if s.tok[i] == "var" else self.symbols.bound(tree, self.scope)
        self.known[name] = typed
        if s.at(j + 1) in ("=", "in"):
            stop = self._until(j + 2, end, (";", ")", ","))
            made = self._run(j + 2, stop, typed)
            if s.tok[i] == "var":
                if s.at(j + 1) == "in":
                    made = made[1] if made and made[0] == "array" else made[2][0] if made and made[0] == "framework" and made[2] else None
                self.known[name] = made
            return stop
        return j + 1

    def _pattern(self, i: int, end: int) -> int:
        """Walks a pattern; adds the types it tests."""
        s = self.s
        while i < end:
            while s.at(i) in ("not", "or", "and"):
                i += 1
            if s.at(i) == "(" and s.kind[i] == "sign":
                self._pattern(i + 1, min(s.close(i), end))
                i = s.close(i) + 1
            elif s.kind[i] == "name" and s.tok[i] not in _STOP:
                tree, j = type_tree(s, i)
                if self._value(tree) is None:
                    self.out.typed(self.source, self.symbols.bound(tree, self.scope), "REFERENCES")
                else:
                    j, _ = self._operand(i, end, None)
                i = j
                if i < end and s.kind[i] == "name" and s.tok[i] not in _STOP:
                    self.known[s.tok[i]] = self.symbols.bound(tree, self.scope)
                    i += 1
            elif s.at(i) == "var":
                self.known[s.at(i + 1)] = None
                i += 2
            elif s.kind[i] in ("text", "number") or s.at(i) in ("null", "true", "false", "default", "<", ">", "<=", ">="):
                i += 1
                if s.at(i) == "=":
                    i += 1
            if s.at(i) == "{" and i < end:
                self._subpatterns(i, min(s.close(i), end))
                i = s.close(i) + 1
            if s.at(i) not in ("not", "or", "and"):
                return i
        return i

    def _subpatterns(self, i: int, end: int) -> None:
        for a, b in self.s.split(i + 1, end):
            at = next((k for k in range(a, b) if self.s.tok[k] == ":"), b)
            if at < b:
                self._pattern(at + 1, b)

    def _value(self, tree: tuple | None) -> object | None:
        """What a name stands for other than a type: a local or a member."""
        if tree is None or tree[0] != "name" or len(tree[1]) != 1 or tree[1][0][1]:
            return None
        name = tree[1][0][0]
        return name if name in self.known else next(iter(self._own(name)), None)

    def _arms(self, i: int) -> int:
        """Arms of a switch expression."""
        s = self.s
        for a, b in s.split(i + 1, s.close(i)):
            at = self._pattern(a, b)
            arrow = next((k for k in range(at, b) if s.tok[k] == "=>"), b)
            self._run(at, arrow)
            self._run(arrow + 1, b, self.wanted)
        return s.close(i) + 1

    def _own(self, name: str) -> list[Symbol]:
        """Members that a simple name means: of the enclosing types, inside-out."""
        for key in self.scope.types:
            if key in self.symbols.types and (found := self.symbols.members(key, name)):
                return found
        return []

    def _operand(self, i: int, end: int, wanted: tuple | None) -> tuple[int, tuple | None]:
        """Walks a value with what follows it by dots and brackets; gives the place after it and its type."""
        s, t = self.s, self.s.tok[i]
        if t == "new":
            return self._new(i + 1, end, wanted)
        if s.kind[i] in ("text", "number"):
            if s.tok[i].startswith("$"):
                pass  # holes of interpolated strings aren't read
            return self._chain(i + 1, end, ("predefined", _LITERAL[s.kind[i]]))
        if t in ("this", "base"):
            key = self.owner.key if self.owner else None
            if t == "base" and key:
                key = next((e.key for e in self.symbols.bases(key) if e.word != "interface"), None)
            return self._chain(i + 1, end, ("type", key, ()) if key else None)
        name, args, j = t.lstrip("@"), (), i + 1
        if s.at(j) == "<" and (k := s.angle(j)) > j and s.at(k) in ("(", ".", ")", ";", ","):
            args, j = tuple(self._bound(a) for a, _ in s.split(j + 1, k - 1)), k
        if name in self.known and not args:
            return self._chain(j, end, self.known[name])
        if name in self.local:
            if s.at(j) == "(":
                self._arguments(j)
                return self._chain(s.close(j) + 1, end, self.local[name])
            return j, None
        if found := self._own(name):
            return self._member(found, j, end, args, None)
        if s.at(j) == "(" and not args and name == "nameof":
            self._arguments(j)
            return s.close(j) + 1, ("predefined", "string")
        # A type or a namespace: the longest name that is one.
        parts, at, best = [(t.lstrip("@"), args)], j, None
        while True:
            written = tuple((n, (None,) * len(a)) for n, a in parts)
            found = self.symbols.resolve(written, self.scope)
            if found and found[0] in ("type", "framework"):
                best = (at, (found[0], found[1], parts[-1][1]))
                break
            if s.at(at) != "." or at + 1 >= end or s.kind[at + 1] != "name":
                break
            n, at, more = s.tok[at + 1], at + 2, ()
            if s.at(at) == "<" and (k := s.angle(at)) > at:
                more, at = tuple(self._bound(a) for a, _ in s.split(at + 1, k - 1)), k
            parts.append((n, more))
        if best:
            return self._chain(best[0], end, best[1])
        return self._chain(j, end, None)

    def _chain(self, i: int, end: int, value: tuple | None) -> tuple[int, tuple | None]:
        """Members, calls, indexes and marks behind a value."""
        s = self.s
        while i < end:
            t = s.tok[i]
            if t == "!" and s.at(i + 1) not in ("=",) or t == "?" and s.at(i + 1) in (".", "["):
                i += 1
            elif t == "." and i + 1 < end and s.kind[i + 1] == "name":
                name, args, j = s.tok[i + 1].lstrip("@"), (), i + 2
                if s.at(j) == "<" and (k := s.angle(j)) > j and s.at(k) in ("(", ".", ")", ";", ",", "}"):
                    args, j = tuple(self._bound(a) for a, _ in s.split(j + 1, k - 1)), k
                found = self.symbols.members(value[1], name) if value and value[0] == "type" else []
                if not found and value is not None:
                    found = [] if s.at(j) != "(" else self._extensions(name, value)
                if found:
                    i, value = self._member(found, j, end, args, value)
                    continue
                if value and value[0] == "type" and (*value[1], (name, len(args))) in self.symbols.types:
                    i, value = j, ("type", (*value[1], (name, len(args))), args)
                    continue
                # A member of the framework: its type arguments, and those of a generic receiver.
                if value is None or value[0] != "type":
                    for arg in (*args, *(value[2] if value and value[0] == "framework" and s.at(j) == "(" else ())):
                        self.out.typed(self.source, arg, "REFERENCES")
                value = None
                i = j
                if s.at(i) == "(":
                    self._arguments(i)
                    i = s.close(i) + 1
            elif t == "(":
                self._arguments(i)
                i, value = s.close(i) + 1, None
            elif t == "[":
                self._arguments(i)
                value = value[1] if value and value[0] == "array" else value[2][-1] if value and value[0] == "framework" and value[2] else None
                i = s.close(i) + 1
            elif t in ("++", "--"):
                i += 1
            else:
                return i, value
        return i, value

    def _arguments(self, i: int) -> list[tuple | None]:
        """Walks the arguments of the list that opens at i; gives their types."""
        s, out = self.s, []
        for a, b in s.split(i + 1, s.close(i)):
            if a < b:
                if s.at(a + 1) == ":" and s.kind[a] == "name" and s.at(a + 2) != ":":
                    a += 2
                while s.at(a) in ("ref", "out", "in"):
                    a += 1
                out.append(self._run(a, b))
        return out

    def _extensions(self, name: str, value: tuple) -> list[Symbol]:
        found = []
        for x in self.symbols.extensions(name):
            want = self.symbols.bound(x.member.parameters[0].type, x.scope)
            if self._fits(value, want) is not None:
                found.append(x)
        return found

    def _fits(self, have: tuple | None, want: tuple | None) -> int | None:
        """How well a value's type fits a parameter: 2 the same, 1 a base or unknown, None not at all."""
        if have is None or want is None or want[0] == "parameter" or want == ("predefined", "object"):
            return 1
        if have[:2] == want[:2] and have[0] != "array":
            return 2
        if have[0] == "array" and want[0] == "array":
            return self._fits(have[1], want[1])
        if have[0] == "type" and want[0] == "type":
            return 1 if any(e.key == want[1] for e in self.symbols.bases(have[1])) else None
        if have[0] == "predefined" and want[0] == "predefined":
            return 1 if have[1] == "int" and want[1] in ("long", "float", "double", "decimal", "uint", "ulong", "short", "byte") else None
        return 1 if "framework" in (have[0], want[0]) and want[0] != "predefined" and have[0] != "predefined" else None

    def _choose(self, found: list[Symbol], values: list, shift: bool) -> Symbol | None:
        """The overload that takes the arguments best; the first of equals."""
        best, most = None, -1
        for x in found:
            params = x.member.parameters[1:] if shift and x.member.parameters and "this" in x.member.parameters[0].words else x.member.parameters
            if x.member.word == "copy constructor":
                params = [type("P", (), {"type": x.member.result, "default": False, "words": ()})]
            spread = bool(params) and "params" in params[-1].words
            if len(values) > len(params) and not spread or len(values) < sum(not p.default and "params" not in p.words for p in params):
                continue
            fits = []
            for v, p in zip(values, params):
                want = self.symbols.bound(p.type, x.scope)
                fit = self._fits(v, want)
                if fit is None and "params" in p.words and want and want[0] == "array":
                    fit = self._fits(v, want[1])
                fits.append(fit)
            if None not in fits and (score := sum(fits) * 4 + (len(params) == len(values))) > most:
                best, most = x, score
        return best

    def _member(self, found: list[Symbol], j: int, end: int, args: tuple, holder: tuple | None) -> tuple[int, tuple | None]:
        """A member of a source type, used as a call, a method group, a property or a field."""
        s, first = self.s, found[0]
        if first.member.word == "method":
            if s.at(j) == "(":
                values = self._arguments(j)
                x = self._choose(found, values, holder is not None and any("this" in p.words for p in first.member.parameters))
                j = s.close(j) + 1
            else:
                x, values = first, []
            if x is None:
                return self._chain(j, end, None)
            self.out.add(self.source, x, "CALLS")
            bound = self._inferred(x, args, values, holder)
            for arg in (*bound.values(), *(holder[2] if holder and holder[0] == "type" else ())):
                self.out.typed(self.source, arg, "REFERENCES")
            result = self.symbols.bound(x.member.result, x.scope)
            return self._chain(j, end, self._put(result, bound | self._given(holder)))
        if first.member.word == "property":
            self.out.add(self.source, first, "REFERENCES")
        value = self._put(self.symbols.bound(first.member.result, first.scope), self._given(holder))
        return self._chain(j, end, value)

    def _given(self, holder: tuple | None) -> dict:
        """Type arguments of a closed generic, by name."""
        if not holder or holder[0] != "type" or not holder[2]:
            return {}
        return dict(zip(self.symbols.types[holder[1]].own, holder[2]))

    def _put(self, found: tuple | None, given: dict) -> tuple | None:
        if found is None or not given:
            return found
        if found[0] == "parameter":
            return given.get(found[1], found)
        if found[0] == "array":
            return ("array", self._put(found[1], given))
        return (*found[:2], tuple(self._put(a, given) for a in found[2])) if found[0] in ("type", "framework") else found

    def _inferred(self, x: Symbol, args: tuple, values: list, holder: tuple | None) -> dict:
        """Type arguments of a call, written or from the arguments' types."""
        own = x.member.own
        if not own or args:
            return dict(zip(own, args))
        params = x.member.parameters
        if params and "this" in params[0].words and holder is not None and len(values) < len(params):
            values = [holder, *values]
        out: dict = {}

        def match(want: tuple | None, have: tuple | None) -> None:
            if want is None or have is None:
                return
            if want[0] == "parameter" and want[1] in own:
                out.setdefault(want[1], have)
            elif want[0] == have[0] == "array":
                match(want[1], have[1])
            elif want[:2] == have[:2] and want[0] in ("type", "framework"):
                for a, b in zip(want[2], have[2]):
                    match(a, b)

        for p, v in zip(params, values):
            match(self.symbols.bound(p.type, x.scope), v)
        return out

    def _new(self, i: int, end: int, wanted: tuple | None) -> tuple[int, tuple | None]:
        """A creation, behind ``new``."""
        s = self.s
        if s.at(i) in ("[", "{"):  # an array or an anonymous type
            if s.at(i) == "[":
                i = s.close(i) + 1
            self._run(i + 1, s.close(i))
            return s.close(i) + 1, None
        if s.at(i) == "(":
            made, j = wanted, i
        else:
            tree, j = type_tree(s, i)
            if s.at(j) == "[":  # an array of a given length
                self._arguments(j)
                j, made = s.close(j) + 1, ("array", self.symbols.bound(tree, self.scope))
                if s.at(j) == "{":
                    self._run(j + 1, s.close(j))
                    j = s.close(j) + 1
                return self._chain(j, end, made)
            made = self.symbols.bound(tree, self.scope)
        values = []
        if s.at(j) == "(":
            values = self._arguments(j)
            j = s.close(j) + 1
        if made and made[0] == "type":
            x = self._choose(self.symbols.constructors(made[1]), values, False)
            if x:
                self.out.add(self.source, x, "CALLS")
        for arg in made[2] if made and made[0] in ("type", "framework") else ():
            self.out.typed(self.source, arg, "REFERENCES")
        if s.at(j) == "{":
            self._initializer(j, made)
            j = s.close(j) + 1
        return self._chain(j, end, made)

    def _initializer(self, i: int, made: tuple | None) -> None:
        s = self.s
        for a, b in s.split(i + 1, s.close(i)):
            if a < b and s.kind[a] == "name" and s.at(a + 1) == "=":
                found = self.symbols.members(made[1], s.tok[a]) if made and made[0] == "type" else []
                typed = None
                if found:
                    typed = self.symbols.bound(found[0].member.result, found[0].scope)
                    if found[0].member.word == "property":
                        self.out.add(self.source, found[0], "REFERENCES")
                if s.at(a + 2) == "{":
                    self._initializer(a + 2, typed)
                else:
                    self._run(a + 2, b, typed)
            else:
                self._run(a, b)
