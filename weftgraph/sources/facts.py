"""Declarations of a C# file with their scopes, for binding: types, members, the types they are written with, and where their bodies are.

A type as written is a tree: ("name", ((identifier, arguments), ...)) for a
qualified name, ("array", t), ("maybe", t) for ``t?``, ("tuple", (t, ...)). An
argument that is left open, as in ``IStore<,>``, is None.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from weftgraph.sources.csharp import MODIFIERS, PASSING, TYPES, Source, _attributes, _constraints, access

#: Built-in type names. Fixed values of the language.
PREDEFINED = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort object string void dynamic nint nuint".split())


@dataclass
class Scope:
    """What names mean at a place: namespace, usings by the namespace they stand in, aliases, enclosing types (keys) and type parameters."""

    namespace: str
    usings: tuple = ()
    aliases: tuple = ()
    types: tuple = ()
    names: frozenset = frozenset()


@dataclass
class Parameter:
    type: tuple | None
    name: str
    words: tuple = ()
    default: bool = False
    text: str = ""


@dataclass
class Member:
    word: str
    name: str
    result: tuple | None = None
    own: tuple = ()
    parameters: list = field(default_factory=list)
    static: bool = False
    bodies: list = field(default_factory=list)
    face: str = ""
    at: int = 0
    access: str = ""


@dataclass
class Type:
    key: tuple
    word: str
    scope: Scope
    own: tuple
    static: bool = False
    bases: list = field(default_factory=list)
    primary: list | None = None
    members: list = field(default_factory=list)
    file: str = ""
    at: int = 0


def type_tree(s: Source, i: int) -> tuple[tuple | None, int]:
    """(the type that begins at i, place after it)."""
    if s.at(i) == "(":
        parts = [type_tree(s, a)[0] for a, b in s.split(i + 1, s.close(i)) if a < b]
        tree, j = ("tuple", tuple(parts)), s.close(i) + 1
    else:
        while s.at(i) in PASSING or s.at(i) == "global" and s.at(i + 1) == "::":
            i += 2 if s.at(i) == "global" else 1
        parts, j = [], i
        while j < len(s.tok) and s.kind[j] == "name":
            name, j, args = s.tok[j].lstrip("@"), j + 1, ()
            if s.at(j) == "<":
                end = s.angle(j)
                if end > j:
                    inner = range(j + 1, end - 1)
                    if all(s.tok[k] == "," for k in inner):
                        args = (None,) * (len(inner) + 1)
                    else:
                        args = tuple(type_tree(s, a)[0] for a, b in s.split(j + 1, end - 1))
                    j = end
            parts.append((name, args))
            if s.at(j) in (".", "::") and j + 1 < len(s.tok) and s.kind[j + 1] == "name":
                j += 1
                continue
            break
        if not parts:
            return None, i
        tree = ("name", tuple(parts))
    while s.at(j) in ("?", "*") or (s.at(j) == "[" and all(t == "," for t in s.tok[j + 1 : s.close(j)])):
        tree = ("array", tree) if s.at(j) == "[" else ("maybe", tree) if s.at(j) == "?" else tree
        j = s.close(j) + 1 if s.at(j) == "[" else j + 1
    return tree, j


def _names(s: Source, i: int) -> tuple[tuple, int]:
    """Type parameters of the list that opens at i, if one does."""
    if s.at(i) != "<":
        return (), i
    end = s.angle(i)
    return tuple(s.tok[b - 1] for a, b in s.split(i + 1, end - 1)), end


def parameters(s: Source, i: int) -> list[Parameter]:
    out = []
    for a, b in s.split(i + 1, s.close(i)):
        _, a = _attributes(s, a)
        first = a
        while a < b and s.at(a) in PASSING:
            a += 1
        tree, j = type_tree(s, a)
        if j < b:
            out.append(Parameter(tree, s.tok[j].lstrip("@"), tuple(s.tok[first:a]), s.at(j + 1) == "=", s.cut(a, j)))
    return out


class Facts:
    """Types of a file in order, nested ones after their parent, and its top-level statements."""

    def __init__(self, path: str, text: str):
        self.path, self.source = path, Source.of(text)
        self.types: list[Type] = []
        self.namespaces: list[str] = []
        self.statements: list[tuple[int, int]] = []
        self.global_usings: list[str] = []
        self.root = Scope("")
        self._unit(0, len(self.source.tok), self.root)

    def _unit(self, i: int, end: int, scope: Scope) -> None:
        s, usings, aliases = self.source, list(scope.usings), list(scope.aliases)
        here = lambda: Scope(scope.namespace, tuple(usings), tuple(aliases))
        while i < end:
            if s.at(i) in ("using", "global") and s.at(i + 1) not in ("(", "::") and self._directive(i):
                stop = s.body_end(i)
                words = [k for k in range(i, stop - 1) if s.tok[k] not in ("global", "using", "static", "unsafe")]
                if "=" in s.tok[i:stop]:
                    at = s.tok.index("=", i)
                    aliases.append((s.tok[at - 1], type_tree(s, at + 1)[0], scope.namespace))
                elif words and "static" not in s.tok[i:stop]:
                    name = "".join(s.tok[words[0] : words[-1] + 1])
                    if s.at(i) == "global":
                        self.global_usings.append(name)
                    else:
                        usings.append((scope.namespace, name))
                i = stop
            elif s.at(i) == "namespace":
                j = s.type_end(i + 1)
                name = "".join(s.tok[i + 1 : j])
                full = f"{scope.namespace}.{name}" if scope.namespace else name
                if full not in self.namespaces:
                    self.namespaces.append(full)
                inner = Scope(full, tuple(usings), tuple(aliases))
                if s.at(j) == "{":
                    self._unit(j + 1, s.close(j), inner)
                    i = s.close(j) + 1
                else:
                    self._unit(j + 1, end, inner)
                    i = end
            else:
                after = self._type(i, here(), None)
                if after == i:
                    after = max(self._statement(i, end), i + 1)
                    if not scope.namespace and s.at(i) not in (";", "["):
                        self.statements.append((i, after))
                        self.root = here()
                i = after

    def _directive(self, i: int) -> bool:
        s = self.source
        j = i + 1 + (s.at(i) == "global" or s.at(i + 1) in ("static", "unsafe"))
        tree, k = type_tree(s, j)
        return tree is not None and s.at(k) in (";", "=") and not (s.at(k) == "=" and s.at(j) == "var")

    def _statement(self, i: int, end: int) -> int:
        s = self.source
        while i < end:
            if s.tok[i] == ";":
                return i + 1
            if s.tok[i] == "{":
                i = s.close(i) + 1
                if s.at(i) not in (";", ")", ",", ".", "else", "catch", "finally", "while"):
                    return i
                continue
            i = s.close(i) + 1 if s.tok[i] in ("(", "[") else i + 1
        return i

    def _type(self, i: int, scope: Scope, outer: Type | None) -> int:
        """Reads a type declaration at i; gives the place after it, or i if there is none."""
        s, first = self.source, i
        _, i = _attributes(s, i)
        words = []
        while s.at(i) in MODIFIERS:
            words.append(s.tok[i])
            i += 1
        word = s.at(i)
        if word not in TYPES or i + 1 >= len(s.tok) or s.kind[i + 1] != "name" and not (word == "delegate" and s.at(i + 1) == "("):
            return first
        head = outer.key if outer else (scope.namespace,)
        if word == "delegate":
            end = s.type_end(i + 1)
            own, j = _names(s, end + 1)
            self.types.append(Type((*head, (s.at(end).lstrip("@"), len(own))), word, scope, own, file=self.path, at=first))
            return s.body_end(j)
        if word == "record" and s.at(i + 1) in ("struct", "class"):
            i += 1
        own, j = _names(s, i + 2)
        key = (*head, (s.at(i + 1).lstrip("@"), len(own)))
        inside = Scope(scope.namespace, scope.usings, scope.aliases, (key, *scope.types), scope.names | set(own))
        made = Type(key, f"{word} struct" if s.at(i) == "struct" and word == "record" else word, inside, own, "static" in words, file=self.path, at=first)
        self.types.append(made)
        if s.at(j) == "(":
            made.primary, j = parameters(s, j), s.close(j) + 1
        if s.at(j) == ":":
            start = j = j + 1
            while j < len(s.tok) and s.tok[j] not in ("{", ";", "where"):
                j = s.close(j) + 1 if s.tok[j] in ("(", "[") else j + 1
            for a, b in s.split(start, j):
                tree, end = type_tree(s, a)
                made.bases.append((tree, end == b, s.cut(a, b)))  # a base with constructor arguments gives no edge, but has members
        _, j = _constraints(s, j)
        if s.at(j) != "{":
            return j + 1
        end, after = s.close(j), s.close(j) + 1
        k = j + 1 if word != "enum" else end
        while k < end:
            nxt = self._type(k, inside, made)
            k = nxt if nxt > k else max(self._member(k, made), k + 1)
        return after + (s.at(after) == ";")

    def _member(self, first: int, owner: Type) -> int:
        s = self.source
        _, i = _attributes(s, first)
        words = []
        while s.at(i) in MODIFIERS and s.at(i + 1) not in ("(", "=", ";", ","):
            words.append(s.tok[i])
            i += 1
        static = "static" in words or "const" in words
        event = s.at(i) == "event"
        i += event
        if s.at(i) == owner.key[-1][0] and s.at(i + 1) == "(":
            j = s.close(i + 1) + 1
            while s.at(j) not in ("{", "=>", ";", ""):
                j = s.close(j) + 1 if s.at(j) in ("(", "[") else j + 1
            after = s.body_end(j)
            if not static:
                owner.members.append(Member("constructor", owner.key[-1][0], parameters=parameters(s, i + 1), bodies=self._bodies(j, after), at=first))
            else:
                owner.members.append(Member("static constructor", owner.key[-1][0], static=True, bodies=self._bodies(j, after), at=first))
            return after
        result, j = type_tree(s, i)
        if j == i or s.at(i) in ("implicit", "explicit", "~") or s.at(j) in ("operator", "this"):
            return s.body_end(j if j > i else i)
        k = j
        while k < len(s.tok) and s.kind[k] == "name":
            k += 1
            typed = s.angle(k) if s.at(k) == "<" else k
            if s.at(typed) == "." and s.at(typed + 1):
                k = typed + 1
                continue
            break
        if k == j or s.at(k - 1) in ("operator", "this"):
            return s.body_end(k)
        name, face = s.tok[k - 1].lstrip("@"), "".join(s.tok[j : k - 2]) if k - j > 2 else ""
        if s.at(k) == "(" or s.at(k) == "<" and s.at(s.angle(k)) == "(":
            own, at = _names(s, k)
            _, rest = _constraints(s, s.close(at) + 1)
            after = s.body_end(rest)
            owner.members.append(Member("method", name, result, own, parameters(s, at), static, self._bodies(rest, after), face, first, "public" if face else access(words, "public" if owner.word == "interface" and not words else "private")))
            return after
        after = s.body_end(k)
        if event:
            owner.members.append(Member("event", name, result, static=static, at=first))
        elif s.at(k) in ("{", "=>"):
            owner.members.append(Member("property", name, result, static=static, bodies=self._bodies(k, after), face=face, at=first))
        else:
            for a, b in s.split(j, after - 1):
                begin = next((x for x in range(a, b) if s.tok[x] == "="), b)
                owner.members.append(Member("field", s.tok[a].lstrip("@"), result, static=static, bodies=[(begin + 1, b)] if begin < b else [], at=first))
        return after

    def _bodies(self, i: int, end: int) -> list[tuple[int, int]]:
        """Token ranges of a block with what follows it, or of an arrow or initializer."""
        s = self.source
        if s.at(i) in ("=>", "="):
            return [(i + 1, end - 1)]
        if s.at(i) != "{":
            return []
        close = s.close(i)
        out = [(i + 1, close)]
        return [*out, (close + 2, end - 1)] if s.at(close + 1) == "=" else out


def surface(facts: Facts) -> str:
    """The text of a file without the bodies of its methods, constructors and properties: what other files can depend on."""
    s, gone = facts.source, set()
    for t in facts.types:
        for m in t.members:
            if m.word != "field":
                for a, b in m.bodies:
                    gone.update(range(a, b))
    return " ".join(t for i, t in enumerate(s.tok) if i not in gone)
