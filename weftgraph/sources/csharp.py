"""C# declarations: tokens, then a walk over namespaces, types and members.

Bodies are skipped by matched brackets, so only the shape of declarations is
read. Text that can't be read is passed over token by token and named in
``parse_errors``; nothing raises.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property

from weftgraph.sources import framework

ACCESS = ("public", "protected", "internal", "private")
#: Words that may stand before a declaration. Fixed values of the language.
MODIFIERS = frozenset("public protected internal private static abstract sealed partial readonly virtual override async unsafe extern new required volatile const fixed ref file".split())
TYPES = ("class", "struct", "interface", "record", "enum", "delegate")
PASSING = frozenset("ref out in params this scoped readonly".split())

_TOKEN = re.compile(
    r"""(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[ \t]*\#[^\n]*))*+  # blanks, comments and directives are passed over
    (?:(?P<text>\$*(?P<q>\"{3,}).*?(?:(?P=q)\"*|\Z)|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*(?:\"|\Z)|\$?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<name>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>=>|::|==|!=|<=|\?\?|->|.)|(?P<end>\Z))""",
    re.X | re.S,
)
_OPEN = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")


_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|elif|else|endif|define|undef)\b(.*)$", re.M)
_CONDITION = re.compile(r"\s*(\w+|&&|\|\||==|!=|!|\(|\))")


def _holds(condition: str, defined: set[str]) -> bool:
    """The value of a directive's condition; one that can't be read doesn't hold."""
    words, at = [], 0
    condition = condition.split("//")[0].strip()
    while at < len(condition):
        m = _CONDITION.match(condition, at)
        if m is None:
            return False
        words.append(m[1])
        at = m.end()
    words.append("")

    def either() -> bool:
        value = both()
        while words[0] == "||":
            words.pop(0)
            value |= both()
        return value

    def both() -> bool:
        value = equal()
        while words[0] == "&&":
            words.pop(0)
            value &= equal()
        return value

    def equal() -> bool:
        value = one()
        while words[0] in ("==", "!="):
            value = (words.pop(0) == "==") == (value == one())
        return value

    def one() -> bool:
        word = words.pop(0) if words[0] else ""
        if word == "!":
            return not one()
        if word == "(":
            value = either()
            if words[0] == ")":
                words.pop(0)
            return value
        return word == "true" or word != "false" and word in defined

    return either()


def active(text: str) -> str:
    """The text with the branches of ``#if`` that aren't taken blanked out, lines and places kept. No symbol is defined but those that the file defines."""
    out, at, defined = [], 0, set()
    stack: list[list[bool]] = []  # of each open #if: whether its branch is taken, and whether one was
    for m in _DIRECTIVE.finditer(text):
        on = all(x[0] for x in stack)
        part = text[at : m.start()]
        out.append(part if on else re.sub(r"[^\n]", " ", part))
        out.append(m[0])
        at, word = m.end(), m[1]
        if word == "if":
            taken = on and _holds(m[2], defined)
            stack.append([taken, taken])
        elif word in ("elif", "else") and stack:
            around, (_, was) = all(x[0] for x in stack[:-1]), stack[-1]
            taken = around and not was and (word == "else" or _holds(m[2], defined))
            stack[-1] = [taken, was or taken]
        elif word == "endif" and stack:
            stack.pop()
        elif word == "define" and on:
            defined.add(m[2].strip())
        elif word == "undef" and on:
            defined.discard(m[2].strip())
    part = text[at:]
    out.append(part if all(x[0] for x in stack) else re.sub(r"[^\n]", " ", part))
    return "".join(out)


class Source:
    """Tokens of a text, with the partner of each bracket."""

    @classmethod
    def of(cls, content: str | None) -> Source:
        """The tokens of a file's content; null is empty, and a byte order mark goes."""
        return cls((content or "").removeprefix("\ufeff"))

    def __init__(self, text: str):
        text = active(text) if "#" in text else text
        self.text, self.errors = text, []
        self.found = [m for m in _TOKEN.finditer(text) if m.lastgroup != "end"]
        self.kind, self.tok = [m.lastgroup for m in self.found], [m[m.lastgroup] for m in self.found]
        self.partner, stack = {}, []
        for i, t in enumerate(self.tok):
            if t not in _BRACKETS:
                continue
            if t in _OPEN:
                stack.append(i)
            else:
                while stack and _OPEN[self.tok[stack[-1]]] != t:
                    self._lost(stack.pop())
                if stack:
                    self.partner[stack.pop()] = i
                else:
                    self.errors.append(f"line {self.line(i)}: unexpected {t}")
        for i in stack:
            self._lost(i)

    def _lost(self, i: int) -> None:
        self.errors.append(f"line {self.line(i)}: {self.tok[i]} is not closed")

    @cached_property
    def feeds(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line(self, i: int) -> int:
        return bisect_right(self.feeds, (self.found[i].start(self.kind[i]) if i < len(self.found) else len(self.text)) - 1) + 1

    def at(self, i: int) -> str:
        try:
            return self.tok[i]
        except IndexError:
            return ""

    def close(self, i: int) -> int:
        """Where the bracket at i closes; the end of the text where it doesn't."""
        return self.partner.get(i, len(self.tok) - 1)

    def cut(self, i: int, j: int) -> str:
        """Verbatim text of the tokens i to j - 1."""
        return self.text[self.found[i].start(self.kind[i]) : self.found[j - 1].end()] if i < j <= len(self.tok) else ""

    def angle(self, i: int) -> int:
        """Place after the type list that opens with ``<`` at i, or i."""
        depth, j = 0, i
        while j < len(self.tok):
            t = self.tok[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in ("(", "["):
                j = self.close(j)
            elif t in (";", "{", "}", "=>"):
                return i
            j += 1
        return i

    def type_end(self, i: int) -> int:
        """Place after the type that begins at i, or i if none does."""
        j = i
        if self.at(j) == "(":
            j = self.close(j) + 1
        else:
            while self.at(j) in ("ref", "readonly", "scoped"):
                j += 1
            while j < len(self.tok) and self.kind[j] == "name":
                j += 1
                if self.at(j) == "<":
                    j = self.angle(j)
                if self.at(j) in (".", "::") and j + 1 < len(self.tok) and self.kind[j + 1] == "name":
                    j += 1
                    continue
                break
            if j == i:
                return i
        while self.at(j) in ("?", "*") or (self.at(j) == "[" and all(t in (",",) for t in self.tok[j + 1 : self.close(j)])):
            j = self.close(j) + 1 if self.at(j) == "[" else j + 1
        return j

    def split(self, i: int, j: int) -> list[tuple[int, int]]:
        """The token ranges between commas of i to j - 1, outside all brackets."""
        out, first, k = [], i, i
        while k < j:
            t = self.tok[k]
            if self.kind[k] == "sign" and t in _OPEN:
                k = self.close(k)
            elif t == "<":
                k = max(k, self.angle(k) - 1)
            elif t == ",":
                out.append((first, k))
                first = k + 1
            k += 1
        return [*out, (first, min(k, j))] if first < j else out

    def body_end(self, i: int) -> int:
        """Place after a member whose rest begins at i: a block, an arrow or an initializer."""
        while i < len(self.tok):
            t = self.tok[i]
            if t == ";":
                return i + 1
            if t == "{":
                after = self.close(i) + 1
                if self.at(after) == "=":  # an initializer after accessors
                    i = after
                    while i < len(self.tok) and self.tok[i] != ";":
                        i = self.close(i) + 1 if self.tok[i] in _OPEN else i + 1
                    return i + 1
                return after
            if t in ("=>", "="):
                while i < len(self.tok) and self.tok[i] != ";":
                    i = self.close(i) + 1 if self.tok[i] in _OPEN else i + 1
                return i + 1
            i = self.close(i) + 1 if t in _OPEN else i + 1
        return i


def access(modifiers: list[str], default: str) -> str:
    """Access level of a set of modifiers."""
    has = set(modifiers)
    for words in (("public",), ("protected", "internal"), ("private", "protected"), ("protected",), ("internal",), ("private",)):
        if has.issuperset(words):
            return " ".join(words)
    return default


def _attributes(s: Source, i: int) -> tuple[list[str], int]:
    out = []
    while s.at(i) == "[":
        end = s.close(i)
        first = i + 3 if s.at(i + 2) == ":" else i + 1
        out += [s.cut(a, b) for a, b in s.split(first, end) if a < b]
        i = end + 1
    return out, i


def _parameters(s: Source, i: int) -> list[dict]:
    """Parameters of the list that opens at i."""
    out = []
    for a, b in s.split(i + 1, s.close(i)):
        _, a = _attributes(s, a)
        while a < b and s.at(a) in PASSING:
            a += 1
        end = s.type_end(a)
        if a < end < b:
            out.append({"type": s.cut(a, end), "name": s.tok[end].lstrip("@")})
        elif a < b:
            out.append({"type": "", "name": s.tok[b - 1].lstrip("@")})
    return out


def _constraints(s: Source, i: int) -> tuple[list[str], int]:
    """Clauses that begin with ``where``."""
    out = []
    while s.at(i) == "where":
        first = i
        i += 1
        while i < len(s.tok) and s.tok[i] not in ("where", "{", ";", "=>"):
            i = s.close(i) + 1 if s.tok[i] in ("(", "[") else i + 1
        out.append(s.cut(first, i))
    return out, i


def _accessors(s: Source, i: int) -> str:
    """``get; private set;`` of the block at i."""
    out, j, end = [], i + 1, s.close(i)
    while j < end:
        _, j = _attributes(s, j)
        first = j
        while s.at(j) in MODIFIERS:
            j += 1
        out.append(" ".join(s.tok[first : j + 1]) + ";")
        j = s.body_end(j + 1)
    return " ".join(out)


def _or_none(x):
    return x or None


class _Walk:
    def __init__(self, s: Source):
        self.s, self.types, self.kinds = s, [], {}
        self.usings, self.namespaces = [], []

    def container(self, i: int, end: int, depth: int, root: bool) -> None:
        """Declarations of a compilation unit or namespace."""
        s = self.s
        while i < end:
            first = i
            if s.at(i) in ("using", "global") and root and s.at(i + 1) != "(":
                stop = s.body_end(i)
                words = [k for k in range(i, stop - 1) if s.tok[k] not in ("global", "using", "static", "unsafe")]
                if "=" in s.tok[i:stop]:
                    words = list(range(s.tok.index("=", i) + 1, stop - 1))
                if words:
                    self.usings.append(s.cut(words[0], words[-1] + 1))
                while i < stop:
                    i += 1
                continue
            if s.at(i) == "namespace":
                j = s.type_end(i + 1)
                name = s.cut(i + 1, j)
                if name and name not in self.namespaces:
                    self.namespaces.append(name)
                if s.at(j) == "{":
                    self.container(j + 1, s.close(j), depth, False)
                    i = s.close(j) + 1
                else:
                    i = j + 1
                continue
            after = self.declared(i, True)
            i = after if after > first else max(s.body_end(i), first + 1)

    def declared(self, i: int, top: bool) -> int:
        """Reads a type declaration at i; gives the place after it, or i if there is none."""
        s, first = self.s, i
        attributes, i = _attributes(s, i)
        modifiers = []
        while s.at(i) in MODIFIERS:
            modifiers.append(s.tok[i])
            i += 1
        word = s.at(i)
        if word not in TYPES or i + 1 >= len(s.tok) or s.kind[i + 1] != "name" and not (word == "delegate" and s.at(i + 1) == "("):
            return first
        level = access(modifiers, "internal" if top else "private")
        made = dict(name="", kind=word, access=level, base=None, implements=None, attributes=_or_none(attributes), constructor_dependencies=None, methods=None, properties=None, members=None, is_partial="partial" in modifiers or None, generic_constraints=None, events=None)
        slot = len(self.types)
        if word == "delegate":
            end = s.type_end(i + 1)
            name, j = s.at(end).lstrip("@"), s.angle(end + 1) if s.at(end + 1) == "<" else end + 1
            after = s.body_end(j)
            method = dict(name=name, access=level, return_type=s.cut(i + 1, end), start_line=s.line(first), end_line=s.line(min(after, len(s.tok)) - 1), parameters=_or_none(_parameters(s, j)) if s.at(j) == "(" else None, attributes=None, generic_constraints=None, modifiers=None)
            made |= dict(name=name, methods=[method], is_partial=None)
            if level != "private":
                self.types.append(made)
            return after
        valued = word == "record" and s.at(i + 1) == "struct"
        if word == "record" and s.at(i + 1) in ("struct", "class"):
            i += 1
        name, j = s.at(i + 1).lstrip("@"), i + 2
        if s.at(j) == "<":
            j = s.angle(j)
        made["name"] = name + s.cut(i + 2, j)
        if word == "class":
            made["kind"] = "static-class" if "static" in modifiers else "abstract-class" if "abstract" in modifiers else "class"
        self.kinds.setdefault(name, word)
        primary = None
        if s.at(j) == "(":
            primary, j = _parameters(s, j), s.close(j) + 1
        bases = []
        if s.at(j) == ":":
            start = j = j + 1
            while j < len(s.tok) and s.tok[j] not in ("{", ";", "where"):
                j = s.close(j) + 1 if s.tok[j] in ("(", "[") else j + 1
            # Contract: a base with constructor arguments is not listed.
            bases = [s.cut(a, b) for a, b in s.split(start, j) if s.type_end(a) == b]
        constraints, j = _constraints(s, j)
        if level != "private":
            self.types.append(made)
        if word == "enum":
            if s.at(j) == "{":
                made["members"] = [s.at(_attributes(s, a)[1]).lstrip("@") for a, b in s.split(j + 1, s.close(j)) if a < b]
            made["is_partial"] = None
            made["implements"] = None
            return s.close(j) + 1 if s.at(j) == "{" else j + 1
        found = dict(methods=[], properties=[], fields=[], events=[], constructors=[], declared=set())
        if s.at(j) == "{":
            self.members(j + 1, s.close(j), name, word, found)
            after = s.close(j) + 1
            after += s.at(after) == ";"
        else:
            after = j + 1
        positional = []
        if word == "record":
            sets = "get; set;" if valued and "readonly" not in modifiers else "get; init;"
            positional = [dict(name=p["name"], type=p["type"], access="public", is_required=None, accessors=sets) for p in primary or [] if p["name"] not in found["declared"]]
        if primary is not None and word != "record":
            deps = primary
        else:
            deps = max(found["constructors"], key=len, default=[])  # the first of equals
        made |= dict(
            constructor_dependencies=_or_none(deps),
            methods=_or_none(found["methods"]),
            properties=_or_none(positional + found["properties"] + found["fields"]),
            events=_or_none(found["events"]),
            generic_constraints=_or_none(constraints),
            implements=bases,
            base=(word == "class", word == "record" and not valued),
        )
        if slot == len(self.types) or self.types[slot] is not made:
            made["base"] = None
        return after

    def members(self, i: int, end: int, owner: str, kind: str, found: dict) -> None:
        s = self.s
        while i < end:
            first = i
            after = self.declared(i, False)
            if after > first:
                i = after
                continue
            i = max(self.member(i, owner, kind, found), first + 1)

    def member(self, first: int, owner: str, kind: str, found: dict) -> int:
        s = self.s
        attributes, i = _attributes(s, first)
        modifiers = []
        while s.at(i) in MODIFIERS and s.at(i + 1) not in ("(", "=", ";", ","):
            modifiers.append(s.tok[i])
            i += 1
        level = access(modifiers, "public" if kind == "interface" and not modifiers else "private")
        event = s.at(i) == "event"
        i += event
        if s.at(i) == owner and s.at(i + 1) == "(":
            if "static" not in modifiers:
                found["constructors"].append(_parameters(s, i + 1))
            return s.body_end(s.close(i + 1) + 1)
        j = s.type_end(i)
        if j == i or s.at(i) in ("implicit", "explicit") or s.at(i) == "~" or s.at(j) in ("operator", "this"):
            return s.body_end(j if j > i else i)
        result, k = s.cut(i, j), j
        while k < len(s.tok) and s.kind[k] == "name":
            k += 1
            typed = s.angle(k) if s.at(k) == "<" else k
            if s.at(typed) == "." and s.at(typed + 1):
                k = typed + 1
                continue
            break
        if k == j or s.at(k - 1) in ("operator", "this"):
            return s.body_end(k)
        name = s.cut(j, k).replace("@", "")
        if "." in name:
            level = "public"
        if s.at(k) == "(" or (s.at(k) == "<" and s.at(s.angle(k)) == "("):
            at = s.angle(k) if s.at(k) == "<" else k
            constraints, rest = _constraints(s, s.close(at) + 1)
            after = s.body_end(rest)
            if level != "private":
                plain = [m for m in modifiers if m not in ACCESS]
                found["methods"].append(dict(name=name, access=level, return_type=result, start_line=s.line(first), end_line=s.line(min(after, len(s.tok)) - 1), parameters=_or_none(_parameters(s, at)), attributes=_or_none(attributes), generic_constraints=_or_none(constraints), modifiers=_or_none(plain)))
            return after
        made = dict(name=name, type=result, access=level, is_required="required" in modifiers or None, accessors=None)
        after = s.body_end(k)
        if event:
            names = [name] if s.at(k) == "{" else [s.tok[a] for a, b in s.split(j, after - 1)]
            found["events"] += [made | {"name": n, "is_required": None} for n in names if level != "private"]
        elif s.at(k) in ("{", "=>"):
            found["declared"].add(name)
            if level != "private":
                found["properties"].append(made | {"accessors": _accessors(s, k) if s.at(k) == "{" else None})
        else:
            names = [s.tok[a].lstrip("@") for a, b in s.split(j, after - 1)]
            found["declared"].update(names)
            if level == "public" and ("const" in modifiers or {"static", "readonly"} <= set(modifiers)):
                found["fields"] += [made | {"name": n, "is_required": None} for n in names]
        return after

    def settle_bases(self, known_kinds: dict[str, str]) -> None:
        """Splits base lists: a first entry that is a class is the base, the rest is implemented. known_kinds: of names that other files declare."""
        for t in self.types:
            if isinstance(t["base"], tuple):
                of_class, of_record = t["base"]
                entries = t["implements"]
                is_base = False
                if entries and (of_class or of_record):
                    plain = entries[0].split("<")[0].split(".")[-1]
                    known = self.kinds.get(plain) or known_kinds.get(plain)
                    if known is None and framework.find(plain, entries[0].count(",") + 1 if "<" in entries[0] else 0, [*self.usings, *framework.IMPLICIT]):
                        known = "interface" if framework.is_interface(plain) else "class"
                    is_base = known != "interface" if known else of_class and not re.match(r"I[A-Z]", plain)
                t["base"] = entries[0] if is_base else None
                t["implements"] = _or_none(entries[1:] if is_base else entries)


def inspect(path: str, text: str | None, known_kinds: dict[str, str] | None = None) -> dict:
    """The contract of one file: file, namespace, usings, types and parse errors. A null text is an empty one. known_kinds: class or interface by name, of types that other files declare."""
    s = Source((text or "").removeprefix("﻿"))
    walk = _Walk(s)
    walk.container(0, len(s.tok), 0, True)
    walk.settle_bases(known_kinds or {})
    return {"file": path, "namespace": walk.namespaces[0] if walk.namespaces else None, "namespaces": walk.namespaces, "usings": walk.usings, "types": walk.types, "parse_errors": s.errors or None}
