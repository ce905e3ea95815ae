"""Column expressions for paths, access levels and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_source(path: Column) -> Column:
    """A C# document that is neither generated nor built: not ``.g.cs``, not under obj or bin."""
    plain = F.lower(F.translate(path, "\\", "/"))
    return path.isNotNull() & (path != "") & ~plain.rlike(r"\.g\.cs$|/obj/|/bin/")


def checksum(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def access(modifiers: Column, default: str = "internal") -> Column:
    """Access level of an array of modifiers."""
    has = lambda m: F.array_contains(modifiers, m)
    return (
        F.when(has("public"), "public").when(has("protected") & has("internal"), "protected internal").when(has("protected") & has("private"), "private protected")
        .when(has("protected"), "protected").when(has("internal"), "internal").when(has("private"), "private").otherwise(default)
    )


def signature(level: Column, name: Column, parameters: Column, result: Column) -> Column:
    """``[access ]Name(p:T, ...): R``; public is left out. parameters: array of (name, type)."""
    head = F.when(level == "public", "").otherwise(F.concat(level, F.lit(" ")))
    return F.concat(head, name, F.lit("("), F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ", "), F.lit("): "), result)
