"""Graph documents from C# sources: facts of each file, symbols of each solution, edges of each file.

Files are read alone, in one pass, to their declarations. To bind a file, a task
needs declarations of its solution but no other body, so a solution's files are
dealt to tasks of about ``FILES`` each, and every one of them first gets the
declarations that its files can look up: those of names that they use, and of names
that these declarations use in turn.
"""

from __future__ import annotations

import gc
import pickle
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftgraph.functions import text
from weftgraph.operators import model
from weftgraph.snapshots.snapshots import drop, release, settle
from weftgraph.sources import names
from weftgraph.sources.binder import Symbols, extract
from weftgraph.sources.csharp import Source
from weftgraph.sources.facts import Facts

#: Files that a task binds (about); documents written at once; rounds after which a task gets every declaration.
FILES, WRITTEN, ROUNDS = 2000, 200, 40
#: What a source row has.
SOURCE = "solution string, project string, path string, project_order int, document_order int, content string"
#: What reading a file adds to its row.
FOUND = "declared array<string>, used array<string>, needed array<string>, spaces array<string>, usings array<string>, facts binary"
#: Bytes that packed declarations have in common.
_COMMON = names.COMMON


@contextmanager
def _calm() -> Iterator[None]:
    """No collections of garbage but those asked for: a task's symbols live until its end and would be walked again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.unfreeze()
        gc.enable()


def _declared(found: Facts) -> bytes:
    """The declarations of a file, packed, with the places of its top-level statements."""
    found.source = None
    packer = zlib.compressobj(1, zdict=_COMMON)
    return packer.compress(pickle.dumps(found, pickle.HIGHEST_PROTOCOL)) + packer.flush()


def _unpacked(packed: bytes) -> Facts:
    return pickle.loads(zlib.decompressobj(zdict=_COMMON).decompress(packed))


def declarations(sources: DataFrame) -> DataFrame:
    """(solution, project_order, document_order, path, facts) of each file of SOURCE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_declared(Facts(p, c)) for p, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary())], names=["solution", "project_order", "document_order", "path", "facts"])

    rows = sources.select("solution", "project_order", "document_order", "path", "content")
    return rows.mapInArrow(run, "solution string, project_order int, document_order int, path string, facts binary")


def _read(files: DataFrame) -> DataFrame:
    """Each file with its declarations packed, the names that it declares, uses anywhere and uses in declarations, its namespaces with those around them, and its global usings."""
    kept = files.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + f", {FOUND}"
    arrow = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _calm():
            for batch in batches:
                rows = []
                for p, c in zip(batch.column(kept.index("path")).to_pylist(), batch.column(kept.index("content")).to_pylist()):
                    f = Facts(p, c)
                    spaces = {".".join(parts[: i + 1]) for parts in (ns.split(".") for ns in f.namespaces) for i in range(len(parts))}
                    rows.append({"declared": names.declared(f), "used": names.used(f), "needed": names.needed(f), "spaces": sorted(spaces), "usings": f.global_usings, "facts": _declared(f)})
                made = pa.RecordBatch.from_pylist(rows, arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*kept, *arrow.names])
                gc.collect()

    return files.mapInArrow(run, fields)


def _closed(read: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(solution, task, id) of the files whose declarations each task needs, (solution, task, name) of the names it looks up, and the tables that both are read from.

    A task needs the files that declare a name that its own files use, and those that
    declare a name that the declarations it needs are written with, and so on. Names
    stand for all that bears them, so what a lookup finds is the same as among all
    files of the solution. A task that isn't closed after ``ROUNDS`` gets every file.
    """
    declared = read.select("solution", F.explode("declared").alias("name"), "id")
    spaces = read.select("solution", F.explode("spaces").alias("name")).distinct().select("solution", F.substring_index("name", ".", -1).alias("name"), F.lit(None).cast("long").alias("id"))
    known = settle(declared.unionByName(spaces).groupBy("solution", "name").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("one")))
    links = read.select("solution", "id", F.explode("needed").alias("name")).join(known, ["solution", "name"])
    links = settle(links.filter("n > 1 or one is null or one <> id").select("solution", "id", "name"))
    asked = [settle(read.filter("wanted").select("solution", "task", F.explode("used").alias("name")).join(known.select("solution", "name"), ["solution", "name"], "left_semi").distinct())]
    files = lambda names: names.join(declared, ["solution", "name"]).select("solution", "task", "id").distinct()
    needs = [settle(files(asked[0]))]
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    while not needs[-1].isEmpty():
        if len(needs) > ROUNDS:
            whole = needs[-1].select("solution", "task").distinct()
            looked = whole.join(known.select("solution", "name"), "solution")
            return every(needs).unionByName(whole.join(read.select("solution", "id"), "solution")).distinct(), every(asked).unionByName(looked).distinct(), [known, links, *needs, *asked]
        more = needs[-1].join(links, ["solution", "id"]).select("solution", "task", "name").distinct()
        asked.append(settle(more.join(every(asked), ["solution", "task", "name"], "left_anti")))
        needs.append(settle(files(asked[-1]).join(every(needs), ["solution", "task", "id"], "left_anti")))
    drop(known, links)
    return every(needs), every(asked), [*needs, *asked]


def documents(sources: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Graph documents (model.DOCUMENT) of SOURCE rows, generated and built files left out.

    selection: (project, path) of the files to extract; names are bound over the
    whole solution all the same. A null text is an empty file. Solutions of one task
    each are bound with all of their declarations; where one has more, each task gets
    those that its files can look up.
    """
    kept = sources.filter(text.is_source(F.col("path"))).select(*[c.split()[0] for c in SOURCE.split(", ")])
    wanted = kept if selection is None else kept.join(selection.select("project", "path").distinct(), ["project", "path"], "left_semi")
    sizes = wanted.groupBy("solution").agg(F.count(F.lit(1)).alias("n"))
    checksum = text.checksum(F.coalesce("content", F.lit("")))
    none = lambda kind: F.lit(None).cast(kind)
    if (sizes.agg(F.max("n")).first()[0] or 0) <= FILES:
        task, own = F.lit(0).alias("task"), F.lit("own") if selection is None else none("string")
        facts = declarations(kept).join(sizes, "solution", "left_semi").select("solution", task, F.lit(0).alias("turn"), "project_order", "document_order", "path", none("string").alias("project"), none("string").alias("content"), "facts", none("string").alias("checksum"), own.alias("word"))
        files = wanted.select("solution", task, F.lit(3).alias("turn"), "project_order", "document_order", "path", "project", "content", none("binary").alias("facts"), checksum.alias("checksum"), none("string").alias("word"))
        return _bind(facts.unionByName(files))
    tasks = sizes.select("solution", F.ceil(F.col("n") / F.lit(FILES)).cast("int").alias("tasks"))
    chosen = kept.withColumn("wanted", F.lit(True)) if selection is None else kept.join(selection.select("project", "path", F.lit(True).alias("wanted")).distinct(), ["project", "path"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    dealt = chosen.join(tasks, "solution").withColumn("task", F.pmod(F.xxhash64("project", "path"), F.col("tasks")).cast("int"))
    read = settle(_read(dealt.drop("tasks").withColumn("id", F.monotonically_increasing_id())))
    needs, asked, tables = _closed(read)
    row = lambda df, turn, **have: df.select("solution", "task", F.lit(turn).alias("turn"), *[(have.get(c, F.col(c) if c in df.columns else none(t))).alias(c) for c, t in (("project_order", "int"), ("document_order", "int"), ("path", "string"), ("project", "string"), ("content", "string"), ("facts", "binary"), ("checksum", "string"), ("word", "string"))])
    spaces = read.select("solution", F.explode("spaces").alias("word")).distinct().withColumn("name", F.substring_index("word", ".", -1))
    spaces = row(asked.join(spaces, ["solution", "name"]), 1)
    usings = read.select("solution", "project_order", "document_order", "path", F.posexplode("usings").alias("pos", "word")).groupBy("solution", "word").agg(F.min(F.struct("project_order", "document_order", "path", "pos")).alias("x"))
    usings = row(usings.select("solution", "word", "x.project_order", "x.document_order", F.concat("x.path", F.format_string("|%08d", "x.pos")).alias("path")).join(tasks.select("solution", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")), "solution"), 2)
    own = F.when(F.col("wanted") & (F.col("task") == F.col("home")), "own")
    facts = row(needs.join(read.select("id", F.col("task").alias("home"), "wanted", "project_order", "document_order", "path", "facts"), "id"), 0, word=own)
    files = row(read.filter("wanted").drop("facts"), 3, checksum=checksum)
    out = _bind(facts.unionByName(spaces).unionByName(usings).unionByName(files))
    out._read_from = [read, *tables]
    return out


def settled(sources: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """``documents``, written once; the tables and shuffles that they were read from are deleted."""
    made = documents(sources, selection)
    out = settle(made)
    drop(*vars(made).pop("_read_from", ()))
    del made
    release(sources.sparkSession)
    return out


def _written(documents: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    """Documents as rows. A node that many edges share is turned into values once."""
    table, place = [], {}

    def at(nodes: list[dict]) -> pa.Array:
        """The nodes' places in the table."""
        out = []
        for n in nodes:
            if (i := place.get(id(n))) is None:
                i = place[id(n)] = len(table)
                table.append(n)
            out.append(i)
        return pa.array(out, pa.int32())

    def listed(column: str, items: pa.Array) -> pa.Array:
        ends = [0]
        for d in documents:
            ends.append(ends[-1] + len(d[column]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=arrow.field(column).type)

    edges = [e for d in documents for e in d["edges"]]
    nodes, sources, targets = (at(x) for x in ([n for d in documents for n in d["nodes"]], [e["source"] for e in edges], [e["target"] for e in edges]))
    kind, edge = arrow.field("nodes").type.value_type, arrow.field("edges").type.value_type
    values = pa.StructArray.from_arrays([pa.array([n[f.name] for n in table], f.type) for f in kind], fields=list(kind))
    made = {"nodes": listed("nodes", values.take(nodes)), "edges": listed("edges", pa.StructArray.from_arrays([values.take(sources), values.take(targets), pa.array([e["type"] for e in edges], pa.string())], fields=list(edge)))}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array([d[f.name] for d in documents], f.type) for f in arrow], schema=arrow)


def _bind(rows: DataFrame) -> DataFrame:
    """Documents of the rows of each task: declarations (turn 0; the word ``own`` marks files that the task binds), namespaces (1), global usings (2), then files (3)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "solution", "task").sortWithinPartitions("solution", "task", "turn", "project_order", "document_order", "path")
    arrow = to_arrow_schema(StructType.fromDDL(model.DOCUMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, own, words, symbols, out = None, [], {}, ([], []), None, []
        with _calm():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for solution, task, turn, project_order, document_order, path, project, content, facts, checksum, word in zip(*columns):
                    if (solution, task) != at:
                        if symbols is not None:
                            symbols.release()
                        at, held, own, words, symbols = (solution, task), [], {}, ([], []), None
                        gc.unfreeze()
                        gc.collect()
                    if turn == 0:
                        held.append(_unpacked(facts))
                        if word is not None:
                            place = (project_order, document_order, path)
                            own[place] = None if place in own else held[-1]  # files of one place are read again
                    elif turn < 3:
                        words[turn - 1].append(word)
                    else:
                        if symbols is None:
                            symbols, held = Symbols(held, *words), []
                            gc.freeze()
                        if (known := own.pop((project_order, document_order, path), None)) is None:
                            known = Facts(path, content)
                        else:
                            known.source = Source.of(content)
                        found = extract(known, symbols)
                        out.append({"project": project, "path": path, "checksum": checksum, "project_order": project_order, "document_order": document_order} | found)
                        if len(out) == WRITTEN:
                            yield _written(out, arrow)
                            out = []
                            gc.collect(0)  # what is new: the symbols, and what they keep, aren't walked again
            if out:
                yield _written(out, arrow)

    return rows.mapInArrow(run, model.DOCUMENT)
