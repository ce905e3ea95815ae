"""Quality rules: base counts of words, and repetition by suffix arrays.

Method. The words of a text form a sequence; a suffix array over it (prefix
doubling, vectorised over many texts at once, ranks never tie across texts)
gives the longest common prefix of neighbouring suffixes. The deepest LCP
interval around a suffix names the longest repeated run of words that starts
there; runs that no neighbour to the left extends are the maximal repeated
substrings. The union of their spans gives the covered fraction of the text's
word characters, and the longest of them the longest repeat. Both are limited.

Defined results. A null or empty text has no words: all counts 0,
``base_failed`` true, ``kept`` false. Rows are independent, so ties, repeated
rows and extra columns change nothing; the output has the carried columns, the
counts, ``covered``, ``base_failed`` and ``kept``. A very long text is worked on
alone; it takes 4 bytes a word for each doubling of its longest repeat, and some
150 bytes a word besides. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import sessions
from weftgraph.llm.words import Scan, buffers, grouped, line_offsets, slices

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "covered_chars")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict.

    min_words, max_repeat_percent: the base rules. min_repeat: words from which
    a repeated substring counts. max_covered: largest fraction of word
    characters inside such repeats. max_longest: most words of one repeat, as a
    fraction of the text's words and never under longest_floor words.

    Words in repeats of min_repeat words are among those that the base rule counts,
    so max_covered binds only under max_repeat_percent, and max_longest, of which
    two places are covered, only under half of max_covered.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 10
    max_covered: float = 0.3
    max_longest: float = 0.1
    longest_floor: int = 60


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word of each text, the length in words of the longest run starting there that the same text has elsewhere.

    words: one integer per word; first: start of each text, with one more entry at the end.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    end = first[1:][text]
    # Level 0: rank of (text, word), as the place of the group's head in sorted order.
    key = text * (int(words.max()) + 1) + words
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = heads[np.cumsum(new) - 1]
    levels, step = [], 1
    while True:
        levels.append(rank.astype(np.int32) if n < 2**31 else rank)
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        at = active + step
        second = np.where(at < end[active], rank[np.minimum(at, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, who = key[by], active[by]
        group = rank[who]
        idx = np.arange(len(who))
        head = np.ones(len(who), bool)
        head[1:] = group[1:] != group[:-1]
        sub = np.ones(len(who), bool)
        sub[1:] = key[1:] != key[:-1]
        head_at = np.maximum.accumulate(np.where(head, idx, 0))
        sub_at = np.maximum.accumulate(np.where(sub, idx, 0))
        rank = rank.copy()
        rank[who] = group + (sub_at - head_at)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    # LCP of neighbours, by descending through the levels.
    i, j = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][i] == levels[0][j])
    for level in range(len(levels) - 1, -1, -1):
        ok = live[(i[live] < n) & (j[live] < n)]
        same = ok[levels[level][i[ok]] == levels[level][j[ok]]]
        lcp[same] += 1 << level
        i[same] += 1 << level
        j[same] += 1 << level
    best = np.zeros(n, np.int64)
    np.maximum.at(best, suffixes[:-1], lcp)
    np.maximum.at(best, suffixes[1:], lcp)
    return best


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:n] > 0


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a batch."""
    scan = Scan(data, offsets)
    first, n = scan.first, len(scan.starts)
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead & scan.solid)])
    chars = before[scan.ends] - before[scan.starts]
    is_symbol = np.zeros(256, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": np.diff(first), "word_chars": _by_text(chars, first), "n_symbols": _by_text(is_symbol[data], offsets)}

    lines, text, _ = line_offsets(data, offsets)
    begin, close = lines[:-1], lines[1:]
    close = close - ((close > begin) & (data[np.maximum(close - 1, 0)] == 0x0A) if len(data) else 0)
    filled = np.searchsorted(scan.starts, lines[1:]) > np.searchsorted(scan.starts, lines[:-1])
    begin, close, text = begin[filled], close[filled], text[filled]
    hashes = scan.ranges(begin, close)
    at, count = grouped(text, hashes)
    out["n_dup_lines"] = np.bincount(text[at], count - 1, len(offsets) - 1).astype(np.int64)

    _, ids = np.unique(scan.hashes, return_inverse=True)
    best = longest_repeats(ids, first)
    at = np.flatnonzero(best >= 3)
    out["n_repeat_words"] = _by_text(_cover(at, at + 3, n), first)
    # Maximal: the word before doesn't begin a run that is one word longer.
    maximal = best >= min_repeat
    if n:
        lead_in = np.ones(n, bool)
        lead_in[1:] = best[:-1] != best[1:] + 1
        starts_text = np.zeros(n, bool)
        starts_text[first[:-1][first[:-1] < n]] = True
        maximal &= lead_in | starts_text
    at = np.flatnonzero(maximal)
    covered = _cover(at, at + best[at], n)
    out["covered_chars"] = _by_text(np.where(covered, chars, 0), first)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(offsets) - 1), np.diff(first))[at], best[at])
    out["longest_repeat"] = longest
    return out


def _measured(min_repeat: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_repeat) for a, b in slices(offsets)]
            if not parts:
                continue
            counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=schema)

    return run


def assess(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """One row per document: the columns of ``keep``, the counts, ``covered`` (0 to 1), ``base_failed`` and ``kept``.

    ``keep`` names columns that are carried through. One narrow pass over the texts; no shuffle.
    """
    sessions.prepare(docs.sparkSession)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"`{c}` bigint" for c in COUNTS]
    counted = chosen.mapInArrow(_measured(limits.min_repeat, [*keep, *COUNTS]), ", ".join(fields))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    covered = F.when(F.col("word_chars") > 0, F.col("covered_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    most = F.greatest(F.lit(float(limits.longest_floor)), F.col("n_words") * F.lit(limits.max_longest))
    return (
        counted.withColumn("covered", covered)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("covered") <= limits.max_covered) & (F.col("longest_repeat") <= most))
    )


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns. The texts are measured where they are read; nothing is joined."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    return assess(row, "text", ("row",), limits).filter("kept").select("row.*")
