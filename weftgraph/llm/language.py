"""Language identification by rank-order profiles.

Method. A language's profile is its most frequent letter n-grams (1 to 3, words
padded by a space), in order. A text's own most frequent n-grams are compared
with each profile by the out-of-place distance: the sum over the text's n-grams
of the difference of ranks, or the profile's length where the profile has none.
The least distance wins; the score is 1 less the distance as a part of the
greatest possible one.

Fitting reads about ``sample`` labelled rows of each language, chosen by a hash
of their text where they are read: no text is shuffled. More rows don't change
profiles of a few hundred n-grams. Prediction reads every whole text.

Defined results. A text that is null or has no letter gets ``und`` and score 0;
so does every text if there are no labelled rows, as in an empty table. Equal
counts of n-grams go by the hash of the n-gram, equal distances to the language
that is first by code point. Rows with a null label teach nothing; rows that
repeat a text are taken or left together. Rows are independent of each other when
predicted, so repeated rows get equal results. A very long text is worked on
alone. Extra columns, whatever their names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import sessions
from weftgraph.llm.words import mix

#: N-grams of a profile, and of a text.
PROFILE, TOP = 400, 300
#: Most labelled rows of one language that fitting reads (about; chosen by hash).
SAMPLE = 3000
#: Most different labels; the table of their sizes is broadcast.
LANGUAGES = 10_000
#: Characters of a run of texts that are worked on at once.
RUN = 1 << 19
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of every n-gram; a gram is a 44-bit hash."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _is_letter()[points]
    # One space stands for each run of other characters, and before and after each text.
    first = np.ones(len(points), bool)
    first[1:] = text[1:] != text[:-1]
    gap = ~letter
    keep = letter.copy()
    keep[1:] |= gap[1:] & letter[:-1] & ~first[1:]
    points, text, letter = np.where(letter, points, 32)[keep], text[keep], letter[keep]
    # A text that begins with a letter, or ends with one, gets its space.
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    points, where, letter = np.insert(points, begin, 32), np.insert(text, begin, text[begin]), np.insert(letter, begin, False)
    closing = np.flatnonzero(letter & np.concatenate([where[1:] != where[:-1], [True]])) + 1
    points, where, letter = np.insert(points, closing, 32), np.insert(where, closing, where[closing - 1]), np.insert(letter, closing, False)
    a, b, c = points[:-2], points[1:-1], points[2:]
    two = where[:-1] == where[1:]
    three = two[:-1] & two[1:] & letter[1:-1]
    codes = np.concatenate([points[letter], (points[:-1] << 21 | points[1:])[two], (a << 42 | b << 21 | c)[three]])
    owners = np.concatenate([where[letter], where[:-1][two], where[:-2][three]])
    return owners, mix(codes.astype(np.uint64)) >> np.uint64(20)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count), in order of text and gram."""
    owner, gram = grams(texts)
    packed = np.sort(owner.astype(np.uint64) << np.uint64(44) | gram)
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(packed)]]))
    packed = packed[at]
    return (packed >> np.uint64(44)).astype(np.int64), packed & np.uint64((1 << 44) - 1), counts


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN or i - start >= 60_000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language: names (sorted), grams (sorted), ranks (grams x names; PROFILE where there is none)."""

    names: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles from labelled rows. Only counts of n-grams by language reach the driver, ``PROFILE`` of each language."""
    sessions.prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count()
    if sizes.count() > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different languages")
    # Hash threshold that lets about ``sample`` rows of each language through.
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    shares = F.broadcast(sizes.select("lang", share.alias("share")))
    chosen = rows.withColumn("u", F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))).join(shares, "lang").filter("u < share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _runs(texts):
                owner, gram, n = counted(texts[a:b])
                kinds, code = np.unique(np.array(names[a:b], dtype=object).astype(str), return_inverse=True)
                packed = code[owner].astype(np.uint64) << np.uint64(44) | gram
                packed, inverse = np.unique(packed, return_inverse=True)
                total = np.bincount(inverse, weights=n, minlength=len(packed)).astype(np.int64) if len(packed) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[(packed >> np.uint64(44)).astype(np.int64)], pa.string()), pa.array((packed & np.uint64((1 << 44) - 1)).astype(np.int64)), pa.array(total)], names=["lang", "gram", "n"])

    totals = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = _top(totals)
    found: dict[str, list[tuple[int, int]]] = {}
    for x in best.collect():
        found.setdefault(x["lang"], []).append((x["rank"], x["gram"]))
    names = tuple(sorted(found))
    every = np.unique(np.array([g for v in found.values() for _, g in v], np.int64)).astype(np.uint64)
    ranks = np.full((len(every), len(names)), PROFILE, np.int16)
    for j, name in enumerate(names):
        for rank, gram in found[name]:
            ranks[np.searchsorted(every, np.uint64(gram)), j] = rank
    return Profiles(names, every, ranks)


def _top(totals: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return totals.withColumn("rank", rank).filter(F.col("rank") < PROFILE).select("lang", "gram", "rank")


def distances(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(text x language out-of-place distances, n-grams that each text put forward)."""
    n, k = len(texts), len(profiles.names)
    owner, gram, count = counted(texts)
    # By text, then falling count, then gram (they come in that order): the first TOP are the text's ranks.
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | np.uint64(2**32 - 1) - count.astype(np.uint64), kind="stable")
    owner, gram = owner[order], gram[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    rank = np.arange(len(owner)) - first[owner]
    top = rank < TOP
    owner, gram, rank = owner[top], gram[top], rank[top]
    at = np.minimum(np.searchsorted(profiles.grams, gram), max(len(profiles.grams) - 1, 0))
    away = np.full((len(owner), k), PROFILE, np.int64)
    hit = profiles.grams[at] == gram if len(profiles.grams) else np.zeros(len(gram), bool)
    known = profiles.ranks[at[hit]].astype(np.int64)
    away[hit] = np.where(known < PROFILE, np.abs(known - rank[hit][:, None]), PROFILE)
    sums = np.concatenate([np.zeros((1, k), np.int64), np.cumsum(away, axis=0)])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The columns of ``keep`` with lang_pred and score, for every row."""
    sessions.prepare(docs.sparkSession)
    chosen = docs.select(*keep, F.col(f"`{text}`").alias("__text"))
    kept = chosen.schema.fields[:-1]
    names = [f.name for f in kept]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found, scores = [], []
            for a, b in _runs(texts):
                if not profiles.names:
                    found += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                away, n = distances(texts[a:b], profiles)
                best = away.argmin(axis=1)
                least = away[np.arange(b - a), best]
                found += [profiles.names[j] if m else UNKNOWN for j, m in zip(best, n)]
                scores += np.where(n > 0, 1 - least / np.maximum(n * PROFILE, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return chosen.mapInArrow(label, ", ".join([*fields, "lang_pred string", "score double"]))
