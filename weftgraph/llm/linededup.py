"""Line dedup by an exact set-similarity join.

Method (prefix filtering). A line's tokens are the shingles of its words. Tokens
are ordered by rarity, rarest first; rarity is counted over all lines in a table
of hash buckets of fixed size and taken in classes of half a doubling, any total order being right and a good one fast.
A pair of lines with Jaccard similarity t or more shares a token among the first
n - ceil(t n) + 1 of each (prefix filter); their sizes differ by at most a
factor t (length filter); and the tokens after a shared one must suffice for the
overlap (positional filter). Pairs that pass are verified by exact Jaccard, and
a line goes if an earlier line, by document id and line number, is similar.

Lines with one token set are joined as one (its first line), copies only follow.
The sets that share a token are compared with each other in tiles of bounded size,
each pair under the first token it shares, so every link between different sets is
found once. A group of g sets costs g * g comparisons, spread over its tiles; what
leaves a tile is one row per set, with its number of links, weighted by copies.

Defined results. Null and empty texts have no lines with words. A line of fewer
words than a shingle is one shorter shingle, so only its copies are similar; lines
under ``min_words`` words stay (the query and the pipeline take all, from one word).
Rows that
repeat both id and text stand in one place and get one result. A null id comes
last. A very long text, or a very long line, is worked on alone. An empty table
gives an empty result; extra columns, whatever their names, are ignored here and
kept by ``clean``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bitmaps, sessions, similar
from weftgraph.llm.words import Scan, buffers, distinct, grouped, line_offsets, mix, slices

WIDTH, LEAST, MIN_WORDS = 5, 0.8, 5
#: Bits of a token's hash in prefixes (token sets are named and pairs verified with 64 bits).
TOKEN_BITS = 42
#: Hash buckets of the rarity table (4 bytes each), and pieces in which it is summed.
BUCKET_BITS, PIECES = 20, 16
#: Place of line numbers among the bits of a line's key.
_TURN = 44
#: Token sets that a task remembers, so that it sends the prefix of a repeated line once.
REMEMBERED = 500_000
#: From this number on, tokens of a line aren't counted in its sketch.
MANY = (1 << 16) - 1
#: Rows of one token of which all pairs are looked at before their texts are fetched.
PAIRED = 128
#: Rows of one token that are looked at together.
GROUP = 200_000
#: Token sets on each side of a tile of pairs, and most tokens of them (about).
TILE, TILE_TOKENS = 512, 1 << 19
#: Cells of a matrix, and bytes of text of small tiles, that are worked on at once.
CELLS, RUN = 1 << 22, 1 << 22


def _scan(data: np.ndarray, offsets: np.ndarray, width: int, min_words: int):
    """(line, 64-bit hash) of all shingles of the lines with enough words, and text and number of each line."""
    lines, text, number = line_offsets(data, offsets)
    scan = Scan(data, lines)
    unit, value = scan.shingles(width)
    if min_words > 1:
        enough = (np.diff(scan.first) >= min_words)[unit]
        unit, value = unit[enough], value[enough]
    return unit, value, text, number


def _levels(table) -> np.ndarray:
    """The classes of a broadcast table of counts, made once in a worker."""
    if (made := vars(table).get("levels")) is None:
        made = table.levels = _level(table.value)
    return made


def _level(counts: np.ndarray) -> np.ndarray:
    """Rarity classes 0 to 63, two for each doubling of the count."""
    return np.minimum(2 * np.log2(np.maximum(counts, 1).astype(np.float64)), 63).astype(np.uint64)


def _ordered(unit: np.ndarray, token: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rarest first: (tokens, lines that have some, start and number of each line's)."""
    key = levels[(token >> np.uint64(TOKEN_BITS - BUCKET_BITS)).astype(np.int64)] << np.uint64(TOKEN_BITS) | token
    other = np.ones(len(unit), bool)  # units come in order
    other[1:] = unit[1:] != unit[:-1]
    some, dense = unit[other], np.cumsum(other) - 1
    if len(some) <= 1 << 16:
        key = np.sort(dense.astype(np.uint64) << np.uint64(48) | key)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        dense = (key >> np.uint64(48)).astype(np.int64)
    else:  # the lines of one very long text
        order = np.lexsort((key, dense))
        key, dense = key[order], dense[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (dense[1:] != dense[:-1])
        key, dense = key[new], dense[new]
    start = np.concatenate([np.flatnonzero(np.diff(dense, prepend=-1)), [len(dense)]])
    return key & np.uint64((1 << TOKEN_BITS) - 1), some, start[:-1], np.diff(start)


def rarity(docs: DataFrame, text: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS) -> np.ndarray:
    """Counts of shingles by token bucket. The table has 2**BUCKET_BITS entries whatever the input; partial tables are summed by piece."""
    size = 1 << BUCKET_BITS
    step = size // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            held = [np.zeros(0, np.int64)]
            for a, b in slices(offsets):
                _, value, _, _ = _scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, min_words)
                held.append((value >> np.uint64(64 - BUCKET_BITS)).view(np.int64))
                if sum(map(len, held)) > size:  # the table is walked once for many slices
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held = held[:1]
            total += np.bincount(np.concatenate(held), minlength=size)
        yield from _pieces(total)

    def _pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [zlib.compress(total[i * step : (i + 1) * step].tobytes(), 1) for i in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                total[piece] = total[piece] + part if piece in total else part
        for piece, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["piece", "counts"])

    kind = "piece int, counts binary"
    summed = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, kind).repartition(PIECES, "piece").mapInArrow(add, kind)
    out = np.zeros(size, np.int64)
    for x in summed.toLocalIterator():
        out[x["piece"] * step : (x["piece"] + 1) * step] += np.frombuffer(zlib.decompress(x["counts"]), np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def _nodes(unit: np.ndarray, whole: np.ndarray, some: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The name of each line's token set, from the distinct 64-bit hashes. some: the lines, in order; n: their numbers of distinct tokens."""
    at = np.searchsorted(unit, some)
    if (more := np.diff(np.append(at, len(unit))) != n).any():  # lines that repeat a shingle
        own = np.repeat(more, np.diff(np.append(at, len(unit))))
        fewer = distinct(unit[own], whole[own])
        unit, whole = np.concatenate([unit[~own], fewer[0]]), np.concatenate([whole[~own], fewer[1]])
        by = np.argsort(unit, kind="stable")
        unit, whole = unit[by], whole[by]
        at = np.searchsorted(unit, some)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(whole ^ np.uint64(0x1D8E4E27C47D124F)))])
    ends = np.append(at[1:], len(unit))
    return mix(sums[ends] - sums[at] + (ends - at).astype(np.uint64)).astype(np.int64)


def _lines(table, width: int, min_words: int, least: float):
    """(k, id, text) to one row per line with tokens: k, id, line, node (hash of the token set), sketch, prefix (empty where this task sent it before).

    sketch: 32 parity bits of the tokens, 16 bits of their number, and 16 for the place of one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(table)
        sent: set[int] = set()
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            data, offsets = buffers(batch.column(2))
            for a, b in slices(offsets):
                unit, whole, text, number = _scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, min_words)
                if not len(unit):
                    continue
                value, some, start, n = _ordered(unit, whole >> np.uint64(64 - TOKEN_BITS), levels)
                node = _nodes(unit, whole, some, n)
                if len(sent) > REMEMBERED:
                    sent.clear()
                fresh = np.zeros(len(some), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in sent:
                        sent.add(x)
                        fresh[i] = True
                # Two sets of which each has a token of its own share t / (1 - t) of them or more: smaller ones meet by node alone.
                alone = (n + 1e-9) * (1 - least) < least
                length = np.where(fresh & ~alone, prefix_length(n, least), 0)
                ends = np.cumsum(length)
                at = np.repeat(start, length) + np.arange(ends[-1]) - np.repeat(ends - length, length)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(value[at].astype(np.int64)))
                owner = a + text[some]
                odd = np.bitwise_xor.reduceat(np.uint64(1) << (mix(value) & np.uint64(31)), start)
                sketch = (odd << np.uint64(32) | np.minimum(n, MANY).astype(np.uint64) << np.uint64(16)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), ids.take(pa.array(owner)), pa.array(number[some].astype(np.int64)), pa.array(node), pa.array(sketch), prefix], names=["k", "id", "line", "node", "sketch", "prefix"])

    return run


def _fit(token: np.ndarray, sketch: np.ndarray, least: float) -> np.ndarray:
    """Which rows (token, sketch), sorted by token, may have a partner under their token.

    A pair's first shared token must leave room for the overlap in both lines; for the
    smaller line that means a place under n - 2 t / (1 + t) n. Tokens without such a
    line, and lines too small or large for those, have no pair. In small groups the
    pairs themselves are looked at: their sizes, the room behind the token, and the
    parity bits, which differ in at most as many places as the sets do. Numbers from
    MANY on aren't told apart, so lines of that many tokens always may.
    """
    bits = sketch.view(np.uint64)
    n, pos = (bits >> np.uint64(16) & np.uint64(MANY)).astype(np.int64), (bits & np.uint64(MANY)).astype(np.int64)
    full = n == MANY
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    of = np.repeat(np.arange(len(start)), np.diff(start, append=len(token)))
    early = (pos <= n - np.ceil(2 * least / (1 + least) * n - 1e-9)) | full
    none = np.iinfo(np.int64).max
    low = np.minimum.reduceat(np.where(early, n, none), start)[of]
    high = np.maximum.reduceat(np.where(early, n, 0), start)[of]
    keep = (n >= low) & ((n * least <= high + 1e-9) | (high == MANY)) & (low < none)
    rows = np.flatnonzero(keep)
    if not len(rows):
        return keep
    start = np.flatnonzero(np.concatenate([[True], of[rows][1:] != of[rows][:-1]]))
    end = np.append(start[1:], len(rows))
    few = end - start <= PAIRED
    a, b = (rows[x] for x in _pairs(start[few], end[few]))
    both = n[a] + n[b]
    apart = np.bitwise_count((bits[a] ^ bits[b]) >> np.uint64(32))
    fit = (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9) & (apart <= (1 - least) / (1 + least) * both + 1e-6)
    fit &= np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least / (1 + least) * both - 1e-9
    fit |= full[a] | full[b]
    met = np.zeros(len(token), bool)
    met[a[fit]] = met[b[fit]] = True
    met[rows[np.repeat(~few, end - start)]] = True
    return keep & met & (np.bincount(of, keep & met)[of] > 1)


def _numbers(sketch: np.ndarray) -> np.ndarray:
    """The numbers of tokens that sketches tell."""
    return (sketch >> 16 & MANY).astype(np.int64)


def _shared(least: float):
    """Of rows (token, node, sketch) sorted by token, those whose token more than one node has, once each, with the token's number of rows (size) and of their tokens (weight).

    Tokens are looked at whole, and rows without a possible partner go, as long as
    a token has at most GROUP rows in a batch; of a larger one all rows stay, with
    no size, and each with its own weight.
    """
    names = ["token", "node", "size", "weight"]

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        once, _ = grouped(rows[0], rows[1].view(np.uint64))
        token, node, sketch = rows[:, once]
        keep = _fit(token, sketch, least)
        token, node, n = token[keep], node[keep], _numbers(sketch[keep])
        if len(token):
            _, of, size = np.unique(token, return_inverse=True, return_counts=True)
            weight = np.bincount(of, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(size[of]), pa.array(weight[of])], names=names)

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(_numbers(rows[2]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((3, 0), np.int64), None
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if large is not None:
                end = int(np.searchsorted(rows[0], large, "right"))
                if end:
                    yield passed(rows[:, :end])
                rows = rows[:, end:]
            if not rows.shape[1]:
                continue
            cut, large = int(np.searchsorted(rows[0], rows[0, -1], "left")), None
            if cut:
                yield from out(rows[:, :cut])
            held = rows[:, cut:]
            if held.shape[1] > GROUP:
                yield passed(held)
                held, large = held[:, :0], held[0, -1]
        if held.shape[1]:
            yield from out(held)

    return run


def _place(k, line):
    """A 64-bit key of a line: the text's key with the line's number in its upper bits. Computed alike in _cut."""
    return k.bitwiseXOR(F.shiftleft(line, _TURN)).alias("place")


def _cut(marks):
    """(k, text) to (k, line, text) of the lines whose place is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                lines, text, number = line_offsets(part, offsets[a : b + 1] - offsets[a])
                hit = np.flatnonzero(bits[bitmaps.places(keys[a + text] ^ number << _TURN)])
                cut = [part[lines[i] : lines[i + 1]].tobytes().decode() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a + text[hit]]), pa.array(number[hit].astype(np.int64)), pa.array(cut, pa.string())], names=["k", "line", "text"])

    return run


def _dealt(todo: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """The sets that share a token, with order, copies and text, in tiles of about TILE sets, or sets of TILE_TOKENS tokens, on each side: (token, i, j, side, node, no, id, k, line, copies, text).

    A large group goes to as many tiles as its pairs fill, so no task holds it whole.
    """
    tiles = F.greatest(F.ceil(F.col("size") / F.lit(TILE)), F.ceil(F.col("weight") / F.lit(TILE_TOKENS))).cast("long")
    cut = todo.select("token", "node", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).alias("own"))
    to = cut.select("token", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    sides = to.select("token", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("long").alias("side"))
    rows = sides.join(texts, "node").select("token", "i", "j", "side", "node", "no", "id", "k", "line", "copies", "text")
    return rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "side", "node")


def _similar(sets: list[np.ndarray], side: np.ndarray, token: int, levels: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sets of a tile are similar and have ``token`` as the first that they share: every pair is found under one token."""
    sizes = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    key = _order(values, levels)
    at = np.uint64(token)
    own = levels[int(at >> np.uint64(TOKEN_BITS - BUCKET_BITS))] << np.uint64(TOKEN_BITS) | at
    a, b = (np.arange(len(sets)),) * 2 if not side.any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    # Columns that one set alone has are in no overlap. Those before the token come first,
    # and all in blocks of bounded size.
    many = np.bincount(column, minlength=len(values)) > 1
    first = np.flatnonzero(many & (key < own))
    chosen = np.concatenate([first, np.flatnonzero(many & (key >= own))])
    place = np.full(len(values), -1)
    place[chosen] = np.arange(len(chosen))
    place = place[column]
    by = np.argsort(place, kind="stable")
    row, place = row[by], place[by]
    common, width = np.zeros((len(a), len(b)), np.float32), max(1, CELLS // len(sets))
    early = None
    starts = [*range(0, len(first), width), *range(len(first), len(chosen), width)]
    for x, y in zip(starts, [*starts[1:], len(chosen)]):
        if x == len(first):
            early = common > 0
        u, v = np.searchsorted(place, (x, y))
        table = np.zeros((len(sets), y - x), np.float32)
        table[row[u:v], place[u:v] - x] = 1
        common += table[a] @ table[b].T
    fit = (common > 0) & (common >= least * (sizes[a][:, None] + sizes[b] - common) - 1e-9)
    fit &= ~(early if early is not None else common > 0)
    out = np.zeros((len(sets), len(sets)), bool)
    out[np.ix_(a, b)] = fit
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _order(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """What orders tokens, from their 64-bit hashes: rarity, then the hash."""
    short = values >> np.uint64(64 - TOKEN_BITS)
    return levels[(short >> np.uint64(TOKEN_BITS - BUCKET_BITS)).astype(np.int64)] << np.uint64(TOKEN_BITS) | short


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of n rows in each row's component, by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


#: Sets up to which the pairs of a tile are listed together with those of other tiles.
FEW = 24
#: Words of parity bits that bound the difference of two sets.
_ODD = 2


class _Sets:
    """The token sets of the different nodes of a run of rows, one after another."""

    def __init__(self, node: np.ndarray, texts: pa.Array, width: int, levels: np.ndarray):
        _, at, self.of = np.unique(node, return_index=True, return_inverse=True)
        owner, value = similar.shingles(texts.take(pa.array(at)), width)
        # Places in one sorted column of (set, token), each once, for look-ups.
        tokens, rank = np.unique(value, return_inverse=True)
        self.span = max(len(tokens), 1)
        places = np.sort(owner * self.span + rank)
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1]
        self.places = places[new]
        owner, self.ranks = np.divmod(self.places, self.span)
        self.value, self.order = tokens[self.ranks], _order(tokens, levels)[self.ranks]
        self.size = np.bincount(owner, minlength=len(at))
        self.start = np.cumsum(self.size) - self.size
        self.odd = similar.parities(owner, self.value, len(at), _ODD)

    def alike(self, a: np.ndarray, b: np.ndarray, token: np.ndarray, least: float) -> np.ndarray:
        """Which pairs of sets are similar and have their ``token`` (as ``_order`` gives it) as the first that they share."""
        few, many = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        apart = np.bitwise_count((self.odd[a] ^ self.odd[b]).view(np.uint64)).sum(axis=1)
        ok = np.flatnonzero((few >= least * many - 1e-9) & (apart <= (1 - least) / (1 + least) * (few + many) + 1e-6))
        out = np.zeros(len(a), bool)
        for part in np.array_split(ok, max(1, int(few[ok].sum()) >> 21)):
            x, y = a[part], b[part]
            size = self.size[x]
            ends = np.cumsum(size)
            pair = np.repeat(np.arange(len(part)), size)
            at = np.arange(len(pair)) + np.repeat(self.start[x] - (ends - size), size)
            want = y[pair] * self.span + self.ranks[at]
            hit = self.places[np.minimum(np.searchsorted(self.places, want), len(self.places) - 1)] == want
            common = np.bincount(pair[hit], minlength=len(part))
            first = np.full(len(part), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(first, pair[hit], self.order[at[hit]])
            out[part] = (common > 0) & (common >= least * (size + self.size[y] - common) - 1e-9) & (first == token[part])
        return out


def _pairs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in each of the spans."""
    size = end - start
    at = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    rest = np.repeat(end, size) - at - 1
    a = np.repeat(at, rest)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest) - rest, rest)


def _links(table, width: int, least: float):
    """Tiles of ``_dealt`` to one row per set and tile with links: node, links (lines of the sets it is similar to), match (an earlier one's node, or null), root (a node of the same class).

    Small tiles are worked on together, a large one by a product of matrices.
    """
    names = ["node", "links", "match", "root"]

    def summed(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """The links (a, b) by row."""
        some, both = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = both[: len(a)], both[len(a) :]
        node, no, ident, k, line, copies = rows[4:, some]
        rank = np.empty(len(some), np.int64)
        rank[np.lexsort((line, k, ident, no))] = np.arange(len(some))
        links = np.bincount(a, copies[b], len(some)) + np.bincount(b, copies[a], len(some))
        none = np.iinfo(np.int64).max
        match, later = np.full(len(some), none), np.where(rank[a] > rank[b], a, b)
        np.minimum.at(match, later, node[np.where(rank[a] > rank[b], b, a)])
        found = np.zeros(len(some), bool)
        found[later] = True
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(match, mask=~found), pa.array(node[_roots(a, b, len(some))])], names=names)

    def worked(rows: np.ndarray, texts: pa.Array, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, i, j, side = rows[:4]
        cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
        start, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [rows.shape[1]]])
        sets = _Sets(rows[4], texts, width, levels)
        few = end - start <= FEW
        a, b = _pairs(start[few], end[few])
        meet = (i[a] == j[a]) | (side[a] != side[b])
        a, b = a[meet], b[meet]
        own = token.astype(np.uint64)
        own = levels[(own >> np.uint64(TOKEN_BITS - BUCKET_BITS)).astype(np.int64)] << np.uint64(TOKEN_BITS) | own
        fit = sets.alike(sets.of[a], sets.of[b], own[a], least)
        if fit.any():
            yield summed(rows, a[fit], b[fit])
        for x, y in zip(start[~few].tolist(), end[~few].tolist()):
            own_side = side[x:y]
            if i[x] != j[x] and not (own_side.any() and not own_side.all()):
                continue
            linked = _similar([sets.value[sets.start[u] : sets.start[u] + sets.size[u]] for u in sets.of[x:y]], own_side, int(token[x]), levels, least)
            a, b = np.nonzero(np.triu(linked))
            if len(a):
                yield summed(rows[:, x:y], a, b)

    def parted(rows: np.ndarray, texts: pa.Array, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole tiles, in runs of about RUN bytes of text."""
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = np.concatenate([[0], np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1, [rows.shape[1]]])
        start = 0
        for x, y in zip(begin[1:-1], begin[2:]):
            if upto[y - 1] - (upto[start - 1] if start else 0) > RUN:
                yield from worked(rows[:, start:x], texts.slice(start, x - start), levels)
                start = int(x)
        yield from worked(rows[:, start:], texts.slice(start), levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(table)
        rows, texts = np.zeros((10, 0), np.int64), pa.array([], pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rows, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:10]])], axis=1)
            texts = pa.concat_arrays([texts, batch.column(10).cast(pa.string())])
            last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(0))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from parted(rows[:, :done], texts.slice(0, done), levels)
                rows, texts = rows[:, done:], texts.slice(done)
        if rows.shape[1]:
            yield from parted(rows, texts, levels)

    return run


def _key(doc_id: str, text: str):
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def _join(docs: DataFrame, doc_id: str, text: str, width: int, least: float, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with their token sets, the first line and number of lines of each set, and all links between sets, summed up by node and tile."""
    spark = docs.sparkSession
    sessions.prepare(spark)
    read = docs.select(_key(doc_id, text).alias("k"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    table = spark.sparkContext.broadcast(rarity(docs, text, width, min_words))
    lines = sessions.stored(read.mapInArrow(_lines(table, width, min_words, least), "k bigint, id bigint, line bigint, node bigint, sketch bigint, prefix array<bigint>"))
    at = F.struct(F.col("id").isNull().alias("no"), "id", "k", "line")
    firsts = sessions.stored(lines.groupBy("node").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("copies")))
    tokens = lines.select("node", "sketch", F.posexplode("prefix").alias("pos", "token")).select("token", "node", F.col("sketch").bitwiseOR(F.least("pos", F.lit(MANY)).cast("long")).alias("sketch"))
    dealt = tokens.repartition(sessions.partitions(spark), "token").sortWithinPartitions("token")
    shared = sessions.stored(dealt.mapInArrow(_shared(least), "token bigint, node bigint, size bigint, weight bigint"))
    large = shared.filter("size is null").select("token", "node", F.col("weight").alias("own")).distinct()
    sizes = large.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.sum("own").alias("weight")).filter("size > 1")
    todo = shared.filter("size is not null").unionByName(large.drop("own").join(sizes, "token"))
    # Texts of the lines that have a candidate, cut out where the documents are read: a
    # bitmap of fixed size lets few other lines through, and the join drops those.
    wanted = firsts.join(todo.select("node").distinct(), "node")
    chosen = sessions.stored(wanted.select("node", F.col("at.no").cast("long").alias("no"), F.coalesce("at.id", F.lit(0)).alias("id"), F.col("at.k").alias("k"), F.col("at.line").alias("line"), "copies"))
    marks = spark.sparkContext.broadcast(bitmaps.build(chosen.select(_place(F.col("k"), F.col("line")))))
    likely = read.select("k", "text").mapInArrow(_cut(marks), "k bigint, line bigint, text string").dropDuplicates(["k", "line"])
    texts = sessions.stored(likely.join(chosen, ["k", "line"]))
    tiled = _dealt(todo, texts, sessions.partitions(spark))
    links = sessions.stored(tiled.mapInArrow(_links(table, width, least), "node bigint, links bigint, match bigint, root bigint"))
    sessions.drop(shared, chosen, texts)
    marks.unpersist()
    sessions.release(spark)
    return lines, firsts, links


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line that has copies or similar lines: k (hash of id and text), doc_id, line (from 0), node (token set), first (it is the set's first line), match (an earlier set's node that it is similar to, or null), links (similar lines of other token sets), removed, and lead (k of the set's first line)."""
    return _repeated(*_join(docs, doc_id, text, width, least, min_words))


def _repeated(lines: DataFrame, firsts: DataFrame, links: DataFrame) -> DataFrame:
    """``repeated_lines`` without the lines that have neither copies nor links."""
    by_node = links.groupBy("node").agg(F.min("match").alias("match"), F.sum("links").alias("links"))
    # Written, so that the join with the lines stands alone and Spark can split a very common line's part of it.
    some = sessions.stored(firsts.join(by_node, "node", "left").filter("copies > 1 or links is not null").select("node", "at", "match", "links"))
    own = lines.select("k", "id", "line", "node").join(some, "node")
    here = F.struct(F.col("id").isNull().alias("no"), "id", "k", "line")
    first = here.eqNullSafe(F.col("at"))
    return own.select("k", F.col("id").alias("doc_id"), "line", "node", first.alias("first"), "match", F.coalesce("links", F.lit(0)).cast("long").alias("links"), (~first | F.col("match").isNotNull()).alias("removed"), F.col("at.k").alias("lead"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with all their columns, and as the last one the lines that went (``removed_lines``, with an underscore if there is such a column); their text lacks the lines that repeat earlier ones."""
    marked = repeated_lines(docs, doc_id, text, **options).filter("removed").select("k", "line").distinct()
    gone = marked.groupBy("k").agg(F.sort_array(F.collect_list(F.col("line").cast("int"))).alias("gone"))
    key, own, parts, last = (sessions.spare(c, docs.columns) for c in ("k", "gone", "parts", "removed_lines"))
    joined = docs.withColumn(key, _key(doc_id, text)).join(gone.select(F.col("k").alias(key), F.col("gone").alias(own)).hint("shuffle_hash"), key, "left")  # texts aren't sorted
    return _cut_out(joined, text, own, parts).select(*[f"`{c}`" for c in docs.columns], F.coalesce(F.col(own), F.array().cast("array<int>")).alias(last))


def _cut_out(docs: DataFrame, text: str, gone: str, parts: str) -> DataFrame:
    """``docs`` with the lines whose numbers are in ``gone`` (null: none) cut out of the text. Takes a step for each line."""
    column = F.col(f"`{text}`")
    split = docs.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(column, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n")
    return split.withColumn(text, F.when(F.col(gone).isNull(), column).otherwise(kept))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, class_id, links, and the columns text and removed_lines of ``clean``.

    Two documents are of one class if a chain of equal or similar lines leads from
    one to the other; class_id is the class's first doc_id. links: for all lines of
    the document, the lines (each copy counts) that are similar and have another
    token set.
    """
    lines, firsts, links = _join(docs, doc_id, text, width, least, min_words)
    marked = sessions.stored(_repeated(lines, firsts, links).select("k", "line", "node", "links", "removed", "lead"))
    sessions.drop(lines, firsts)
    # The documents of a set hang on the set's first one, sets of a class on each other's first ones.
    equal = marked.filter("k <> lead").select(F.col("k").alias("a"), F.col("lead").alias("b")).distinct()
    lead = marked.select("node", "lead").distinct()
    alike = links.filter("node <> root").select("node", "root").distinct().join(lead, "node").select(F.col("lead").alias("a"), F.col("root").alias("node"))
    alike = alike.join(lead, "node").filter("a <> lead").select("a", F.col("lead").alias("b"))
    grouped = similar.classes(equal.unionByName(alike))
    ids = docs.select(_key(doc_id, text).alias("k"), F.col(f"`{doc_id}`").cast("long").alias("id")).distinct()
    first = ids.join(grouped, ids["k"] == grouped["node"]).groupBy("root").agg(F.min("id").alias("class_id"))
    class_of = grouped.join(first, "root").select(F.col("node").alias("k"), F.lit(True).alias("classed"), "class_id")
    # A row that stands twice has its lines twice in the table.
    numbers = F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line").cast("int")))).alias("gone")
    counts = marked.select("k", "line", "links", "removed").distinct().groupBy("k").agg(F.sum("links").alias("links"), numbers)
    known = counts.join(class_of, "k", "left").withColumn("gone", F.when(F.size("gone") > 0, F.col("gone")))
    joined = docs.select(_key(doc_id, text).alias("k"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(known.hint("shuffle_hash"), "k", "left")  # texts aren't sorted
    class_id = F.when(F.col("classed").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("class_id")).alias("class_id")
    return _cut_out(joined, "text", "gone", "parts").select("doc_id", class_id, F.coalesce("links", F.lit(0)).cast("long").alias("links"), "text", F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))
