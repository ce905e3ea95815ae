"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Method. A text is cut where a space follows another character (no piece holds a
space after one), so each part can be encoded alone. A part starts as its
characters, or as byte pieces where the vocabulary lacks one. Candidate merges
stand in an agenda by score, then place. The n-th candidate that is taken from
the agenda is skipped if a keyed hash of seed, document, place of the part in the
text and n falls under the dropout rate; otherwise the two symbols merge and new
candidates enter. So every occurrence of a word in every document has a
segmentation of its own. Without dropout this gives the reference segmentation of
the vocabulary. Any segmentation is made of pieces that spell the text, so
decoding gives the text back exactly.

Cost. The parts of a slice of text are worked on as columns: all agendas of about
one length take their best candidate at the same time, as one minimum over a
matrix of costs, and merge by look-ups in a table of the vocabulary's merges. A
part of which no candidate is skipped has the outcome that it has without dropout,
which is found once for each different part of a slice. Nothing is kept from one
slice to the next.

Only vocabularies with identity normalisation are read (others lose text when
normalised); the path is a parameter. Nothing is trained.

Defined results. A null or empty text has no ids. Rows are independent, so ties,
repeated rows and extra columns change nothing; equal keys and texts give equal
ids; a null key is a key like any other. A literal U+2581, which the vocabulary
can't tell from a space, and characters that it lacks are written as byte pieces.
A very long part, such as a text without a space, runs its agenda alone, as a
heap. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import sessions
from weftgraph.llm.words import buffers, mix, range_hashes, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 29
SPACE = "▁"
_PART = re.compile(r" *[^ ]+| +")

_MASK = (1 << 64) - 1
_FREE = np.int32(2**31 - 1)
_DOCUMENT, _OCCURRENCE, _CANDIDATE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Widths of the matrices of agendas (symbols of a part); longer parts run alone.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 62)
#: Agendas of a matrix, and bytes of text of a slice.
ROWS, SLICE = 1 << 13, 1 << 20
#: Bits of a column's number in a cost.
_COLUMN = 6


def _mix(x: int) -> int:
    """``words.mix`` of one number."""
    x &= _MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _document(key: int, seed: int) -> int:
    return _mix(key * _DOCUMENT + seed)


class Skips:
    """Which candidates of one occurrence are skipped, by the keyed hash."""

    def __init__(self, document: int, place: int, limit: int):
        self.state, self.limit = _mix(document + place * _OCCURRENCE), limit

    def __contains__(self, n: int) -> bool:
        return self.limit > 0 and _mix(self.state + (n + 1) * _CANDIDATE) >> 32 < self.limit


class Vocabulary:
    """Pieces of a BPE model: ids and scores by piece, byte pieces, and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE vocabularies with identity normalisation are read")
        self.prefix = spec.add_dummy_prefix
        normal = {i for i, p in enumerate(model.pieces) if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if i in normal}
        self.costs = {p.piece: -p.score for i, p in enumerate(model.pieces) if i in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(SPACE in p.strip(SPACE) or (p.strip(SPACE) and p.endswith(SPACE)) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        self.surface = [b""] * len(model.pieces)
        for piece, i in self.ids.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        self.of = self.ids | {f"<0x{x:02X}>": i for x, i in self.bytes.items()}
        self._columns()
        self.kind = np.uint16 if len(self.surface) <= 1 << 16 else np.uint32
        self.spelt = np.frombuffer(b"".join(self.surface), np.uint8)
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def _columns(self) -> None:
        """Tables for whole slices: the symbol of each character, and merges by the two symbols."""
        merged = [p for p in self.ids if len(p) > 1]
        _, rank, number = np.unique([self.costs[p] for p in merged], return_inverse=True, return_counts=True)
        self.rank = np.zeros(len(self.surface) + 1, np.int32)
        self.rank[[self.ids[p] for p in merged]] = rank
        # The piece of each rank; -1 where several have one score.
        self.merged = np.full(len(number), -1, np.int32)
        self.merged[rank] = [self.ids[p] for p in merged]
        self.merged[number > 1] = -1
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.space = int(self.chars[ord(SPACE)])
        self.chars[[ord(SPACE), 0x20]] = -1, self.space
        self.none = len(self.surface)
        found = [(self.ids[p[:k]], self.ids[p[k:]], self.ids[p]) for p in merged for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        a, b, number = np.array(found, np.int64).reshape(-1, 3).T
        # Open addressing: every look-up starts at its slot and goes on while another merge is there.
        self.bits = max(4, int(len(a) * 4).bit_length())
        self.pairs, self.numbers = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key = a * (self.none + 1) + b
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = todo[self.pairs[slot[todo]] < 0]
            self.pairs[slot[free]] = key[free]  # the last of several stays
            won = free[self.pairs[slot[free]] == key[free]]
            self.numbers[slot[won]] = number[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(_DOCUMENT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols that a and b merge to; -1 where they don't merge."""
        key = a.astype(np.int64) * (self.none + 1) + b
        slot = self._slot(key)
        there = self.pairs[slot]
        out = np.where(there == key, self.numbers[slot], np.int32(-1))
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            slot[more] = slot[more] + 1 & (1 << self.bits) - 1
            there = self.pairs[slot[more]]
            hit = there == key[more]
            out[more[hit]] = self.numbers[slot[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def costs_of(self, a: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Costs of merging symbols a and b at ``column``: rank of the score, then column; ``_FREE`` where they don't merge."""
        new = self.made(a, b)
        return np.where(new < 0, _FREE, self.rank[new] << _COLUMN | column)

    def agendas(self, symbols: np.ndarray, states: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Run the agendas of many parts. symbols: width x parts, ``none`` behind a part's end; it becomes the outcome, ``none`` where a symbol has gone. Returns the candidates that each took, and the outcome."""
        width, n = symbols.shape
        # The last row is a place outside: nothing merges with it.
        symbol = np.concatenate([symbols, np.full((1, n), self.none, np.int32)]).reshape(-1)
        row = np.arange(width + 1, dtype=np.int64)[:, None] * n + np.arange(n)
        outside = row[-1]
        after, before = np.concatenate([row[1:], row[-1:]]).reshape(-1), np.concatenate([row[-1:], row[:-1]]).reshape(-1)
        column = np.repeat(np.arange(width, dtype=np.int32), n)
        cost = np.concatenate([self.costs_of(symbol[: width * n], symbol[n:], column), np.full(n, _FREE)])
        table, taken = cost.reshape(width + 1, n), np.zeros(n, np.int64)
        live = np.arange(n)
        while True:
            best = (table if len(live) == n else table.take(live, axis=1)).min(axis=0)
            some = best < _FREE
            live, best = live[some], best[some]
            if not len(live):
                return taken, symbol[: width * n].reshape(width, n)
            where = (best & (1 << _COLUMN) - 1).astype(np.int64) * n + live
            taken[live] += 1
            if states is not None:
                drop = mix(states[live] + taken[live].astype(np.uint64) * np.uint64(_CANDIDATE)) >> np.uint64(32) < np.uint64(limit)
                cost[where[drop]] = _FREE
                where, best = where[~drop], best[~drop]
            own = where % n
            gone = after[where]
            next_, last = after[gone], before[where]
            new = self.merged[best >> _COLUMN]
            if (several := np.flatnonzero(new < 0)).size:
                new[several] = self.made(symbol[where[several]], symbol[gone[several]])
            symbol[where] = new
            symbol[gone], cost[gone] = self.none, _FREE
            after[where], before[next_] = next_, where
            cost[where] = self.costs_of(new, symbol[next_], (where // n).astype(np.int32))
            cost[last] = self.costs_of(symbol[last], new, (last // n).astype(np.int32))
            # Places outside belong to nobody.
            after[outside[own]], before[outside[own]] = outside[own], outside[own]

    def symbols(self, part: str) -> list[str]:
        """What a part starts as; a space is U+2581, and a byte piece stands by its name."""
        out = []
        for c in part:
            if c == " ":
                out.append(SPACE)
            elif c != SPACE and c in self.ids:
                out.append(c)
            else:
                out += [f"<0x{x:02X}>" for x in c.encode("utf-8", "surrogatepass")]
        return out

    def segment(self, part: str, skips=()) -> list[int]:
        """Ids of one part, by an agenda that is a heap. skips: the numbers of the candidates that don't merge."""
        get, taken = self.costs.get, 0
        symbols: list[str | None] = self.symbols(part)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(c, i, len(symbols[i]) + len(symbols[i + 1]), i + 1) for i in range(n - 1) if (c := get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, size, j = heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or len(a) + len(b) != size:
                continue  # one of the two has been merged since
            taken += 1
            if taken - 1 in skips:
                continue
            merged = a + b
            symbols[i], symbols[j] = merged, None
            after, before = right[j], left[i]
            right[i] = after
            if after >= 0:
                left[after] = i
                if (c := get(merged + symbols[after])) is not None:
                    heappush(agenda, (c, i, len(merged) + len(symbols[after]), after))
            if before >= 0 and (c := get(symbols[before] + merged)) is not None:
                heappush(agenda, (c, before, len(symbols[before]) + len(merged), i))
        return [self.of[s] for s in symbols if s is not None]

    def decode(self, ids) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        text = data.decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that the ids spell, one after another; place behind each id's)."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.spelt[_runs(self.places[ids], sizes, ends)], ends


def _runs(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each run; ends: running sum of the sizes."""
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = MODEL) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(text: str, path: str = MODEL, rate: float = RATE, seed: int = SEED, key: int = 0) -> np.ndarray:
    """Ids of a text (uint32), part by part. key: the document's."""
    vocab = vocabulary(path)
    document, limit = _document(key, seed), int(rate * 2**32)
    parts = _PART.findall(" " + text if vocab.prefix else text) if text else []
    return np.array([i for place, part in enumerate(parts) for i in vocab.segment(part, Skips(document, place, limit))], np.uint32)


def _symbols(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of UTF-8 texts, where each text's begin, with one more entry at the end)."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    found = vocab.chars[points]
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    lacking = np.flatnonzero(found < 0)
    if not len(lacking):
        return found, first
    size = np.ones(len(points), np.int64)
    size[lacking] += (points[lacking] >= 0x80).astype(np.int64) + (points[lacking] >= 0x800) + (points[lacking] >= 0x10000)
    ends = np.cumsum(size)
    out = np.repeat(found, size)
    by_byte = np.array([vocab.bytes[x] for x in range(256)], np.int32)
    spelt = "".join(map(chr, points[lacking].tolist())).encode()
    out[_runs(ends[lacking] - size[lacking], size[lacking], np.cumsum(size[lacking]))] = by_byte[np.frombuffer(spelt, np.uint8)]
    return out, np.concatenate([[0], ends])[first]


def _solved(vocab: Vocabulary, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes of parts of up to WIDTHS[-1] symbols: (ids, where each part's begin, their number, candidates taken)."""
    begin, count, taken = (np.zeros(len(starts), np.int64) for _ in range(3))
    order, out, at = np.argsort(sizes, kind="stable"), [np.zeros(0, np.int32)], 0
    bounds = np.searchsorted(sizes[order], WIDTHS, "right")
    for width, a, b in zip(WIDTHS, [0, *bounds], bounds):
        for block in range(a, b, ROWS):
            some = order[block : min(block + ROWS, b)]
            places = np.minimum(starts[some] + np.arange(width)[:, None], len(symbols) - 1)
            matrix = np.where(np.arange(width)[:, None] < sizes[some], symbols[places], np.int32(vocab.none))
            taken[some], matrix = vocab.agendas(matrix, None if states is None else states[some], limit)
            matrix = matrix.T
            left = matrix != vocab.none
            count[some] = left.sum(axis=1)
            begin[some] = at + np.cumsum(count[some]) - count[some]
            out.append(matrix[left])
            at += len(out[-1])
    return np.concatenate(out), begin, count, taken


def encode_slice(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, path: str = MODEL, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each, whether they spell it) of UTF-8 texts. What ``encode`` gives, for many texts at once."""
    vocab, limit, texts = vocabulary(path), int(rate * 2**32), len(offsets) - 1
    if vocab.prefix:
        filled = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][filled], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    symbols, bounds = _symbols(vocab, data, offsets)
    space = symbols == vocab.space
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(starts, append=len(symbols))
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(texts), np.diff(first))
    place = (np.arange(len(starts)) - first[text]).astype(np.uint64)
    document = mix(keys.astype(np.int64).view(np.uint64) * np.uint64(_DOCUMENT) + np.uint64(seed))
    states = mix(document[text] + place * np.uint64(_OCCURRENCE))
    kept = np.flatnonzero(sizes <= WIDTHS[-1])
    # Different parts are told apart by hash; the check of what the ids spell would show two of one hash.
    _, at, of = np.unique(range_hashes(symbols, starts[kept], starts[kept] + sizes[kept]), return_index=True, return_inverse=True)
    pool, begin, count, taken = _solved(vocab, symbols, starts[kept][at], sizes[kept][at], None, 0)
    start, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    start[kept], size[kept] = begin[of], count[of]
    pools, upto = [pool], len(pool)
    if limit:
        live, n, hit = np.arange(len(kept)), 0, []
        while len(live):
            live = live[taken[of[live]] > n]
            n += 1
            drop = mix(states[kept[live]] + np.uint64(n * _CANDIDATE & _MASK)) >> np.uint64(32) < np.uint64(limit)
            hit.append(live[drop])
            live = live[~drop]
        some = kept[np.concatenate([np.zeros(0, np.int64), *hit])]
        pool, begin, size[some], _ = _solved(vocab, symbols, starts[some], sizes[some], states[some], limit)
        start[some] = upto + begin
        pools.append(pool)
        upto += len(pool)
    for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
        part = vocab.spell(symbols[starts[i] : starts[i] + sizes[i]])[0].tobytes().decode()
        pools.append(np.array(vocab.segment(part, Skips(int(document[text[i]]), int(place[i]), limit)), np.int32))
        start[i], size[i] = upto, len(pools[-1])
        upto += len(pools[-1])
    ends = np.cumsum(size)
    ids = np.concatenate(pools)[_runs(start, size, ends)]
    counts = np.diff(np.concatenate([[0], ends])[first])
    spelt, behind = vocab.spell(ids)
    got = np.concatenate([[0], behind])[np.concatenate([[0], np.cumsum(counts)])]
    if np.array_equal(got, offsets) and np.array_equal(spelt, data):
        return ids.astype(vocab.kind), counts, np.ones(texts, bool)
    return _one_by_one(data, offsets, keys, path, rate, seed)


def _one_by_one(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, path: str, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice in which two parts have one hash."""
    vocab = vocabulary(path)
    texts = [data[a:b].tobytes().decode()[vocab.prefix and a < b :] for a, b in zip(offsets[:-1], offsets[1:])]
    found = [encode(t, path, rate, seed, int(k)) for t, k in zip(texts, keys)]
    return np.concatenate([np.zeros(0, np.uint32), *found]).astype(vocab.kind), np.array([len(x) for x in found], np.int64), np.array([vocab.decode(x.tolist()) == t for x, t in zip(found, texts)], bool)


def tokenize(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), path: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """The columns of ``keep`` with n_tokens, tokens (little-endian uint16, or uint32 for over 65,536 pieces, as binary) and lossless (decoding gave the text).

    One narrow pass over the texts; no shuffle.
    """
    sessions.prepare(docs.sparkSession)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(F.col(f"`{key}`")).alias("__key"), F.col(f"`{text}`").alias("__text"))
    names = [*keep, "n_tokens", "tokens", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            for a, b in slices(offsets, SLICE):
                ids, counts, same = encode_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keys[a:b], path, rate, seed)
                ends = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-2]], pa.array(counts.astype(np.int64)), packed, pa.array(same)], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-2]]
    return chosen.mapInArrow(run, ", ".join([*fields, "n_tokens bigint, tokens binary, lossless boolean"]))
