"""Secret scans through layers of encoding.

Method. Work starts with the text itself. Each layer is scanned for
secrets, then for encoded parts: percent escapes, Unicode escapes and character
references, base64 runs (also behind other letters, or broken over lines), and
zlib or gzip data inside them. Each part becomes a layer of its own, worked on before the next part. What
was found in a layer is kept by its digest and mapped through every further place
of the same content; a layer inside an equal one isn't worked on, so cycles end;
every layer is made of fewer or equal bytes than the one around it, except
decompressed ones, which are read to their end, ``MAX_INFLATED`` bytes at a time,
and cut into layers where no secret and no encoded part can be cut. Spans found in a layer are mapped back through
the layers to code points of the text: escapes are mapped piece by piece, base64
by its quartets, compressed layers to the whole run.

Defined results. A null text is empty. A secret inside several layers is
reported once for each span it maps to; base spans of the text are always kept.
Rows are independent, so repeated rows get equal results; a very long text is
worked on alone. Kept columns may have any names: if one is called ``base`` or
``every``, the result's own column gets an underscore. An empty table gives an
empty result.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import sessions

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 and more are the runs of ``[0-9a-f]+`` that have 16 and more characters.
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Four digits, or two surrogates of four; eight after a capital U; one to six in braces.
_UNICODE = re.compile(
    r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]?[0-9A-Fa-f]+;|&(?:quot|amp|apos|lt|gt|equals|colon);"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 broken over lines: lines of 16 letters or more, and a last one.
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]{2,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: How gzip and zlib data begin, behind other bytes.
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: The shortest secret: 16 hex digits.
LEAST_BYTES = 16
#: Bytes of compressed data that are decompressed at once.
MAX_INFLATED = 1 << 20
#: Characters that are in no secret and no encoded part: data are cut after them.
_APART = "\n\r\t,()!?<>[]|\ufffd"


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of one layer."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """Decoded text and where it comes from.

    marks: sorted places in this text; lows, highs: for the part from each mark
    to the next, the span of the parent's text it was made from. A part with
    equal lengths maps place by place, unless whole is set.
    """

    def __init__(self, text: str, marks: list[int], lows: list[int], highs: list[int], whole: bool = False):
        self.text, self.marks, self.lows, self.highs, self.whole = text, marks, lows, highs, whole

    def up(self, start: int, end: int) -> tuple[int, int]:
        """The span of the parent's text that start..end was made from."""
        return self._one(start, False), self._one(end - 1, True)

    def _one(self, place: int, last: bool) -> int:
        i = bisect_right(self.marks, place) - 1
        size = (self.marks[i + 1] if i + 1 < len(self.marks) else len(self.text)) - self.marks[i]
        if self.highs[i] - self.lows[i] == size and not self.whole:
            return self.lows[i] + place - self.marks[i] + last
        return self.highs[i] if last else self.lows[i]


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer's text with each match decoded, or None if nothing is."""
    out, marks, lows, highs, size, at = [], [], [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None or new == m[0]:
            continue
        if m.start() > at:
            marks.append(size), lows.append(at), highs.append(m.start())
            out.append(layer.text[at : m.start()])
            size += m.start() - at
        if new:
            marks.append(size), lows.append(m.start()), highs.append(m.end())
            out.append(new)
            size += len(new)
        at = m.end()
    if not out and at == 0:
        return None
    if at < len(layer.text):
        marks.append(size), lows.append(at), highs.append(len(layer.text))
        out.append(layer.text[at:])
    text = "".join(out)
    return Layer(text, marks, lows, highs) if text else None


def _percent(m: re.Match) -> str | None:
    try:
        return binascii.unhexlify(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _escape(m: re.Match) -> str | None:
    if m[1]:
        return chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
    digits = m[3] or m[4] or m[5] or m[6]
    if digits:
        point = int(digits, 16)
        return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None
    return html.unescape(m[0])


def _packed(data: bytes) -> bool:
    """Whether the bytes begin like zlib or gzip data."""
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def _inflated(data: bytes) -> Iterator[bytes]:
    """All that zlib or gzip data decompress to, all members one after another, at most MAX_INFLATED bytes at a time; up to a fault in the data."""
    while _packed(data):
        stream = zlib.decompressobj(47)
        try:
            while not stream.eof:
                part = stream.decompress(data, MAX_INFLATED)
                if part:
                    yield part
                elif not stream.unconsumed_tail:
                    break
                data = stream.unconsumed_tail
        except zlib.error:
            return
        data = stream.unused_data


def _windows(data: bytes) -> Iterator[str]:
    """The decompressed text, cut only after characters that no secret and no encoded part holds. Bytes that aren't UTF-8 become U+FFFD, which is such a one."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), []
    for part in _inflated(data):
        text = decoder.decode(part)
        cut = max(map(text.rfind, _APART)) + 1
        if cut:
            yield "".join([*held, text[:cut]])
            held = []
        held.append(text[cut:])
    held.append(decoder.decode(b"", True))
    if rest := "".join(held):
        yield rest


def _parts(text: str) -> Iterator[tuple[str, int, int, list[int]]]:
    """Base64 of a text: (letters, start, end, places of the line breaks taken out, counted in letters, with the sizes of what went)."""
    for m in _BASE64.finditer(text):
        yield m[0].rstrip("="), m.start(), m.end(), []
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        letters, breaks = [], []
        for line in _LINE.finditer(text, m.start(), m.end()):
            breaks.append((sum(map(len, letters)), line.start()))
            letters.append(line[0])
        yield "".join(letters), m.start(), m.end(), breaks


def _runs(layer: Layer) -> Iterator[Layer]:
    """Layers of the base64 in a layer, and of compressed data in them.

    A run may follow other letters, so it is read from each of its first four
    places. Bytes are read as one character each: secrets and encodings are ASCII,
    so no byte elsewhere can hide one.
    """
    for letters, start, end, breaks in _parts(layer.text):
        # Under 24 letters of one case hold at most 17 bytes, and hex digits always give both cases: no secret.
        if len(letters) < 24 and letters.isalpha() and (letters.islower() or letters.isupper() or letters.istitle()):
            continue
        plain = letters.replace("-", "+").replace("_", "/")
        for skip in range(min(4, len(plain))):
            run = plain[skip:]
            run = run[:-1] if len(run) % 4 == 1 else run
            data = binascii.a2b_base64(run + "=" * (-len(run) % 4))
            inflated = False
            for at in {0, *(m.start() for m in _PACKED.finditer(data))} if len(data) > 8 else ():
                for text in _windows(data[at:]):
                    inflated |= not at
                    yield Layer(text, [0], [start], [end], whole=True)
            if inflated:
                continue
            if len(data) < LEAST_BYTES:
                continue
            marks = list(range(0, len(data), 3))
            lows = [skip + i // 3 * 4 for i in marks]
            highs = [min(x + 4, len(letters)) - 1 for x in lows]
            if breaks:
                ats = [a for a, _ in breaks]
                place = lambda i: breaks[k := bisect_right(ats, i) - 1][1] + i - ats[k]
            else:
                place = lambda i: start + i
            yield Layer(data.decode("latin-1"), marks, [place(i) for i in lows], [place(i) + 1 for i in highs], whole=True)


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    text = layer.text
    if "%" in text and (new := _replaced(layer, _PERCENT, _percent)):
        yield new
    if ("\\" in text or "&" in text) and (new := _replaced(layer, _UNICODE, _escape)):
        yield new
    yield from _runs(layer)


class _Open:
    """A layer that is worked on: its inner layers to come, spans found so far, and the outermost open layer that a cycle led back to."""

    def __init__(self, layer: Layer, digest: bytes, depth: int):
        self.layer, self.digest, self.low = layer, digest, depth
        self.inner, self.found = unwrap(layer), set(scan(layer.text))


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a whole text, each in order of start, then kind."""
    base = scan(text)
    digest = hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()
    work, depths = [_Open(Layer(text, [], [], []), digest, 0)], {digest: 0}
    done: dict[bytes, set[tuple[str, int, int]]] = {}
    while True:
        here = work[-1]
        inner = next(here.inner, None)
        if inner is not None:
            digest = hashlib.sha1(inner.text.encode("utf-8", "surrogatepass")).digest()
            if digest in depths:
                here.low = min(here.low, depths[digest])
            elif digest in done:
                here.found.update((kind, *inner.up(a, b)) for kind, a, b in done[digest])
            else:
                depths[digest] = len(work)
                work.append(_Open(inner, digest, len(work)))
            continue
        work.pop()
        del depths[here.digest]
        if not work:
            break
        if here.low < len(work):  # what a cycle cut off is known to an outer layer only
            work[-1].low = min(work[-1].low, here.low)
        else:
            done[here.digest] = here.found
        work[-1].found.update((kind, *here.layer.up(a, b)) for kind, a, b in here.found)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(here.found, key=order)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with base and every: arrays of (kind, start, end), in code points, end exclusive.

    One narrow pass over the texts; no shuffle.
    """
    sessions.prepare(docs.sparkSession)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    own = [sessions.spare(c, list(keep)) for c in ("base", "every")]
    names = [*keep, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in row[i]] for row in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return chosen.mapInArrow(run, ", ".join([*fields, *[f"`{c}` {span}" for c in own]]))


def _text_of(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and the list of all spans, in place of the last two columns of ``find``."""
    *others, base, every = found.columns
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(*[f"`{c}`" for c in others], *[count(k) for k in KINDS], F.sha2(F.encode(_text_of(base), "UTF-8"), 256).alias("base_sha256"), _text_of(every).alias("spans"))
