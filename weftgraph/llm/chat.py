"""Chat formatting from event logs.

Method. A log holds events of conversations: parts of messages as they were
streamed (``delta``), replacements of a message's text (``edit``), restarts of a
message (``regenerate``) and removals (``delete``); ``message`` is a whole message
of its own. Events are dealt by conversation, sorted by sequence and folded into
final messages; messages are then rendered with a template that marks turns and
escapes control strings in texts, reversibly, and the loss mask covers the
assistants' texts.

Streams of one conversation overlap in its sequence. An event only acts on its own
message, so the rows are sorted by message and, within it, by sequence: folding is
a stream over sorted rows, and an executor holds one message at a time, however
long its conversation is. One task takes a whole conversation, since its output
and its digests are ordered. Rendered turns are rows of their
own with their place in the conversation's output, so no value holds a whole
conversation.

Template. A turn is ``### <Role>: `` + text + `` </turn>\\n``. In texts,
``\\``, ``###`` and ``</turn>`` are written ``\\\\``, ``\\3`` and ``\\/``, so neither mark
occurs in an escaped text; reading back reverses that. Role names other than the three known ones are written as
``### Other(<escaped role>): ``.

Defined results. A null text is an empty text, a null role an empty role. Rows
with the same conversation and sequence are taken in order of message, role and
text. Events of a conversation whose id is null form a conversation of their
own. An empty table gives an empty result. A message without a surviving event
(deleted) is not rendered. Rows of a table that repeat a conversation and turn are
messages of their own, in order of role and text. Extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import sessions

_ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMES = {v: k for k, v in _ROLES.items()}
END = " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_WRITTEN = {"\\": "\\\\", "###": "\\3", "</turn>": "\\/"}
_READ = {v: k for k, v in _WRITTEN.items()}
_ESCAPED = re.compile(r"\\[\\3/]")
_TURN = re.compile(r"### (?:(System|User|Assistant)|Other\(((?:[^\\)]|\\.)*)\)): ", re.S)

EVENTS = "conv_id bigint, seq bigint, msg bigint, kind string, role string, text string"
MESSAGES = "conv_id bigint, msg bigint, role string, text string"
TURNS = "conv_id bigint, turn bigint, start bigint, loss_start bigint, loss_end bigint, rendered string"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _WRITTEN[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _READ[m[0]], text)


def head(role: str) -> str:
    if role in _ROLES:
        return f"### {_ROLES[role]}: "
    return "### Other(" + re.sub(r"[\\)]", lambda m: "\\" + m[0], escape(role)) + "): "


def render(role: str, text: str) -> tuple[str, int, int]:
    """(the turn, start and end of the escaped text in it)."""
    before, body = head(role), escape(text)
    return before + body + END, len(before), len(before) + len(body)


def parse(turn: str) -> tuple[str, str, int, int]:
    """(role, text, start and end of the escaped text), read back from a rendered turn."""
    m = _TURN.match(turn)
    if m is None or not turn.endswith(END):
        raise ValueError("not a rendered turn")
    role = _NAMES[m[1]] if m[1] else unescape(re.sub(r"\\([\\)])", r"\1", m[2]))
    end = len(turn) - len(END)
    return role, unescape(turn[m.end() : end]), m.end(), end


def events_of(conversations: DataFrame) -> DataFrame:
    """A log (EVENTS) whose final messages are the rows (conv_id, turn, role, text) of a table, by turn.

    A hash of each message picks how it came about: streamed in three parts; a draft
    and an edit; a false start and a regeneration; or all of that. Streams of
    neighbouring messages overlap, and every other message's events stand in the log
    in reverse.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = rows.withColumn("msg", (F.row_number().over(by_turn) - 1).cast("long")).withColumn("h", F.xxhash64("conv_id", "msg", "text"))
    n = F.length("text") + 1
    cuts = number.withColumn("x", F.pmod("h", n).cast("int")).withColumn("y", F.pmod(F.shiftright("h", 20), n).cast("int"))
    a, b = F.least("x", "y"), F.greatest("x", "y")
    one, two, three = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, n)
    rest = F.substring("text", a + 1, n)
    event = lambda step, kind, part: F.struct((F.col("msg") * 8 + step * 11).alias("seq"), F.lit(kind).alias("kind"), part.alias("part"))
    streamed = lambda start: [event(start + i, "delta", p) for i, p in enumerate((one, two, three))]
    draft = F.concat(F.lit("draft: "), two)
    ways = [
        F.array(*streamed(0)),
        F.array(event(0, "delta", draft), event(1, "delta", one), event(2, "edit", F.col("text"))),
        F.array(event(0, "delta", F.reverse(F.col("text"))), event(1, "regenerate", one), event(2, "delta", rest)),
        F.array(event(0, "delta", one), event(1, "edit", draft), event(2, "delete", F.lit("")), event(3, "regenerate", F.lit("")), *streamed(4)),
    ]
    way = F.pmod(F.shiftright("h", 40), F.lit(len(ways)))
    events = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    dealt = F.when(F.col("msg") % 2 == 1, F.reverse(events)).otherwise(events)
    return cuts.select("conv_id", "msg", "role", F.explode(dealt).alias("e")).select("conv_id", "e.seq", "msg", "e.kind", "role", F.col("e.part").alias("text"))


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages (conv, msg, role, text) from events (conv, seq, msg, kind, role, text) in order of (conv, msg, seq).

    ``message`` is a whole message of its own; the other kinds act on message ``msg``.
    """
    open_key, role, parts, alive = None, "", [], False
    for conv, _, msg, kind, who, text in rows:
        if open_key is not None and (kind == "message" or (conv, msg) != open_key):
            if alive:
                yield (*open_key, role, "".join(parts))
            open_key = None
        if kind == "message":
            yield conv, msg, who or "", text or ""
            continue
        if open_key is None:
            open_key, role, parts, alive = (conv, msg), who or "", [], False
        role = who or role
        if kind == "delete":
            parts, alive = [], False
        elif kind == "regenerate":
            parts, alive = [text or ""], True
        elif kind == "edit":
            parts, alive = [text or ""], True
        else:
            parts.append(text or "")
            alive = True
    if open_key is not None and alive:
        yield (*open_key, role, "".join(parts))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]], most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, types)
            held = []
    if held:
        yield _batch(held, types)


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


_LONG, _TEXT = pa.int64(), pa.string()


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, started, turn, at = None, False, 0, 0
    for c, _, role, text in fold(rows):
        if not started or c != conv:
            conv, started, turn, at = c, True, 0, 0
        out, a, b = render(role, text)
        loss = (at + a, at + b) if role == "assistant" else (None, None)
        yield c, turn, at, *loss, out
        turn, at = turn + 1, at + len(out)


def format_log(events: DataFrame) -> DataFrame:
    """Rendered turns (TURNS) of a log (EVENTS), in order within partitions by conversation.

    Messages stand in the order of their number, or of their event where they have
    none; places and loss spans are code points of the conversation's whole output.
    """
    sessions.prepare(events.sparkSession)
    log = events.select(*[F.col(c.split()[0]) for c in EVENTS.split(", ")])
    log = log.withColumn("msg", F.coalesce("msg", "seq"))
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "seq", "kind", "role", "text")
    types = list(zip(("conv_id", "turn", "start", "loss_start", "loss_end", "rendered"), (_LONG, _LONG, _LONG, _LONG, _LONG, _TEXT)))
    return dealt.mapInArrow(lambda batches: _batched(_turns(_rows(batches)), types), TURNS)


def _read_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, state = None, None
    for c, _, start, loss_start, loss_end, out in rows:
        if state is None or c != conv:
            if state is not None:
                yield _closed(conv, state)
            conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        role, text, _, _ = parse(out)
        state[0] += 1
        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_start is not None:
            said = unescape(out[loss_start - start : loss_end - start])
            state[2] += len(said)
            state[3].update(said.encode("utf-8", "surrogatepass"))
        state[4] += len(out)
    if state is not None:
        yield _closed(conv, state)


def _closed(conv, state) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation (DIGEST), read back from rendered turns as format_log returns them, in a stream."""
    types = list(zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), (_LONG, _LONG, _TEXT, _LONG, _TEXT, _LONG)))
    return turns.mapInArrow(lambda batches: _batched(_read_back(_rows(batches)), types), DIGEST)
