"""Chat formatting: event logs of conversations folded into final messages, rendered by a template, with a loss mask."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Kinds of events that refer to an earlier message.
REFERRING = ("delta", "edit", "regenerate")
#: A longer conversation is formatted in blocks of about so many characters.
BLOCK = 1_000_000

#: Inside texts, what could begin a control string is written as a backslash and a letter; so no text holds one.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_table = str.maketrans(ESCAPES)
_back = {v[1]: k for k, v in ESCAPES.items()}
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"<<SYS>>([^<\[]*)<</SYS>>|\[INST\] ([^<\[]*) \[/INST\]| ([^<\[]*) </s>|<role=([^<\[>]*)>([^<\[]*)</role>")


def escape(text: str) -> str:
    return text.translate(_table)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _back[m[1]], text)


class Fold:
    """The messages of one conversation, folded from its events (seq, kind, role, text, target) as they come in order of seq, nulls
    first.

    message: begins a message. delta: appends to the message that began at seq `target`, or else to the last one. edit: replaces
    the text of that message. regenerate: drops it and all that follow, and begins a message in its place. A delta or edit of a
    message that isn't there, or an event of another kind, begins a message of its own.
    """

    def __init__(self):
        self.messages: list[list] = []  # seq at which it began, role, parts of the text; by seq, as events come

    def add(self, seq, kind, role, text, target) -> None:
        at = self._found(target) if kind in REFERRING else None
        if kind == "delta" and at is not None:
            self.messages[at][2].append(text or "")
        elif kind == "edit" and at is not None:
            self.messages[at][2] = [text or ""]
        else:
            if kind == "regenerate" and at is not None:
                del self.messages[at:]
            self.messages.append([seq, role or "", [text or ""]])

    def _found(self, target) -> int | None:
        at = len(self.messages) - 1
        if target is not None:
            at = bisect_right(self.messages, (True, target), key=lambda m: (m[0] is not None, m[0] or 0)) - 1
        return at if at >= 0 and target in (None, self.messages[at][0]) else None

    def settled(self, reach) -> list[tuple[str, str]]:
        """Takes out the messages that no later event can change, where `reach` is the least target of later events (None: none has
        one): those that began before it, but for the last, which events without a target may change."""
        n, most = 0, len(self.messages) - 1
        while n < most and (reach is None or self.messages[n][0] is None or self.messages[n][0] < reach):
            n += 1
        return self._take(n)

    def rest(self) -> list[tuple[str, str]]:
        return self._take(len(self.messages))

    def _take(self, n: int) -> list[tuple[str, str]]:
        taken = [(role, "".join(parts)) for _, role, parts in self.messages[:n]]
        del self.messages[:n]
        return taken


def fold(events) -> list[tuple[str, str]]:
    """The final messages (role, text) of one conversation, from its events in order."""
    found = Fold()
    for event in events:
        found.add(*event)
    return found.rest()


def render(messages, first: bool = True) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, or a block of it that isn't its first, and where in it (code points) the loss mask begins and
    ends: at assistants' texts."""
    out, starts, ends = ["<s>" * first], [], []
    at = len(out[0])
    for role, text in messages:
        text = escape(text)
        if role == "system":
            out.append(f"<<SYS>>{text}<</SYS>>")
        elif role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
            starts.append(at + 1)
            ends.append(at + 1 + len(text))
        else:
            out.append(f"<role={escape(role).replace('>', chr(92) + 'g')}>{text}</role>")
        at += len(out[-1])
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that render() was given."""
    messages, at = [], 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        role, text = next((r, t) for r, t in (("system", m[1]), ("user", m[2]), ("assistant", m[3]), (None, m[5])) if t is not None)
        messages.append((unescape(m[4].replace("\\g", ">")) if role is None else role, unescape(text)))
        at = m.end()
    return messages


FORMATTED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The rows as a batch; the list is emptied."""
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def in_rows(batches, at_once: int):
    """Rows of the batches, of which `at_once` at most are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns))


def blocks(batches, most: int = BLOCK):
    """Rows of FORMATTED from those of (conv_id, seq, kind, role, text, target, reach), each conversation's one after the other in
    order. When `most` characters have come, the messages that are settled are let go as a block."""
    rows: list[tuple] = []
    found, key, block, came, size = None, None, 0, 0, 0

    def put(messages) -> None:
        nonlocal block, size
        if messages:
            rows.append((key, block, len(messages), *render(messages, block == 0)))
            block, size = block + 1, size + len(rows[-1][3])

    for conv, *event, reach in in_rows(batches, 256):
        if found is None or conv != key:
            if found is not None:
                put(found.rest())
            found, key, block, came = Fold(), conv, 0, 0
        found.add(*event)
        came += len(event[3] or "") + 1
        if came > most:
            put(found.settled(reach))
            came = 0
        if size > 8_000_000 or len(rows) >= 2000:
            yield as_batch(rows, FORMATTED)
            size = 0
    if found is not None:
        put(found.rest())
    if rows:
        yield as_batch(rows, FORMATTED)


def format_chats(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Formatted conversations from events (conv_id, seq, kind, role, text, target): conv_id, block, n_turns, formatted, and the
    loss mask as loss_starts and loss_ends, offsets into formatted. A conversation is one row, or if longer than about `block`
    characters several, numbered from 0, each of whole messages; one after the other, they are the conversation.

    Events are dealt by conversation and sorted by seq, on disk if need be. With each comes the least seq that it or a later event
    refers to, by a running minimum from the end; so the fold, which reads them as a stream, holds only the messages that an event
    still to come may change, the last one and a block, and a conversation of any length goes through a worker of bounded memory
    unless its last events refer to its first. Its events are still read by one task, in order.

    Ties of seq are ordered by kind (a message before its deltas), role and text. Null seq comes first, null role and text are
    empty, a null conv_id is a conversation of its own. A repeated row is one more event. Without events there are no rows.
    """
    rank = F.when(F.col("kind").isin("delta", "edit"), 1).otherwise(0)
    events = events.select(F.col("conv_id").cast("bigint"), F.col("seq").cast("bigint"), "kind", "role", "text", F.col("target").cast("bigint"))
    later = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("seq")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.min(F.when(F.col("kind").isin(*REFERRING), F.col("target"))).over(later)
    dealt = events.repartition("conv_id").withColumn("reach", reach).sortWithinPartitions("conv_id", "seq", rank, "role", "text")
    return dealt.mapInArrow(partial(blocks, most=block), "conv_id bigint, block bigint, n_turns bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(batches):
    """Rows of READ from those of FORMATTED, each conversation's blocks one after the other in order; holds one block."""
    rows: list[tuple] = []
    key = None
    turns = None

    def end() -> None:
        rows.append((key, n, turns.hexdigest(), chars, lost.hexdigest(), size))

    for conv, block, _, text, starts, ends in in_rows(batches, 16):
        if turns is None or block == 0 or conv != key:
            if turns is not None:
                end()
                if len(rows) >= 2000:
                    yield as_batch(rows, READ)
            key, turns, lost, n, chars, size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        messages = parse(text)
        n, size = n + len(messages), size + len(text)
        for role, said in messages:
            turns.update(f"{role}\n{said}\n".encode())
        for a, b in zip(starts, ends):
            chars += len(said := unescape(text[a:b]))
            lost.update(said.encode())
    if turns is not None:
        end()
        yield as_batch(rows, READ)


def read_chats(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """What format_chats() made, read back, one row a conversation: numbers and digests of the turns and of the text under the loss
    mask. A digest follows the blocks in order, so they are dealt by conversation and sorted, unless they are already so (`dealt`),
    as they come from format_chats(). Without rows there are none."""
    if not dealt:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return formatted.mapInArrow(digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log in which each turn is a message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("bigint").alias("target"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_chats(format_chats(as_events(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))), dealt=True)


QUERIES = {"op8_chat_format": op8_chat_format}
ORACLE = {
    "op8_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(text) + length(text) - length(translate(text, '\<[', '')) AS chars, length(role) + length(role) - length(translate(role, '\<[>', '')) AS role_chars FROM rows)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE WHEN role IN ('user', 'system') THEN 15 WHEN role = 'assistant' THEN 6 ELSE 14 + role_chars END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
}
