"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events in sequence: ``message`` begins a message (with a role and some text),
``delta`` appends to one, ``edit`` replaces its text, ``regenerate`` empties it and drops all messages after it.
Logs are dealt by conversation and sorted by sequence; a streaming fold keeps the messages of one conversation
at a time, whatever the batches are, and renders them when the next begins. Only a conversation's own output
has to fit in memory.

A rendered turn is ``<s>role\\ntext</s>``. Control strings inside roles and texts get a backslash after their
first character and backslashes are doubled, so no text can end its turn and unescaping gives it back exactly.
The loss mask is a list of [begin, end) spans of code points over the assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, CLOSE, LEARNED = "<s>", "</s>", "assistant"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(CLOSE), re.DOTALL)
_BROKEN = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left in the result, and ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def escape_role(role: str) -> str:
    """A role on one line: a line break in it becomes a backslash and an n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _BROKEN.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1], m[1]), role)


def fold(messages: list[list], kind: str, message, role: str, text: str) -> None:
    """Applies one event to [id, role, parts] messages; a change to an unknown message is a message of its own."""
    at = len(messages) - 1
    if message is not None and kind != "message":
        at = next((i for i in range(len(messages) - 1, -1, -1) if messages[i][0] == message), -1)
    if kind == "message" or at < 0:
        messages.append([message, role, [text]])
    elif kind == "delta":
        messages[at][2].append(text)
    elif kind == "edit":
        messages[at][2] = [text]
    elif kind == "regenerate":
        messages[at][2] = [text]
        del messages[at + 1 :]
    else:
        raise ValueError(f"unknown kind of event: {kind}")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted text and the spans of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape_role(role) + "\n", escape(text)
        if role == LEARNED:
            spans.append({"begin": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns = []
    for inner in _TURN.findall(formatted):
        role, _, text = inner.partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<begin,end>>) of (conv_id, seq, kind, message, role, text) events.

    Defined cases: null roles and texts are empty; a null kind is ``message``; events that tie in ``seq`` are
    taken by role, then text, then kind; repeated rows are repeated events; null conv_ids are one conversation;
    an empty log gives an empty result; other columns are ignored.
    """
    ship(events.sparkSession)
    schema = "conv_id long, formatted string, loss array<struct<begin:long,end:long>>"
    kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
    clean = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.col("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text", "kind").drop("seq")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, messages, done, weight = None, None, [], 0

        def close():
            text, spans = render([(role, "".join(parts)) for _, role, parts in messages])
            done.append((now, text, spans))
            return len(text)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)

        for batch in batches:
            for conv, kind, message, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if messages is None or conv != now:
                    if messages is not None:
                        weight += close()
                        if weight > 8 << 20:
                            yield flush()
                            done, weight = [], 0
                    now, messages = conv, []
                fold(messages, kind, message, role, text)
        if messages is not None:
            close()
        if done:
            yield flush()

    return dealt.mapInArrow(over, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turn counts and digests read from formatted texts and their masks."""
    ship(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns, learned = parse(text), "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                rows.append((conv, len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(over, schema)


def turn_events(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as an event that begins a message."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("message"), "role", "text")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return read_back(format_chats(turn_events(rows.unionByName(tricky))))
