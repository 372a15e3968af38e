"""Chats as training text.

The content of a turn is text, or a list of typed parts: text, image, audio, document. A
visitor flattens the parts: text is escaped, each other part becomes a placeholder where it
stands, and what it refers to is recorded with the number of tokens it will take.

A turn is `[INST]role[/INST]content</s>`. Control strings begin with `<` or `[`; in texts a
backslash follows each of these and each backslash, so that no control string can come out of
a text, and dropping it again gives the text back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope.llm.common import per_batch, struct_array

OPEN, SAID, END = "[INST]", "[/INST]", "</s>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
LEARNED = "assistant"  # the role whose texts are under the loss mask
PATCH = 14  # pixels, each way, of an image token
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 1024

PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])
ATTACHMENTS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPECIAL = re.compile(r"([\\<\[])")
ESCAPED = re.compile(r"([\\<\[])\\")


def escape(text: str) -> str:
    return SPECIAL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one turn in order."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        """A null part is nothing; a part of another type is an error, not left out."""
        if part is None:
            return
        visit = self.by_type.get(part["type"])
        if visit is None:
            raise ValueError(f"a part of a chat can't be of type {part['type']!r}")
        visit(self, part)

    def text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def image(self, part: dict) -> None:
        across, down = (math.ceil((part[side] or 0) / PATCH) for side in ("width", "height"))
        self.attach(part, across * down)

    def audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0) * AUDIO_RATE))

    def document(self, part: dict) -> None:
        self.attach(part, (part["pages"] or 0) * PAGE_TOKENS)

    def attach(self, part: dict, tokens: int) -> None:
        self.out.append(PLACEHOLDER[part["type"]])
        self.attachments.append({"type": part["type"], "ref": part["ref"], "tokens": tokens})

    by_type: dict[str | None, Callable] = {
        "text": text, "image": image, "audio": audio, "document": document,
    }


def flatten(content: Column) -> Column:
    """Of a list of parts: a struct of content, attachments and their number of tokens."""

    def run(lists: pa.Array) -> pa.Array:
        turns = []
        for parts in lists.to_pylist():
            turn = Flattener()
            for part in parts or []:
                turn.visit(part)
            turns.append(turn)
        return struct_array(
            content=pa.array(["".join(t.out) for t in turns], pa.string()),
            attachments=pa.array([t.attachments for t in turns], ATTACHMENTS),
            tokens=pa.array([sum(a["tokens"] for a in t.attachments) for t in turns], pa.int64()),
        )

    kind = "struct<content:string, attachments:array<struct<type:string,ref:string,tokens:bigint>>, tokens:bigint>"
    return per_batch(run, kind)(content)


def as_parts(text: Column) -> Column:
    """Plain text as the one part of a content."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]],
    ))


def render(turns: list[dict]) -> tuple[str, list[dict]]:
    """A conversation's turns in order as one string, and where the learned texts are in it."""
    out, at, spans = [], 0, []
    for turn in turns:
        head = f"{OPEN}{escape(turn['role'] or '')}{SAID}"
        content = turn["content"] or ""
        if turn["role"] == LEARNED:
            spans.append({"start": at + len(head), "end": at + len(head) + len(content)})
        out += [head, content, END]
        at += len(head) + len(content) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation; placeholders stay as they are."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, content = turn.removeprefix(OPEN).partition(SAID)
        turns.append((unescape(role), unescape(content)))
    return turns


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, tokens.

    Needs conv_id, turn, role, and `content` (a list of parts) or `text`; other columns are
    ignored. Turns are ordered by turn, then role and content, so ties have one order; a null
    turn comes first. A null role is an empty one, a null text or list an empty content. Rows
    that repeat are turns of their own. A null conv_id is one conversation. Spans are in code
    points of `formatted`, end exclusive. No rows give no conversations.
    """
    parts = F.col("content") if "content" in turns.columns else as_parts(F.col("text"))
    flat = turns.select("conv_id", "turn", "role", flatten(parts).alias("f_"))
    one = F.struct("turn", "role", "f_.content", "f_.attachments", "f_.tokens")
    grouped = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns_"))

    def run(conversations: pa.Array) -> pa.Array:
        rows = [render(c) for c in conversations.to_pylist()]
        return struct_array(
            formatted=pa.array([r[0] for r in rows], pa.string()),
            loss_spans=pa.array([r[1] for r in rows], SPANS),
        )

    kind = "struct<formatted:string, loss_spans:array<struct<start:bigint,end:bigint>>>"
    text = F.transform("turns_", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    return grouped.select(
        "conv_id", per_batch(run, kind)(text).alias("r_"),
        F.flatten(F.transform("turns_", lambda t: t.attachments)).alias("attachments"),
        F.aggregate("turns_", F.lit(0).cast("bigint"), lambda n, t: n + t.tokens).alias("tokens"),
    ).select("conv_id", "r_.*", "attachments", "tokens")


def digests(chats: DataFrame) -> DataFrame:
    """What formatted conversations say, read back from them.

    Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars):
    turns_sha256 is of role, line feed, text, line feed of each turn; loss_* of the text under
    the loss mask, unescaped.
    """

    def run(formatted: pa.Array, spans: pa.Array) -> pa.Array:
        counts, said, learned = [], [], []
        for text, places in zip(formatted.to_pylist(), spans.to_pylist()):
            turns = parse(text)
            counts.append(len(turns))
            said.append("".join(f"{role}\n{content}\n" for role, content in turns))
            learned.append("".join(unescape(text[p["start"] : p["end"]]) for p in places))
        return struct_array(
            n_turns=pa.array(counts, pa.int64()),
            turns_sha256=pa.array(list(map(_sha256, said)), pa.string()),
            loss_chars=pa.array(list(map(len, learned)), pa.int64()),
            loss_sha256=pa.array(list(map(_sha256, learned)), pa.string()),
            formatted_chars=pa.array(list(map(len, formatted.to_pylist())), pa.int64()),
        )

    kind = (
        "struct<n_turns:bigint, turns_sha256:string, loss_chars:bigint, loss_sha256:string, "
        "formatted_chars:bigint>"
    )
    found = per_batch(run, kind)("formatted", "loss_spans").alias("d_")
    return chats.select("conv_id", found).select("conv_id", "d_.*")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
