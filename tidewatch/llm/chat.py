"""Chat formatting by schema fingerprints.

A record (JSON) is recognised by the set of its nested field paths: sorted, joined and hashed, they name a declarative mapping that
tells where turns, roles and texts lie. Mappings cover records of prompt and response, instruction, input and output, lists of messages
and single turns. What comes out are canonical turns (id, turn, part, role, text).

A template then marks turns; control strings inside roles and texts are escaped, reversibly: each backslash is doubled, and `\\-` is put
behind the first character of each control string. A segment is one formatted turn, and a conversation is its segments in order, so a reader needs
one turn at a time: conversations of any length are read back as a sorted stream in constant memory.

Defined results: null texts and roles are empty; roles stay as they are, but for the senders of layouts that name them so; turns that tie are ordered by role, then text; repeated rows are turns of their own;
records without a mapping give one turn of the role `unknown` whose text is the record; empty tables give no rows; columns other than the named
ones are not read, whatever they are called; texts of any length are one segment each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import mapped, partitions

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that templates in use give a meaning; the template's own come first.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")


def paths(value: Any, at: str = "") -> set[str]:
    """The nested field paths of a record; the items of a list share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(fields: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


def _messages(items: str, role: str, text: str, *more: str) -> tuple[set[str], dict]:
    return {f"{items}[].{role}", f"{items}[].{text}", *more}, {"items": items, "role": role, "text": text}


def _fields(*pairs: tuple[str, str]) -> tuple[set[str], dict]:
    return {f for _, f in pairs}, {"fields": pairs}


#: Layouts as field paths with their mapping.
LAYOUTS = [
    ({"role", "text"}, {"single": ("role", "text")}),
    ({"role", "content"}, {"single": ("role", "content")}),
    _messages("messages", "role", "content"),
    _messages("messages", "role", "text"),
    _messages("conversations", "from", "value"),
    _messages("conversations", "from", "value", "id"),
    _fields(("user", "prompt"), ("assistant", "response")),
    _fields(("user", "prompt"), ("assistant", "completion")),
    _fields(("user", "question"), ("assistant", "answer")),
    _fields(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fields(("user", "instruction"), ("assistant", "output")),
    _fields(("system", "instruction"), ("user", "input"), ("assistant", "output")),
]
#: Names that layouts with senders (`from`) give to roles; layouts with a `role` say it themselves, and it stays as it is.
SENDERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = {fingerprint(f): m for f, m in LAYOUTS}


def turns_of(record: str | None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a JSON record."""
    if record is None:
        return []
    try:
        value = json.loads(record)
    except ValueError:
        value = None
    how = MAPPINGS.get(fingerprint(paths(value)), {}) if isinstance(value, dict) else {}
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if "single" in how:
        return [(text(value[how["single"][0]]), text(value[how["single"][1]]))]
    if "items" in how:
        names = SENDERS if how["role"] == "from" else {}
        return [(names.get(text(x.get(how["role"])), text(x.get(how["role"]))), text(x.get(how["text"]))) for x in value[how["items"]]]
    if "fields" in how:
        return [(r, text(value[f])) for r, f in how["fields"]]
    return [("unknown", record)]


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text) from (conv_id, turn, record); part numbers the turns of a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part, roles, texts = [], [], [], []
            for i, record in enumerate(batch.column("record").to_pylist()):
                for k, (role, text) in enumerate(turns_of(record)):
                    row.append(i)
                    part.append(k)
                    roles.append(role)
                    texts.append(text)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(at), batch.column("turn").take(at), pa.array(part, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "turn", "part", "role", "text"])

    return mapped(records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record"), run, "conv_id long, turn long, part int, role string, text string")


def escape(column):
    out = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\-{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\([\\-])", lambda m: "\\" if m[1] == "\\" else "", text) if "\\" in text else text


def formatted(turns: DataFrame) -> DataFrame:
    """The turns with their formatted `segment`."""
    empty = F.lit("")
    role, text = (F.coalesce(F.col(c), empty) for c in ("role", "text"))
    return turns.withColumn("segment", F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END)))


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not segment.startswith(TURN) or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    role, text = segment[len(TURN) : -len(END)].split(TEXT)
    return unescape(role), unescape(text)


def read_back(segments: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of each conversation, read from its segments alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, False
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row() -> pa.RecordBatch:
            n, loss, chars = counts
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((now, n, every.hexdigest(), loss, own.hexdigest(), chars), kinds)], names)

        for batch in batches:
            done = []
            for conv, segment in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist()):
                if not seen or conv != now:
                    if seen:
                        done.append(row())
                    now, seen, counts, every, own = conv, True, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                role, text = read_segment(segment)
                every.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
                counts[2] += len(segment)
                if role == loss_role:
                    counts[1] += len(text)
                    own.update(text.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if seen:
            yield row()

    order = ["conv_id", "turn", "role", "text", "part"]
    streams = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions(*order)
    return mapped(streams.select("conv_id", "segment"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows of one turn each as records (conv_id, turn, record)."""
    return conversations.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
