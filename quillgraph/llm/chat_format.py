"""Chat formatting with schema fingerprints.

Records come in many layouts: prompt and completion, instruction with input and
output, lists of messages under different names, single turns.  The set of nested
field paths of a record, hashed, is its schema fingerprint; a table from
fingerprints to declarative mappings (which path holds the role, which the text)
turns the record into canonical turns.  Nothing is guessed from values; records
whose fingerprint no mapping has are returned with role null and their JSON as
text, so that nothing is lost.

Turns are written by a template that marks them and escapes its own control
strings inside texts reversibly, with the spans of assistant texts as loss mask.
Conversations stream through sorted partitions and are cut into parts of bounded
size, so that a conversation of any length needs bounded memory.

Cases: null text is empty, null role is an empty role; rows of a conversation
that tie in turn are ordered by role and text, and repeated rows stay; null
conv_id is a conversation of its own; an empty table gives just what the caller
adds; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, shared_folder
from .textkernel import pick

# -- schema fingerprints -------------------------------------------------------


def field_paths(value: Any, at: str = "") -> set[str]:
    """Paths of all leaves; list items share the path with []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    turns: path of the list of turns, or None when `fields` names them one by one;
    role, text: paths within an item of the list;
    fields: (role, path of its text) in order; an empty text of an `optional` path is no turn;
    constant: path of the role where one record is one turn.
    """

    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

    def canonical(self, record: dict) -> list[tuple[str, str]]:
        if self.fields:
            got = [(role, _get(record, path), path) for role, path in self.fields]
            return [(role, text) for role, text, path in got if text or path not in self.optional]
        items = [record] if self.turns is None else record.get(self.turns) or []
        rename = dict(self.roles)
        return [(rename.get(r := _get(x, self.role), r), _get(x, self.text)) for x in items]


def _get(record: Any, path: str) -> str:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return "" if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


MAPPINGS = (
    Mapping(paths=("role", "text"), role="role", text="text", roles=()),
    Mapping(paths=("messages[].role", "messages[].content"), turns="messages"),
    Mapping(paths=("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping(paths=("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(paths=("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping(paths=("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(paths=("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping(paths=("system", "instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system",)),
    Mapping(paths=("data.question", "data.answer"), fields=(("user", "data.question"), ("assistant", "data.answer"))),
)


class Registry:
    """Mappings by fingerprint; the fingerprint of each set of keys is worked out once."""

    def __init__(self, mappings: Iterable[Mapping] = MAPPINGS):
        self.by = {fingerprint(m.paths): m for m in mappings}

    def turns(self, raw: str) -> list[tuple[str | None, str]]:
        try:
            record = json.loads(raw)
        except ValueError:
            return [(None, raw)]
        found = self.by.get(fingerprint(field_paths(record)))
        return [(None, raw)] if found is None else found.canonical(record)


def canonical_turns(records: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """Per turn of each record (columns conv_id, turn, record as JSON): conv_id, turn, part (place within the record), role, text."""
    chosen = tuple(mappings)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(chosen)
        for batch in batches:
            rows = [(c, t, k, role, text) for c, t, raw in zip(*(x.to_pylist() for x in batch.columns)) for k, (role, text) in enumerate(registry.turns(raw or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn", "part", "role", "text"])

    return pick(records, "conv_id", "turn", "record").mapInArrow(convert, "conv_id long, turn long, part long, role string, text string")


# -- template ------------------------------------------------------------------

#: Control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_UNESCAPE = re.compile(r"\\\\|([<\[])\\(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_TURN = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|<<SYS>>(.*?)<</SYS>>|<<ROLE>>(.*?)<</ROLE>>(.*?)</s>", re.S)
#: Characters after which a conversation's output goes on in another part.
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """Doubles backslashes and breaks control strings with one after the first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or "\\", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where the loss mask begins and ends in it."""
    body = escape(text)
    if role in _MARKS:
        a, b = _MARKS[role]
        return f"{a}{body}{b}", len(a), len(a) + len(body) if role == "assistant" else len(a)
    return f"<<ROLE>>{escape(role)}<</ROLE>>{body}</s>", 0, 0


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that was written."""
    for m in _TURN.finditer(text):
        if m[4] is not None:
            yield unescape(m[4]), unescape(m[5])
        else:
            k = 1 if m[1] is not None else 2 if m[2] is not None else 3
            yield ("user", "assistant", "system")[k - 1], unescape(m[k])


FORMATTED = "conv_id long, part long, text string, loss array<struct<start:long,stop:long>>"


def _sorted_by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def write_formatted(turns: DataFrame, folder: str) -> None:
    """Writes conversations (columns conv_id, turn, part, role, text) as parts of formatted text with loss spans."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = ()
        part, size = 0, 0
        text: list[str] = []
        loss: list[dict] = []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal part, size
            rows.append((now, part, "".join(text), list(loss)))
            text.clear(), loss.clear()
            part, size = part + 1, 0

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "part", "text", "loss"])
            rows.clear()
            return out

        for batch in batches:
            for conv, role, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now != conv and now != ():
                    flush()
                    part = 0
                now = conv
                if text and size > PART_CHARS:
                    flush()
                piece, a, b = turn_text(role or "", body or "")
                text.append(piece)
                if (role or "") == "assistant":
                    loss.append({"start": size + a, "stop": size + b})
                size += len(piece)
            if rows:
                yield batch_of()
        if now != ():
            flush()
            yield batch_of()

    order = _sorted_by_conversation(pick(turns, "conv_id", "turn", "part", "role", "text"), "turn", "part", "role", "text")
    order.mapInArrow(write, FORMATTED).write.option("compression", "zstd").parquet(folder)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation, from the written parts: turns and loss text as counts and digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = ()
        rows: list[tuple] = []
        n = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return out

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if now != conv:
                    if now != ():
                        rows.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    n = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                now = conv
                chars += len(text)
                for role, body in turns_of(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for s in spans:
                    body = unescape(text[s["start"]:s["stop"]])
                    loss.update(body.encode())
                    loss_chars += len(body)
            if rows:
                yield batch_of()
        if now != ():
            rows.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield batch_of()

    parts = _sorted_by_conversation(spark.read.schema(FORMATTED).parquet(folder), "part")
    return parts.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    folder = shared_folder(spark, "chat")
    write_formatted(canonical_turns(rows.select("conv_id", "turn", record.alias("record"))), folder)
    return read_digests(spark, folder)
