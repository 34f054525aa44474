"""Records of many layouts as canonical turns, and turns as marked text.

A record is a JSON object. The set of its nested field paths (`messages[].role`)
is hashed; the hash selects a declarative mapping, which says where turns, roles
and texts lie. A hash is resolved once in each worker: the mapping whose fields
are all there and which uses the most of them is taken, so that further fields
don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .turns import in_order, joined, segments, tuples


class Mapping(NamedTuple):
    """Where a layout keeps its turns.

    each: the field of the list of turns; empty if the record's own fields are
    turns. role, text: a turn's fields, or places if turns are lists. names: roles
    under other names. fixed: (role, fields) of turns in order, fields joined by an
    empty line; of these at least one must be there (see required).
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    names: dict[str, str] = {}
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    required: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.required:
            return set(self.required)
        below = f"{self.each}[]." if self.each else ""
        return {below + self.role, below + self.text}


OTHER_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts of public chat and instruction data.
MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("conversations", "conversations", "from", "value", OTHER_NAMES),
    Mapping("dialog", "dialog", "speaker", "utterance", OTHER_NAMES),
    Mapping("message", "", "role", "content"),
    Mapping("said", "", "from", "value", OTHER_NAMES),
    Mapping("row", "", "role", "text"),
    Mapping("prompt and answer", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), required=("prompt", "completion")),
    Mapping("prompt and response", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), required=("prompt", "response")),
    Mapping("instruction", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), required=("instruction", "output")),
    Mapping("question", fixed=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), required=("question", "answer")),
    Mapping("prompt alone", fixed=(("user", ("prompt",)),), required=("prompt",)),
    Mapping("completion alone", fixed=(("assistant", ("completion",)),), required=("completion",)),
    Mapping("system alone", fixed=(("system", ("system",)),), required=("system",)),
    Mapping("instruction alone", fixed=(("user", ("instruction", "input")),), required=("instruction",)),
    Mapping("output alone", fixed=(("assistant", ("output",)),), required=("output",)),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """The paths of all fields below a value; lists are `[]`, whatever their length."""
    found: set[str] = set()
    waiting = [(value, at)]
    while waiting:
        x, path = waiting.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                here = f"{path}.{k}" if path else k
                found.add(here)
                waiting.append((v, here))
        elif isinstance(x, list):
            found.add(f"{path}[]")
            waiting.extend((v, f"{path}[]") for v in x)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def select(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping of these field paths: all its required ones are there, most of all are used; the first such one."""
    fit = [m for m in mappings if m.paths() <= paths]
    return max(fit, key=lambda m: len(m.paths() | (paths & {f for _, x in m.fixed for f in x})), default=None)


def text_of(value: object) -> str:
    """A text as it is, null as empty, parts (`[{"type": "text", "text": ...}]`) one after the other, other values as JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
        return "".join(x if isinstance(x, str) else x["text"] for x in value)
    return json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, how: Mapping) -> list[tuple[str, str]]:
    """The record's turns (role, text) by a mapping."""
    if how.fixed:
        made = []
        for role, fields in how.fixed:
            there = [text_of(record[f]) for f in fields if f in record]
            if there:
                made.append((role, "\n\n".join(x for x in there if x)))
        return made
    rows = record[how.each] if how.each else [record]
    roles = ((text_of(x.get(how.role)), text_of(x.get(how.text))) for x in rows if isinstance(x, dict))
    return [(how.names.get(r, r), t) for r, t in roles]


def canonical_turns(records: DataFrame, keys: list[str], record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The records' turns: keys, nth (from 0 in a record), role, text, layout, schema_hash.

    A record whose layout no mapping fits (so one whose list of turns is empty),
    that isn't an object or that is null gives one row with null role, text and
    layout. Null ids stay. Extra fields and columns are ignored. Rows
    are handled one by one, without a shuffle.
    """
    source = records.select(*keys, F.col(record_col).alias("__record"))
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Mapping | None] = {}
        for batch in batches:
            places, rows = [], []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                paths = field_paths(record) if isinstance(record, dict) else set()
                code = fingerprint(paths)
                if code not in known:
                    known[code] = select(paths, mappings)
                how = known[code]
                made = [(n, r, t, how.name, code) for n, (r, t) in enumerate(turns_of(record, how))] if how else [(0, None, None, None, code)]
                rows += made
                places += [i] * len(made)
            front = [x.take(pa.array(places, pa.int64())) for x in batch.columns[: len(keys)]]
            columns = list(zip(*rows)) or [[]] * 5
            back = [pa.array(columns[0], pa.int32()), *(pa.array(x, pa.string()) for x in columns[1:])]
            yield pa.RecordBatch.from_arrays([*front, *back], names=[*keys, "nth", "role", "text", "layout", "schema_hash"])

    return source.mapInArrow(run, f"{kinds}, nth int, role string, text string, layout string, schema_hash string")


#: The template: a turn is the opening, its role, the divider, its text and the end. Inside roles and texts a backslash stands before what could be taken for these.
OPENING, DIVIDER, END = "### ", ":\n", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:\n]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def _escaped(text: Column, *marks: str) -> Column:
    for mark in ("\\", *marks):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def format_turns(turns: DataFrame, role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """The rows with their formatted turn and, where the role is to be learned, its text's span in it (loss_start, loss_stop: code points, end exclusive; null elsewhere).

    A conversation's text is its turns' one after the other. Null roles and texts
    are empty. Control strings inside are escaped; read_back undoes it.
    """
    own, said = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    head = F.concat(F.lit(OPENING), _escaped(own, ":", "\n"), F.lit(DIVIDER))
    body = _escaped(said, "###", "</turn>")
    start = F.when(own == learn, F.char_length(head))
    made = turns.withColumns({"formatted": F.concat(head, body, F.lit(END)), "loss_start": start})
    return made.withColumn("loss_stop", F.when(F.col("loss_start").isNotNull(), F.char_length("formatted") - len(END)))


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """A formatted conversation's turns (role, text). Text that isn't made of turns is an error."""
    found, end = [], 0
    while end < len(formatted):
        m = TURN.match(formatted, end)
        if m is None:
            raise ValueError(f"no turn at {end}")
        found.append((unescaped(m[1]), unescaped(m[2])))
        end = m.end()
    return found


#: A segment of a conversation has so many turns and, but for its last turn, characters.
SEGMENT_ROWS, SEGMENT_CHARS = 512, 1_000_000


def read_conversations(formatted: DataFrame, scratch: Scratch) -> DataFrame:
    """Each conversation read back from its formatted turns (conv_id, turn, role, text, formatted, loss_start, loss_stop).

    Returns conv_id, n_turns, turns_sha256 (role, line end, text, line end of each
    turn), loss_chars, loss_sha256 (the unescaped text under the spans),
    formatted_chars. Null ids are one conversation. Turns are in the order of
    turn (nulls first), role and text.
    """
    source = in_order(formatted).select("conv_id", "formatted", "loss_start", "loss_stop")
    kind = source.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "at", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, id_type = TaskContext.get().partitionId(), 0, pa.int64()

        def rows() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield from tuples(iter([batch]))

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=names)

        made, size = [], 0
        for key, held, whole in segments(rows(), SEGMENT_ROWS, SEGMENT_CHARS, lambda r: len(r[1])):
            text = "".join(r[1] for r in held)
            turns = "".join(f"{role}\n{said}\n" for role, said in read_back(text)).encode()
            spans, begin = [], 0
            for _, piece, lo, hi in held:
                if lo is not None:
                    spans.append(unescaped(text[begin + lo : begin + hi]))
                begin += len(piece)
            loss = "".join(spans)
            counts = (len(held), len(loss), len(text))
            loss = loss.encode()
            if whole:
                turns, loss = (hashlib.sha256(x).digest() for x in (turns, loss))
            made.append((key, part, None if whole else at, *counts, turns, loss))
            at += not whole
            size += len(turns) + len(loss) + 64
            if size >= SEGMENT_CHARS:
                yield batch_of(made)
                made, size = [], 0
        if made:
            yield batch_of(made)

    read = scratch.save(source.mapInArrow(run, f"conv_id {kind}, part bigint, at bigint, n_turns bigint, loss_chars bigint, formatted_chars bigint, turns binary, loss binary"), "read_back")
    sums = ["n_turns", "loss_chars", "formatted_chars"]
    done = read.filter("at is null").select("conv_id", *(F.lower(F.hex(x)).alias(x) for x in ("turns", "loss")), *sums)
    rest = joined(read.filter("at is not null"), "conv_id", ["part", "at"], ["turns", "loss"], sums)
    return done.unionByName(rest).select("conv_id", "n_turns", F.col("turns").alias("turns_sha256"), "loss_chars", F.col("loss").alias("loss_sha256"), "formatted_chars")


def as_records(turns: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) as records (conv_id, turn, record) in the layouts of different data sets, by the crc32 of the id.

    Layouts that know only three roles keep other roles' rows as messages.
    """
    role, text = (F.coalesce(x, F.lit("")) for x in ("role", "text"))
    kind = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5
    one = F.struct(role.alias("role"), text.alias("content"))
    known = role.isin("system", "user", "assistant")
    own = lambda user, answer: (
        F.when(role == "user", F.to_json(F.struct(text.alias(user)))).when(role == "assistant", F.to_json(F.struct(text.alias(answer)))).otherwise(F.to_json(F.struct(text.alias("system"))))
    )
    names = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    record = (
        F.when((kind == 1) & known, F.to_json(F.struct(F.array(F.struct(names.alias("from"), text.alias("value"))).alias("conversations"))))
        .when((kind == 2) & known, own("prompt", "completion"))
        .when((kind == 3) & known, own("instruction", "output"))
        .when(kind == 4, F.to_json(F.struct(role.alias("role"), text.alias("text"))))
        .otherwise(F.to_json(F.struct(F.array(one).alias("messages"))))
    )
    return turns.select("conv_id", "turn", record.alias("record"))
