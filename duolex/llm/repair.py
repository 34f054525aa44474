"""The cheapest repair of a conversation's structure, as a scan with min-plus matrices.

A repaired conversation is empty or an optional system turn followed by pairs of
a user's and an assistant's turn. Four states say what came before: nothing, the
system turn, a user's turn, an assistant's turn. A turn is a 4x4 matrix whose
element (i, j) is the cheapest way, as (cost, audit), from state i to state j by
an edit of this turn and any insertions after it (the insert closure). Products
of such matrices are associative: of two ways with one cost neither audit begins
with the other, because insertions aren't free, so the order of (cost, audit) is
kept by joining.

Conversations inside a partition are scanned there. Of others, blocks of turns
are multiplied in their tasks and then in a tree over all partitions; on the way
back down each block learns between which states it lies.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .turns import in_order, joined, segments, tuples

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What an edit costs: a new role, a deletion, an insertion, and a turn that is cut off and stays.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: (role's initial, state before, state after) of each turn that may follow.
STEPS = (("s", NOTHING, SYSTEM), ("u", NOTHING, USER), ("u", SYSTEM, USER), ("u", ASSISTANT, USER), ("a", USER, ASSISTANT))
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Turns and characters of a block of a long conversation, and blocks that are multiplied at once in the tree.
BLOCK_ROWS, BLOCK_CHARS, FAN = 256, 1_000_000, 32

Matrix = list[dict[int, tuple[int, str]]]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [{} for _ in range(4)]
    for i, row in enumerate(a):
        for k, (cost, audit) in row.items():
            for j, (more, next_audit) in b[k].items():
                found = (cost + more, audit + next_audit)
                if j not in out[i] or found < out[i][j]:
                    out[i][j] = found
    return out


IDENTITY: Matrix = [{i: (0, "")} for i in range(4)]


def _closure() -> Matrix:
    """The cheapest insertions from each state to each; more than four never are cheaper."""
    once: Matrix = [dict(x) for x in IDENTITY]
    for initial, i, j in STEPS:
        if initial != "s":
            once[i][j] = (INSERT, "I")
    return reduce(product, [once] * 4)


CLOSURE = _closure()


def _turn(initial: str, must_go: bool, cut_off: bool) -> Matrix:
    own: Matrix = [{i: (DELETE, "D")} for i in range(4)]
    if not must_go:
        for step, i, j in STEPS:
            ways = [(CUT_OFF * cut_off, "K")] if step == initial else []
            ways += [(REROLE + CUT_OFF * cut_off, "R")] if step != "s" else []
            if ways:
                own[i][j] = min([*ways, *([own[i][j]] if j in own[i] else [])])
    return product(own, CLOSURE)


#: The matrices of all kinds of turns: (initial, or empty for any other; to be deleted; cut off).
TURNS = {(r, gone, cut): _turn(r, gone, cut) for r in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True)}


def fault(text: str, seen_before: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated, or none (empty)."""
    end = text.rstrip(SPACE)
    if not end:
        return "blank"
    return "duplicate" if seen_before else "truncated" if end[-1] not in ".!?" else ""


def matrix_of(role: str, found: str) -> Matrix:
    return TURNS[role[:1] if role[:1] in "sua" else "", found in ("blank", "duplicate"), found == "truncated"]


class Span:
    """What is known of neighbouring turns; spans are joined in order, associatively."""

    __slots__ = ("matrix", "faults", "illegal", "first", "last", "low", "high", "turns")

    def __init__(self, matrix: Matrix = IDENTITY, faults: tuple[int, int, int] = (0, 0, 0), illegal: int = 0, first: str | None = None, last: str | None = None, low: int | None = None, high: int | None = None, turns: int = 0):
        self.matrix, self.faults, self.illegal, self.first, self.last, self.low, self.high, self.turns = matrix, faults, illegal, first, last, low, high, turns

    def dump(self) -> str:
        return json.dumps([[list(x.items()) for x in self.matrix], *(getattr(self, k) for k in self.__slots__[1:])])

    @classmethod
    def load(cls, text: str) -> Span:
        matrix, faults, *rest = json.loads(text)
        return cls([{j: (cost, audit) for j, (cost, audit) in row} for row in matrix], tuple(faults), *rest)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def tree(found: list[Matrix]) -> Matrix:
    """The product of matrices, neighbours first."""
    while len(found) > 1:
        found = [product(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0] if found else IDENTITY


def joined_spans(spans: list[Span]) -> Span:
    out = Span(tree([x.matrix for x in spans]))
    for x in spans:
        out.faults = tuple(a + b for a, b in zip(out.faults, x.faults))
        out.illegal += x.illegal + (out.last is not None and x.first is not None and out.last + x.first not in LEGAL)
        out.turns += x.turns - (x.low is not None and out.high == x.low)
        out.first = x.first if out.first is None else out.first
        out.last = out.last if x.last is None else x.last
        out.low = x.low if out.low is None else out.low
        out.high = out.high if x.high is None else x.high
    return out


def span_of(rows: list[tuple], found: list[str]) -> Span:
    """The span of rows (turn, role, text) with their faults."""
    kinds = ("blank", "duplicate", "truncated")
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return Span(
        tree([matrix_of(role, x) for (_, role, _), x in zip(rows, found)]),
        tuple(sum(x == k for x in found) for k in kinds),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        initials[0] if rows else None,
        initials[-1] if rows else None,
        turns[0] if turns else None,
        turns[-1] if turns else None,
        len(set(turns)),
    )


def cheapest(matrix: Matrix) -> tuple[int, str, int, int]:
    """(cost, audit, state before the first turn, last state) of the best repair; turns may be inserted in front."""
    ways = [(cost + more, front + audit, i, j) for i, (cost, front) in CLOSURE[NOTHING].items() for j, (more, audit) in matrix[i].items() if j in (NOTHING, ASSISTANT)]
    return min(ways)


def repaired(rows: list[tuple], audit: str, state: int) -> list[str]:
    """The lines `role:text` that an audit's edits make of rows (turn, role, text), from a state on."""
    lines, left = [], iter(rows)

    def after(role: str) -> int:
        return next(j for step, i, j in STEPS if i == state and step == role)

    for edit in audit:
        if edit == "I":
            state = USER if state != USER else ASSISTANT
            lines.append(f"{ROLES[state]}:")
            continue
        _, role, text = next(left)
        if edit == "R":
            state = USER if state != USER else ASSISTANT
            lines.append(f"{ROLES[state]}:{text}")
        elif edit == "K":
            state = after(role[:1])
            lines.append(f"{role}:{text}")
    return lines


FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def summary(span: Span) -> tuple:
    cost, audit, _, _ = cheapest(span.matrix)
    return (span.gaps, *span.faults, span.illegal, cost, audit)


def _key(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def repair(turns: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Each conversation's faults and cheapest repair, for rows (conv_id, turn, role, text, copy, live).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256: a row for each id, null included. Rows that aren't live only
    name their conversation, which may have no others: zeros, an empty audit and
    the empty text's digest. Rows are in the order of turn (nulls first), role,
    text and copy, so ties and repeated rows have one order. Roles and texts must
    not be null. A conversation that fits a block and lies inside a partition is
    finished in one pass; of others no task holds more than a block of turns or
    `fan` products. An audit is as long as its conversation, and a digest is
    sequential, so these two are one value for each conversation.
    """
    source = in_order(turns, "copy").select("conv_id", "turn", "role", "text", "live")
    kind = source.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "at", *(x.split(" ")[0] for x in FIELDS.split(", ")), "rows", "keys"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, id_type = TaskContext.get().partitionId(), 0, pa.int64()

        def rows() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield from tuples(iter([batch]))

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 8, *[pa.string()] * 3, pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=names)

        made, size = [], 0
        for key, held, whole in segments(rows(), block_rows, BLOCK_CHARS, lambda r: len(r[3])):
            live = [r[1:4] for r in held if r[4]]
            if whole:
                seen: set[tuple[str, str]] = set()
                found = []
                for _, role, text in live:
                    found.append(fault(text, (role, text) in seen))
                    seen.add((role, text))
                span = span_of(live, found)
                _, audit, front, _ = cheapest(span.matrix)
                digest = hashlib.sha256("\n".join(repaired(live, audit, NOTHING)).encode()).hexdigest()
                made.append((key, part, None, *summary(span), digest, None, None))
            else:
                made.append((key, part, at, *[0] * 6, None, None, json.dumps(live), [_key(r, t) for _, r, t in live]))
                at += 1
            size += 64 + sum(len(r[3]) for r in held) * (not whole)
            if size >= BLOCK_CHARS:
                yield batch_of(made)
                made, size = [], 0
        if made:
            yield batch_of(made)

    scanned = scratch.save(source.mapInArrow(scan, f"conv_id {kind}, part bigint, at bigint, {FIELDS}, rows string, keys array<binary>"), "scanned")
    done = scanned.filter("at is null").drop("part", "at", "rows", "keys")
    return done.unionByName(_long(scanned.filter("at is not null").select("conv_id", "part", "at", "rows", "keys"), kind, scratch, fan))


def _long(blocks: DataFrame, kind: str, scratch: Scratch, fan: int) -> DataFrame:
    """The repair of conversations in several blocks, by a tree of products."""
    place = F.struct("part", "at")
    # what an earlier block has seen: one row for each block and different turn, so that a turn repeated all over is no hot key
    seen = scratch.save(blocks.select("conv_id", place.alias("place"), F.explode(F.array_distinct("keys")).alias("key")), "seen")
    first = seen.groupBy("conv_id", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("f_conv_id"), F.col("key").alias("f_key"), "first")
    later = seen.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("key") == F.col("f_key")) & (F.col("place") > F.col("first")))
    again = later.groupBy(F.col("conv_id").alias("a_conv_id"), F.col("place").alias("a_place")).agg(F.collect_list("key").alias("again"))
    known = blocks.join(again, F.col("conv_id").eqNullSafe(F.col("a_conv_id")) & (place == F.col("a_place")), "left").select("conv_id", "part", "at", "rows", "keys", "again")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rows, keys, again in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                rows, before, found = json.loads(rows), set(again or ()), []
                for (_, _, text), key in zip(rows, keys):
                    found.append(fault(text, key in before))
                    before.add(key)
                made.append(span_of(rows, found).dump())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.string())], names=["conv_id", "part", "at", "rows", "span"])

    levels = [scratch.save(known.mapInArrow(spans, f"conv_id {kind}, part bigint, at bigint, rows string, span string"), "level0")]
    up: list[str] = []  # which of the two numbers of a place each level divides

    def multiply(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["part", "at", "span"]).to_pylist(), key=lambda r: (r["part"], r["at"]))
        total = joined_spans([Span.load(r["span"]) for r in rows])
        return table.slice(0, 1).select(["conv_id", "up_part", "up_at"]).rename_columns(["conv_id", "part", "at"]).append_column("span", pa.array([total.dump()], pa.string()))

    def above(level: DataFrame, which: str) -> DataFrame:
        part, at = (F.col("part"), F.floor(F.col("at") / fan)) if which == "at" else (F.floor(F.col("part") / fan), F.lit(0))
        return level.withColumns({"up_part": part.cast("long"), "up_at": at.cast("long")})

    most = levels[0].agg(F.max("part").alias("part"), F.max("at").alias("at")).first()
    part, at = most["part"] or 0, most["at"] or 0
    while part or at:
        which = "at" if at else "part"
        part, at = (part, at // fan) if at else (part // fan, 0)
        made = above(levels[-1], which).groupBy("conv_id", "up_part", "up_at").applyInArrow(multiply, f"conv_id {kind}, part bigint, at bigint, span string")
        up.append(which)
        levels.append(scratch.save(made, f"level{len(levels)}"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                span = Span.load(text)
                _, audit, begin, end = cheapest(span.matrix)
                front = CLOSURE[NOTHING][begin][1]
                made.append((*summary(span), "\n".join(repaired([], front, NOTHING)).encode() if front else None, begin, end))
            columns = list(zip(*made)) or [[]] * 10
            kinds = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.int64(), pa.int64()]
            fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "payload", "begin", "end"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=["conv_id", *fields])

    top_fields = ", ".join(FIELDS.split(", ")[:-1])
    top = scratch.save(levels[-1].select("conv_id", "span").mapInArrow(decide, f"conv_id {kind}, {top_fields}, payload binary, begin bigint, end bigint"), "decided")
    ends = top.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("at"), "begin", "end")

    def descend(table: pa.Table) -> pa.Table:
        """The states around each of a product's factors on the best way between its own."""
        table = table.sort_by([("part", "ascending"), ("at", "ascending")])
        begin, end = table["begin"][0].as_py(), table["end"][0].as_py()
        ways = {begin: (0, "", (begin,))}
        for text in table["span"].to_pylist():
            after: dict[int, tuple] = {}
            for i, (cost, audit, path) in ways.items():
                for j, (more, next_audit) in Span.load(text).matrix[i].items():
                    way = (cost + more, audit + next_audit, (*path, j))
                    if j not in after or way < after[j]:
                        after[j] = way
            ways = after
        path = ways[end][2]
        return table.select(["conv_id", "part", "at"]).append_column("begin", pa.array(path[:-1], pa.int64())).append_column("end", pa.array(path[1:], pa.int64()))

    for k in range(len(up) - 1, -1, -1):
        child = above(levels[k].drop("rows"), up[k]).alias("c")
        parent = ends.select(*(F.col(x).alias(f"p_{x}") for x in ("conv_id", "part", "at")), "begin", "end")
        met = child.join(parent, F.col("c.conv_id").eqNullSafe(F.col("p_conv_id")) & (F.col("up_part") == F.col("p_part")) & (F.col("up_at") == F.col("p_at"))).drop("p_conv_id", "p_part", "p_at")
        ends = scratch.save(met.groupBy("conv_id", "up_part", "up_at").applyInArrow(descend, f"conv_id {kind}, part bigint, at bigint, begin bigint, end bigint"), f"ends{k}")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rows, text, begin, end in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
                out = repaired(json.loads(rows), Span.load(text).matrix[begin][end][1], begin)
                made.append("\n".join(out).encode() if out else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["conv_id", "part", "at", "payload"])

    e = ends.select(*(F.col(x).alias(f"e_{x}") for x in ("conv_id", "part", "at")), "begin", "end")
    met = levels[0].join(e, F.col("conv_id").eqNullSafe(F.col("e_conv_id")) & (F.col("part") == F.col("e_part")) & (F.col("at") == F.col("e_at"))).drop("e_conv_id", "e_part", "e_at")
    pieces = met.select("conv_id", "part", "at", "rows", "span", "begin", "end").mapInArrow(lines, f"conv_id {kind}, part bigint, at bigint, payload binary")
    fronts = top.select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("at"), "payload")
    digests = joined(pieces.unionByName(fronts), "conv_id", ["part", "at"], ["payload"], separator=b"\n").select(F.col("conv_id").alias("d_conv_id"), F.col("payload").alias("repaired_sha256"))
    fields = [x.split(" ")[0] for x in FIELDS.split(", ")]
    return top.drop("payload").join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv_id"))).select("conv_id", *fields)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in, by crc32 of `conv_id:turn` modulo 20: 0 drops the row (it isn't live), 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"), (F.col("lot") != 0).alias("live"))
