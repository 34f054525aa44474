"""What the operators over conversations share: order, segments, digests of long sequences.

A conversation may hold any share of all rows, so none is gathered. Rows are
dealt by ranges of (conversation, turn), so a long conversation lies in several
neighbouring partitions; each partition is read once, in order. Conversations
that lie wholly inside a partition are finished there. The first and the last
one of a partition, and long ones, leave it in bounded segments, which are put
together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Scratch

#: Keys with more rows than this part of all rows are at most so many, and are broadcast.
HOT_KEYS = 100_000
#: A turn's first characters, which ranges of equal turns are cut by.
RANGE_CHARS = 32


def in_order(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (conv_id, turn, role, text and others) dealt by ranges and sorted in each partition: by conversation, turn, role, text and `more`, nulls first."""
    keys = [F.col(x).asc_nulls_first() for x in ("conv_id", "turn", "role")]
    dealt = rows.repartitionByRange(*keys, F.substring("text", 1, RANGE_CHARS).asc_nulls_first())
    return dealt.sortWithinPartitions(*keys, F.col("text").asc_nulls_first(), *more)


def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows, a slice at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*(x.to_pylist() for x in batch.slice(lo, SLICE_ROWS).columns))


def segments(rows: Iterator[tuple], most_rows: int, most_chars: int, chars: Callable[[tuple], int]) -> Iterator[tuple[object, list[tuple], bool]]:
    """(conversation, its next rows, whether these are all its rows) of a partition's rows, the conversation in front. A segment has at most most_rows rows and, but for its last one, under most_chars characters."""
    held: list[tuple] = []
    size, whole, key = 0, False, None
    for row in rows:
        if held and row[0] != key:
            yield key, held, whole
            held, size, whole = [], 0, True
        elif held and (len(held) >= most_rows or size >= most_chars):
            yield key, held, False
            held, size, whole = [], 0, False
        key = row[0]
        held.append(row)
        size += chars(row)
    if held:
        yield key, held, False


def joined(pieces: DataFrame, key: str, order: list[str], payloads: list[str], sums: list[str] = [], separator: bytes = b"") -> DataFrame:  # noqa: B006
    """For each key the SHA-256 of its payloads in order, null ones left out, with the separator between them, and the sums of other columns.

    Returns key, each payload's digest (lowercase hex) under its name, each sum.
    A digest is sequential by nature: a key's pieces are read by one task, one
    after the other, and only the state is kept. Callers send few large pieces.
    """
    kind = pieces.schema[key].dataType.simpleString()
    source = pieces.select(key, *payloads, *sums, *order).repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), *order).drop(*order)
    schema = pa.schema([pa.field(x, pa.string()) for x in payloads] + [pa.field(x, pa.int64()) for x in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            arrays = [pa.array([k for k, _, _ in done], id_type[0])]
            arrays += [pa.array([d[i] for _, d, _ in done], x.type) for i, x in enumerate(list(schema)[: len(payloads)])]
            arrays += [pa.array([s[i] for _, _, s in done], pa.int64()) for i in range(len(sums))]
            return pa.RecordBatch.from_arrays(arrays, names=[key, *schema.names])

        def close() -> None:
            done.append((now, [h.hexdigest() for h in hashes], totals))

        now, hashes, begun, totals, done, id_type = None, None, [], [], [], [None]
        for batch in batches:
            id_type[0] = batch.schema.field(0).type
            for row in tuples(iter([batch])):
                if hashes is None or row[0] != now:
                    if hashes is not None:
                        close()
                    now, hashes, begun, totals = row[0], [hashlib.sha256() for _ in payloads], [False] * len(payloads), [0] * len(sums)
                for i, value in enumerate(row[1 : 1 + len(payloads)]):
                    if value is not None:
                        if begun[i] and separator:
                            hashes[i].update(separator)
                        begun[i] = True
                        hashes[i].update(value)
                for i, value in enumerate(row[1 + len(payloads) :]):
                    totals[i] += value
            if done:
                yield closed()
                done = []
        if hashes is not None:
            close()
            yield closed()

    return source.mapInArrow(run, f"`{key}` {kind}, " + ", ".join([f"`{x}` string" for x in payloads] + [f"`{x}` bigint" for x in sums]))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key; how: inner or left.

    Right's rows where `hot` holds are those of keys with many rows on the left.
    The caller bounds their number (HOT_KEYS); they are broadcast, so that no task
    gets a key's many rows. left is read twice: give a written table.
    """
    many = right.filter(hot)
    straight = left.join(F.broadcast(many), key)
    rest = left.join(F.broadcast(many.select(key)), key, "left_anti").join(right.filter(~hot), key, how)
    return straight.unionByName(rest)


def numbered(conversations: DataFrame, scratch: Scratch, extra: dict[str, Column]) -> DataFrame:
    """Each row's place (`at`, from 0) in its conversation, and the extra columns made of role and text; a written table.

    Null ids are left out; null roles and texts are empty. Rows of a turn are in
    the order of role and text. Places are counted in each range; what the
    partitions before hold of a range's first conversation is added, a few rows
    for each partition.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", *(F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")))
    source = in_order(rows).select("conv_id", *(v.alias(k) for k, v in extra.items()))
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in source.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, opened = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0)
            fresh = np.empty(n, bool)
            fresh[1:] = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = ids[0].as_py() != last
            place = np.arange(n)
            begins = np.maximum.accumulate(np.where(fresh, place, -1))
            at = np.where(begins < 0, place + count, place - begins)
            first = opened + np.cumsum(fresh) == 1
            opened += int(fresh.sum())
            last, count = ids[n - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(n, part)), pa.array(first)], names=[*batch.schema.names, "__at", "__part", "__first"])

    local = scratch.save(source.mapInArrow(run, f"{fields}, __at bigint, __part bigint, __first boolean"), "local_places")
    heads = local.filter("__first").select("conv_id").distinct()
    held = local.join(F.broadcast(heads), "conv_id", "left_semi").groupBy("conv_id", "__part").count()
    earlier = held.alias("a").join(held.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.__part") > F.col("b.__part")))
    before = scratch.save(earlier.groupBy("a.conv_id", "a.__part").agg(F.sum("b.count").alias("__before")), "places_before")
    placed = local.join(F.broadcast(before), ["conv_id", "__part"], "left")
    return scratch.save(placed.select("conv_id", (F.col("__at") + F.coalesce("__before", F.lit(0))).alias("at"), *extra), "places")
