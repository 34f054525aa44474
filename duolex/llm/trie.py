"""The trie of conversations' beginnings, by radix partitioning from the first turn on.

Turns are encoded by a dictionary. A bucket is the set of conversations with a
common beginning; the first bucket holds all. In each round the buckets that are
too large for one task are dealt out by their next turns, WINDOW turns at a time,
and give the nodes on the way; what remains of a small bucket is finished by one
task with multikey quicksort, whose recursion emits the nodes. The one
conversation of a large bucket is a chain of nodes, its rows. Sums over subtrees
go back up, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .turns import HOT_KEYS, joined, numbered, spread_join, tuples

#: Turns of a bucket that one task may hold, at least; with more than HOT_KEYS times as many turns in all, so many more.
LOCAL = 1024
#: Turns that a round looks ahead.
WINDOW = 8
#: Ids in one piece of a node's list.
PIECE_IDS = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_FIELDS = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def encoded_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns (conv_id, at, the turn's digest, its words) of conversations (conv_id, turn, role, text), in the order of turn (nulls first), role and text. Null roles and texts are empty; rows with a null id belong to none and are left out, as a node is named by an id."""
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return numbered(conversations, scratch, {"digest": digest, "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def multikey_quicksort(ids: list[int], sequences: list[list[int]], words: dict[int, int], base: int, smallest: int) -> tuple[list[tuple], tuple[int, int, int]]:
    """The nodes below a bucket's own node, and its (children, leaves, saved tokens).

    ids ascending, sequences: the turns after the common beginning of base turns
    of each; smallest: the bucket's smallest id. Three-way partitioning by the
    turn at a depth: the middle part is a node, whose members go on one turn
    deeper, the other parts go on at the same depth.
    """
    nodes: list[list] = []  # conv_id, depth, parent's place, members, children, leaves, saved tokens, ends
    kids = [0]
    waiting = [(list(range(len(ids))), 0, -1)]
    while waiting:
        members, d, parent = waiting.pop()
        members = [m for m in members if len(sequences[m]) > d]
        if not members:
            continue
        pivot = sequences[members[len(members) // 2]][d]
        less, equal, more = [], [], []
        for m in members:
            turn = sequences[m][d]
            (less if turn < pivot else more if turn > pivot else equal).append(m)
        if parent < 0:
            kids[0] += 1
        else:
            nodes[parent][4] += 1
        ends = [ids[m] for m in equal if len(sequences[m]) == d + 1]
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else EMPTY
        nodes.append([ids[equal[0]], base + d + 1, parent, len(equal), 0, 0, (len(equal) - 1) * words[pivot], digest])
        waiting += [(less, d, parent), (more, d, parent), (equal, d + 1, len(nodes) - 1)]
    leaves = saved = 0
    for x in reversed(nodes):
        x[5] = x[5] or 1
        if x[2] < 0:
            leaves, saved = leaves + x[5], saved + x[6]
        else:
            up = nodes[x[2]]
            up[5] += x[5]
            up[6] += x[6]
    return [(x[0], x[1], smallest if x[2] < 0 else nodes[x[2]][0], *x[3:]) for x in nodes], (kids[0], leaves, saved)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, conv_id, at, tid, words, base, smallest) as nodes; a row with the bucket's name has its sums."""
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]

    def nodes() -> list[tuple]:
        found, (kids, leaves, saved) = multikey_quicksort(ids, sequences, words, base, smallest)
        return [(*x, None) for x in found] + [(None, None, None, None, kids, leaves, saved, None, bucket)]

    bucket, ids, sequences, words, base, smallest, made = None, [], [], {}, 0, 0, []
    for name, conv, _, tid, n, depth, least in tuples(batches):
        if name != bucket:
            if bucket is not None:
                made += nodes()
            bucket, ids, sequences, words, base, smallest = name, [], [], {}, depth, least
        if not ids or ids[-1] != conv:
            ids.append(conv)
            sequences.append([])
        sequences[-1].append(tid)
        words[tid] = n
        if len(made) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=[*NODE, "bucket"])
            made = []
    if bucket is not None:
        made += nodes()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=[*NODE, "bucket"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, conv_id) as comma-joined pieces (id, first, payload)."""
    name, held, made = None, [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), (pa.string(), pa.int64(), pa.binary()))], names=["id", "first", "payload"])

    for node, conv in tuples(batches):
        if held and (node != name or len(held) >= PIECE_IDS):
            made.append((name, held[0], ",".join(map(str, held)).encode()))
            held = []
        name = node
        held.append(conv)
        if len(made) >= 1000:
            yield flush()
            made = []
    if held:
        made.append((name, held[0], ",".join(map(str, held)).encode()))
    if made:
        yield flush()


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, local: int = LOCAL, window: int = WINDOW) -> DataFrame:
    """A row for each different beginning of the conversations, the empty one (root) included.

    turns: conv_id long, at (gapless from 0), digest, words, a written table; convs: the conv_ids,
    each once, those without turns too. Returns conv_id (smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes of
    the subtree), saved_tokens (words that storing each node once saves, over the
    subtree), ends_sha256 (of the comma-joined ids, ascending, that end here). No
    conversations give no rows. A bucket of one task has at most `local` turns
    (or a 100,000th of all); larger ones are at most as many as can be broadcast.
    A beginning of n turns that many turns share takes n / window rounds.
    """
    spark = turns.sparkSession
    counts = scratch.save(turns.groupBy("digest").agg(F.count("*").alias("n")), "dictionary")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(local, total // HOT_KEYS)
    dictionary = scratch.save(counts.withColumn("tid", F.monotonically_increasing_id()), "encoded")
    rows = scratch.save(spread_join(turns, dictionary, "digest", F.col("n") > limit).select("conv_id", "at", "tid", "words"), "turns")
    lengths = rows.groupBy("conv_id").agg((F.max("at") + 1).alias("n"))
    root = hashlib.md5(b"").hexdigest()
    members = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(root).alias("bucket"))
    members = scratch.save(members, "members")
    everyone = members.agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.sum("n").alias("turns")).first()
    if not everyone["n"]:
        return spark.createDataFrame([], NODE_FIELDS)
    buckets = spark.createDataFrame([(root, everyone["least"])], "id string, least bigint")
    ends = [members.filter("n = 0").select(F.col("bucket").alias("id"), "conv_id")]
    small, chains, rounds = [], [], []
    active, depth = members, 0
    while active is not None:
        k = len(rounds)
        near = rows.filter((F.col("at") >= depth) & (F.col("at") < depth + window)).join(active, "conv_id")
        ahead = near.groupBy("conv_id", "n", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "tid", "words"))).alias("w"))
        chain = F.aggregate("w", F.array("bucket"), lambda ids, x: F.array_append(ids, F.md5(F.concat(F.element_at(ids, -1), F.lit(":"), x.tid.cast("string")).cast("binary"))))
        paths = scratch.save(ahead.select("conv_id", "n", chain.alias("chain"), F.transform("w", lambda x: x.words).alias("words")), f"paths{k}")
        steps = paths.select("conv_id", "n", "chain", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("k"))
        steps = steps.select("conv_id", "n", "k", F.element_at("chain", F.col("k") + 1).alias("id"), F.slice("chain", 1, F.col("k")).alias("path"), F.element_at("words", F.col("k")).alias("words"))
        found = steps.groupBy("id").agg(
            F.first("path").alias("path"), F.first("k").alias("k"), F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.sum(F.col("n") - (depth + F.col("k"))).alias("remain")
        )
        nodes = scratch.save(found, f"nodes{k}")
        rounds.append((nodes, buckets, depth))
        end = F.element_at("chain", (F.col("n") - depth + 1).cast("int"))
        ends.append(paths.filter(F.col("n") <= depth + window).select(end.alias("id"), "conv_id"))
        depth += window
        tails = nodes.filter((F.col("k") == window) & (F.col("remain") > 0))
        large = scratch.save(tails.filter(F.col("remain") > limit).select("id", "least", "n_convs"), f"large{k}")
        onward = paths.filter(F.col("n") > depth).select("conv_id", "n", F.element_at("chain", window + 1).alias("id"))
        rest = onward.join(F.broadcast(large.select("id")), "id", "left_anti").join(tails.filter(F.col("remain") <= limit).select("id", "least"), "id")
        small.append(rest.select("conv_id", "n", F.col("id").alias("bucket"), F.lit(depth).cast("long").alias("base"), F.col("least").alias("smallest")))
        buckets = large.filter("n_convs > 1").select("id", "least")
        alone = large.filter("n_convs = 1")
        chains.append(alone.select(F.col("id").alias("bucket"), F.col("least").alias("conv_id"), F.lit(depth).cast("long").alias("base")))
        active = None
        if not buckets.isEmpty():
            active = scratch.save(onward.join(F.broadcast(buckets.select("id")), "id").select("conv_id", "n", F.col("id").alias("bucket")), f"active{k}")

    # small buckets, each by one task
    rest = scratch.save(_all(small), "small")
    mine = spread_join(rows, rest, "conv_id", F.col("n") > limit).filter(F.col("at") >= F.col("base"))
    mine = mine.select("bucket", "conv_id", "at", "tid", "words", "base", "smallest").repartition("bucket").sortWithinPartitions("bucket", "conv_id", "at")
    finished = scratch.save(mine.mapInArrow(_finish, f"{NODE_FIELDS}, bucket string"), "finished")
    out = [finished.filter("bucket is null").select(NODE)]
    sums = [finished.filter("bucket is not null").select(F.col("bucket").alias("id"), *NODE[4:7])]

    # single long conversations: their rows are nodes
    alone = scratch.save(_all(chains), "chains")
    single = rows.join(F.broadcast(alone), "conv_id").filter(F.col("at") >= F.col("base")).join(F.broadcast(alone.join(members, "conv_id").select("conv_id", "n")), "conv_id")
    last = F.col("at") + 1 == F.col("n")
    one = F.lit(1).cast("long")
    digest = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY))
    out.append(single.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256")))
    sums.append(alone.select(F.col("bucket").alias("id"), one.alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))

    # the nodes of the rounds: lists of ids, then sums from the last round up
    ended = _all(ends).repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_pieces, "id string, first bigint, payload binary")
    digests = scratch.save(joined(ended, "id", ["first"], ["payload"], separator=b","), "ends")
    finished_below = scratch.save(_all(sums), "below")
    below = finished_below
    for k in range(len(rounds) - 1, -1, -1):
        nodes, roots, depth = rounds[k]
        kids = nodes.groupBy(F.element_at("path", -1).alias("id")).agg(F.count("*").alias("kids"))
        n = nodes.join(kids, "id", "left").join(below, "id", "left")
        zero = lambda x: F.coalesce(x, F.lit(0))
        children = zero("kids") + zero("n_children")
        n = n.select("id", "path", "k", "least", "n_convs", children.alias("n_children"), F.when(children == 0, 1).otherwise(zero("n_leaves")).alias("own_leaves"), ((F.col("n_convs") - 1) * F.col("words") + zero("saved_tokens")).alias("own_saved"))
        n = scratch.save(n, f"counted{k}")
        each = n.select(F.explode(F.concat("path", F.array("id"))).alias("id"), "own_leaves", "own_saved")
        over = scratch.save(each.groupBy("id").agg(F.sum("own_leaves").cast("long").alias("n_leaves"), F.sum("own_saved").cast("long").alias("saved_tokens")), f"over{k}")
        parents = nodes.select("id", "least").unionByName(roots).join(kids, "id").select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"), "kids")
        flat = scratch.save(n.join(over, "id").join(digests, "id", "left").select("least", "k", "n_convs", "n_children", "n_leaves", "saved_tokens", "payload", F.element_at("path", -1).alias("parent")), f"flat{k}")
        named = spread_join(flat, scratch.save(parents, f"parents{k}"), "parent", F.col("kids") > limit)
        out.append(named.select(F.col("least").alias("conv_id"), (depth + F.col("k")).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("payload", F.lit(EMPTY)).alias("ends_sha256")))
        below = over.join(F.broadcast(roots), "id", "left_semi").join(kids, "id").select("id", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens")
        below = finished_below.unionByName(scratch.save(below, f"below{k}"))
    top = spark.createDataFrame([(root, everyone["least"], everyone["n"])], "id string, conv_id bigint, n_convs bigint").join(below, "id", "left").join(digests, "id", "left")
    out.append(
        top.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                   F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("payload", F.lit(EMPTY)).alias("ends_sha256"))
    )
    return _all(out)


def _all(tables: list[DataFrame]) -> DataFrame:
    made = tables[0]
    for x in tables[1:]:
        made = made.unionByName(x)
    return made


def rebuilt(turns: DataFrame, scratch: Scratch, limit: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed beginnings: the first h turns of conversation c - c % 20, then c's own after its first h; h = crc32(c) % 4. (turns, conv_ids), both written."""
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    sizes = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n"))
    convs = scratch.save(sizes.select("conv_id", "n", borrowed.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("giver")), "convs")
    gives = turns.filter("at < 3").withColumnRenamed("conv_id", "giver")
    given = convs.join(gives, "giver").filter("at < h").select("conv_id", "at", "digest", "words")
    givers = convs.select(F.col("conv_id").alias("giver"), F.least("n", F.lit(3)).alias("has"))
    short = convs.join(givers, "giver", "left").select("conv_id", "n", (F.col("h") - F.least("h", F.coalesce("has", F.lit(0)))).alias("short")).filter("short > 0")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = turns.filter(F.col("at") >= borrowed)
    own = spread_join(own, scratch.save(short, "short"), "conv_id", F.col("n") > max(limit, total // HOT_KEYS), "left")
    own = own.select("conv_id", (F.col("at") - F.coalesce("short", F.lit(0))).alias("at"), "digest", "words")
    return scratch.save(given.unionByName(own), "rebuilt"), convs.select("conv_id")
