"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set sizes verify them.

1. Texts with the same set of word shingles are one class, whose copies go no further.
2. Each class has a MinHash signature, cut into the keys of TREES tries. A trie
   is its classes' keys in sorted order: the classes below one of its nodes are
   a run with a common prefix, and a class shares its longest prefix with a
   neighbour in that order. Classes without a neighbour near enough drop out.
3. Whole keys are matched first. The candidates found tell by how much the
   prefix has to be shortened: their estimated similarities give the share of
   such pairs that meet in some trie at each depth, as a mean over classes.
   The prefix becomes the longest one with the target recall, what meets
   there is looked up and the recall is measured again, until it is reached.
   Nothing is shortened beyond the depth at which pairs right at the threshold
   meet with the target recall; too few candidates to measure with lead there.
4. A node's candidates are all its pairs that no longer prefix has led to and
   whose estimated similarity passes. A node over GROUP_ROWS is dealt into
   blocks and each pair of blocks is a task, so that every pair is compared and
   no task holds more than about two blocks. A pair that meets in several tries
   is taken in the first. A task tells of each class which others of the block
   it must be verified with, as bits, so that pairs never become rows.
5. Candidates are verified on their whole texts, again by pairs of blocks. Each
   block counts every class's links and keeps a spanning forest of them, whose
   edges are joined to components by min-label propagation with pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_rows, slices, text_key
from .words import mixed, shingles

WIDTH, THRESHOLD = 5, 0.8
#: Tries, hashes of a key, and the share of links that must meet in some trie.
TREES, KEY, RECALL = 16, 8, 0.9995
#: Classes with a candidate from which on the recall is measured. From fewer the mean of shares can't be told from the target, so the
#: prefix is then shortened at once to the depth that needs no measuring: the same links or more, for more candidates.
EVIDENCE = 1000
#: Candidates are verified from this estimate on: four standard deviations below the threshold.
ESTIMATE = 0.66
#: Rows of a block of a prefix group on average at most; a task compares two blocks.
GROUP_ROWS = 256
#: Rows of a block of texts in verification, and their shingles together, at most; a single longer text is a block of its own.
VERIFY_ROWS, VERIFY_GRAMS = 512, 1_000_000

_HASHES = TREES * KEY
_LEVELS = np.arange(_HASHES + 1) / _HASHES
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def met(jaccard, depth: int, trees: int = TREES):
    """The share of pairs of this similarity that meet in some trie at this depth; of numbers or columns."""
    return 1 - (1 - jaccard**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, key: int = KEY, recall: float = RECALL) -> int:
    """The longest prefix with which pairs right at the threshold meet in some trie with the target recall."""
    return next((d for d in range(key, 1, -1) if met(threshold, d, trees) >= recall), 1)


def signature(grams: np.ndarray) -> bytes:
    """The minima of the hash functions, 16 bits of each."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 2048):
        np.minimum(least, (grams[lo : lo + 2048, None] * _A + _B).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def signatures(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc (the id), text_key, cls binary (of the shingle set), grams int, sig binary, for every row. Without words: grams 0, cls of the text itself, no sig."""
    source = df.select(F.col(id_col).alias("doc"), text_col, text_key(text_col).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for part, texts in slices(batches):
            cls, size, sig = [], [], []
            for text in texts:
                grams = shingles(text, width)
                key = hashlib.blake2b(grams.tobytes() if len(grams) else b"\0" + text.encode("utf-8", "replace"), digest_size=16).digest()
                if len(grams) and key not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[key] = signature(grams)
                cls.append(key)
                size.append(len(grams))
                sig.append(known[key] if len(grams) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cls, pa.binary()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], names=["doc", "text_key", "cls", "grams", "sig"])

    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, text_key binary, cls binary, grams int, sig binary")


def _keys(column: pa.Array) -> np.ndarray:
    """The hashes of a column of whole keys or signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _forest(nodes: DataFrame, least: int) -> DataFrame:
    """tree, key, cls, deep: the leaves of the tries in sorted order, with the hashes that each shares with the nearer neighbour, if those are at least least.

    Which leaf is next to a partition's first and last one isn't known there; both stay, as if it were equal.
    """
    leaves = nodes.filter("grams > 0").select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig", "cls")
    leaves = leaves.select("tree", F.expr(f"substring(sig, tree * {2 * KEY} + 1, {2 * KEY})").alias("key"), "cls")
    ordered = leaves.repartitionByRange("tree", "key", "cls").sortWithinPartitions("tree", "key", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, KEY  # the last leaf so far, and what it shares with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            tree, keys = whole.column(0).to_numpy(), _keys(whole.column(1))
            same = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
            shared = np.concatenate([[before], np.logical_and.accumulate(same, axis=1).sum(axis=1)]).astype(np.int32)
            yield found(whole.slice(0, whole.num_rows - 1), np.maximum(shared[:-1], shared[1:]))
            held, before = whole.slice(whole.num_rows - 1), int(shared[-1])
        if held is not None:
            yield found(held, np.array([KEY], np.int32))

    def found(part: pa.RecordBatch, deep: np.ndarray) -> pa.RecordBatch:
        keep = pa.array(deep >= least)
        return pa.RecordBatch.from_arrays([*(part.column(k).filter(keep) for k in range(3)), pa.array(deep).filter(keep)], names=["tree", "key", "cls", "deep"])

    return ordered.mapInArrow(run, "tree int, key binary, cls binary, deep int")


def _tasks(forest: DataFrame, depth: int, done: int) -> DataFrame:
    """task long, side, tree, cls: the pairs of blocks of the nodes at this depth, if not all their classes have a prefix of done hashes in common. side: -1 where a block meets itself, else 0 and 1."""
    prefix = F.substring("key", 1, 2 * depth)
    leaves = forest.filter(F.col("deep") >= depth).select("tree", "cls", F.xxhash64("tree", prefix).alias("bucket"), F.xxhash64(F.substring("key", 1, 2 * done)).alias("below"))
    sizes = leaves.groupBy("bucket").agg(F.count("*").alias("n"), F.min("below").alias("one"), F.max("below").alias("two"))
    sizes = sizes.filter("n > 1" if done > KEY else "n > 1 and one < two").select("bucket", "n")
    blocks = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    dealt = leaves.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    return dealt.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"), side.alias("side"), "tree", "cls")


def _near(sigs: np.ndarray, sizes: np.ndarray, side: np.ndarray, tree: int, depth: int, done: int, least: float, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A row, the rows that it makes candidates with and their equal hashes: an estimate of at least least, fitting sizes, no earlier trie in which they meet and none with done hashes in common."""
    keys = sigs.reshape(len(sigs), TREES, KEY)
    others = np.flatnonzero(side == 1)
    for k in np.flatnonzero(side < 1).tolist():
        to = np.arange(k + 1, len(sigs)) if side[k] < 0 else others
        to = to[np.minimum(sizes[to], sizes[k]) >= threshold * np.maximum(sizes[to], sizes[k])]
        if done <= KEY:
            to = to[(keys[to, tree, depth:done] != keys[k, tree, depth:done]).any(axis=1)]
        equal = (sigs[to] == sigs[k]).sum(axis=1, dtype=np.int32)
        to, equal = to[equal >= least * _HASHES], equal[equal >= least * _HASHES]
        if len(to):
            same = np.logical_and.accumulate(keys[to] == keys[k], axis=2).sum(axis=2)  # hashes in common in each trie
            fresh = (same[:, tree] >= depth) & (same[:, :tree] < depth).all(axis=1) & (same < done).all(axis=1)
            to, equal = to[fresh], equal[fresh]
        if len(to):
            yield k, to, equal


def _blocks(side: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's block of texts and its place there; a block's rows are all of one side, and those of side 1 come last."""
    block, place = np.zeros(len(side), np.int32), np.zeros(len(side), np.int32)
    at = rows = held = 0
    last = None
    for k in np.argsort(side, kind="stable").tolist():
        if rows and (side[k] != last or rows == VERIFY_ROWS or held + grams[k] > VERIFY_GRAMS):
            at, rows, held = at + 1, 0, 0
        block[k], place[k], last = at, rows, side[k]
        rows, held = rows + 1, held + int(grams[k])
    return block, place


def _candidates(rows: DataFrame, depth: int, done: int, least: float, threshold: float) -> DataFrame:
    """What a task's classes must be verified with: a row for each class and pair of blocks (u <= v) of texts where it has a candidate.

    others: the places in block v of the candidates for which this class is the
    first of the pair. equal: on one of the class's rows in the task, how many
    candidates it has with each number of equal hashes.
    rows: task, side, tree, cls, doc, text_key, grams, sig, in order of task within a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            bucket = whole.column(0).to_numpy()
            last = int(np.searchsorted(bucket == bucket[-1], True)) if len(bucket) else 0
            yield from groups(whole.slice(0, last))
            kept = whole.slice(last)
        if kept is not None:
            yield from groups(kept)

    def groups(part: pa.Table) -> Iterator[pa.RecordBatch]:
        if not part.num_rows:
            return
        task, side, tree = (part.column(k).to_numpy() for k in range(3))
        cls, doc, text = (part.column(k).to_pylist() for k in (3, 4, 5))
        grams, sigs = part.column(6).to_numpy(), _keys(part.column(7))
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(task)]):
            if hi - lo > 1:
                near = list(_near(sigs[lo:hi], grams[lo:hi], side[lo:hi], int(tree[lo]), depth, done, least, threshold))
                out += ((int(task[lo]), u, v, x, y, cls[lo + k], doc[lo + k], text[lo + k], *rest) for u, v, x, y, k, *rest in _asked(near, side[lo:hi], grams[lo:hi]))
            if len(out) >= 2000:
                yield batch_of(out, part.column(4).type)
                out = []
        if out:
            yield batch_of(out, part.column(4).type)

    def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (pa.int64(), *[pa.int32()] * 4, pa.binary(), kind, pa.binary(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["task", "u", "v", "block", "place", "cls", "doc", "text_key", "others", "equal"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"task long, u int, v int, block int, place int, cls binary, doc {kind}, text_key binary, others binary, equal array<int>")


def _asked(near: list[tuple[int, np.ndarray, np.ndarray]], side: np.ndarray, grams: np.ndarray) -> Iterator[tuple]:
    """u, v, block, place, row, others, equal for a task's candidates."""
    if not near:
        return
    block, place = _blocks(side, grams)
    counts = np.zeros((len(side), _HASHES + 1), np.int32)
    parts: dict[tuple[int, int], dict[int, np.ndarray | None]] = {}
    for k, to, equal in near:
        counts[k] += np.bincount(equal, minlength=_HASHES + 1).astype(np.int32)
        counts[to, equal] += 1
        for v in np.unique(block[to]).tolist():
            own = to[block[to] == v]
            rows = parts.setdefault((int(block[k]), v), {})
            bits = rows[k] = np.zeros(VERIFY_ROWS, np.uint8)
            bits[place[own]] = 1
            for j in own.tolist():
                rows.setdefault(j, None)
    told = set()
    for (u, v), rows in parts.items():
        for k, bits in rows.items():
            yield u, v, int(block[k]), int(place[k]), k, None if bits is None else np.packbits(bits).tobytes(), None if k in told else counts[k].tolist()
            told.add(k)


def recalls(asked: DataFrame, depth: int, least: int, threshold: float = THRESHOLD) -> tuple[int, dict[int, float]]:
    """From the candidates that a depth has led to: the classes with one whose estimate passes the threshold, and for each depth down to least the share of such pairs that meet there, as a mean over classes.

    A pair stands for 1 / met(its similarity) pairs that the depth has or has missed (Horvitz and Thompson 1952).
    A class of which no pair at all has met yet isn't in the mean; such a class has few and distant links, which the
    weights of its like that have met stand for, and the depth at which measuring ends finds it.
    """
    wanted, levels = range(depth, least - 1, -1), [k for k, x in enumerate(_LEVELS) if x >= threshold]
    sums = asked.filter("equal is not null").groupBy("cls").agg(*(F.sum(F.get("equal", F.lit(k))).alias(f"n{k}") for k in levels))

    def total(weight) -> Column:
        return sum((F.col(f"n{k}") * float(weight(_LEVELS[k])) for k in levels), F.lit(0.0))

    there = total(lambda s: 1 / met(s, depth))
    shares = sums.filter(there > 0).select(*((total(lambda s, d=d: met(s, d) / met(s, depth)) / there).alias(f"d{d}") for d in wanted))
    row = shares.agg(F.count("*").alias("n"), *(F.avg(f"d{d}").alias(f"d{d}") for d in wanted)).first()
    return row.n, {d: row[f"d{d}"] or 0.0 for d in wanted}


def _found(nodes: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """The candidates of all depths that the target recall takes."""
    least = prefix_depth(threshold)
    forest = scratch.save(_forest(nodes, least), "forest")
    depth, done, found = KEY, KEY + 1, None
    while True:
        grouped = _tasks(forest, depth, done).join(nodes.select("cls", "doc", "text_key", "grams", "sig"), "cls")
        ordered = grouped.select("task", "side", "tree", "cls", "doc", "text_key", "grams", "sig").repartition("task").sortWithinPartitions("task")
        asked = scratch.save(_candidates(ordered, depth, done, ESTIMATE, threshold), f"asked{depth}")
        found = asked if found is None else found.unionByName(asked)
        if depth == least:
            return found
        classes, share = recalls(found, depth, least, threshold)
        further = next((d for d in share if share[d] >= RECALL), least) if classes >= EVIDENCE else least
        if further == depth:
            return found
        depth, done = further, depth


def _verified(asked: DataFrame, docs: DataFrame, scratch: Scratch, width: int, threshold: float, every: bool) -> DataFrame:
    """Of each pair of blocks: rows a, degree for each class with verified links, and rows a, b, jaccard: a spanning forest of them, or with every all of them."""
    texts = join_rows(docs, asked.select("doc", "text_key"), "doc", "text", "left_semi", scratch, "ids")
    texts = scratch.save(texts.withColumn("text_key", text_key("text")).dropDuplicates(["doc", "text_key"]), "texts")
    rows = asked.select("task", "u", "v", "block", "place", "cls", "others", "doc", "text_key").join(texts, ["doc", "text_key"])
    rows = rows.select("task", "u", "v", "block", "place", "cls", "others", "text").repartition("task", "u", "v").sortWithinPartitions("task", "u", "v")

    def links_of(held: dict[tuple[int, int], tuple[bytes, np.ndarray]], wanted: list[tuple[tuple[int, int], list[tuple[int, int]]]]) -> Iterator[tuple]:
        degree: dict[bytes, int] = {}
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for key, others in wanted:
            a, mine = held[key]
            others = [held[x] for x in others if x in held and held[x][0] != a]
            if not others:
                continue
            theirs, sizes = np.concatenate([x for _, x in others]), np.array([len(x) for _, x in others])
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
            share = both / (len(mine) + sizes - both)
            for k in np.flatnonzero(share >= threshold).tolist():
                b = others[k][0]
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                p, q = find(a), find(b)
                root[p] = q
                if every or p != q:
                    yield a, b, float(share[k]), None
        yield from ((a, None, None, n) for a, n in degree.items())

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.float64(), pa.int64()))], names=["a", "b", "jaccard", "degree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, wanted = None, {}, []
        for part, texts in slices(batches, 7):
            for *key, block, place, own, others, text in zip(*(part.column(k).to_pylist() for k in range(7)), texts):
                if key != at:
                    if out := list(links_of(held, wanted)):
                        yield batch_of(out)
                    at, held, wanted = key, {}, []
                grams = shingles(text, width)
                held[block, place] = own, grams
                if others is not None:
                    wanted.append(((block, place), [(key[2], k) for k in np.flatnonzero(np.unpackbits(np.frombuffer(others, np.uint8))).tolist()]))
        if out := list(links_of(held, wanted)):
            yield batch_of(out)

    return rows.mapInArrow(run, "a binary, b binary, jaccard double, degree long")


def _thinned(links: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b (a > b): edges with the same components as the links, at most two for each node.

    Each pair of blocks keeps a forest of its own, so that a large group's forests together have as many edges as its nodes times its
    blocks. Of a node's lesser neighbours the least stays its neighbour and becomes that of the others (the small star of Kiveris et al.
    2014). A round makes no edge more than there were, and goes on until a node has one lesser neighbour on average, two at most.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, turn = scratch.save(edges, "thin0"), 0
    while True:
        size = edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges")).first()
        if size.edges <= 2 * size.nodes:
            return edges
        low = edges.withColumn("low", F.min("b").over(Window.partitionBy("a")))
        kept = F.struct(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        turn += 1
        edges = scratch.save(low.select(kept.alias("e")).select("e.*").distinct(), f"thin{turn}")
        scratch.drop(f"thin{turn - 1}")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the least node that links (columns a, b) lead to. Rounds end when nothing changes; their number grows with the logarithm of the longest path."""
    links = _thinned(links, scratch)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both, "edges")
    roots = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots0")
    turn = 0
    while True:
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = roots.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = nearer.join(above, "root", "left").select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root"))
        turn += 1
        after = scratch.save(after, f"roots{turn}")
        scratch.drop(f"roots{turn - 1}")
        roots = after.select("node", "root")
        if after.filter(F.col("was") != F.col("root")).isEmpty():
            return roots


def _classed(df: DataFrame, id_col: str, text_col: str, width: int, threshold: float, scratch: Scratch, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc, text_key, cls), what is known of each class (cls, class_id, class_key, n_links) and links (a, b, jaccard). class_id and class_key: the least id of the component, and of its texts the least by text_key."""
    rows = scratch.save(signatures(df, id_col, text_col, width), "rows")
    first = F.min(F.struct("doc", "text_key"))
    nodes = rows.filter("doc is not null").groupBy("cls").agg(first.alias("first"), F.count("*").alias("copies"), F.max("grams").alias("grams"), F.max("sig").alias("sig"))
    nodes = scratch.save(nodes.withColumns({"doc": F.col("first.doc"), "text_key": F.col("first.text_key")}), "nodes")
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    verified = scratch.save(_verified(_found(nodes, scratch, threshold), docs, scratch, width, threshold, every), "links")
    links = verified.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    roots = components(links, scratch)
    degrees = verified.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("degree").alias("degree"))
    linked = roots.withColumnRenamed("node", "cls").join(degrees, "cls").join(nodes.select("cls", "first"), "cls")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("cls", "least", "degree")
    told = nodes.select("cls", "first", "copies").join(linked, "cls", "left")
    least = F.coalesce("least", "first")
    told = told.select("cls", least["doc"].alias("class_id"), least["text_key"].alias("class_key"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    return rows.select("doc", "text_key", "cls"), scratch.save(told, "told"), links


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: id_col, class_id, n_links: a row for each input row. class_id is
    the least id of the documents that verified links and equal shingle sets
    lead to; n_links counts the other documents with the same shingles and all
    verified links of the document's text to other texts. links: a, b, jaccard
    between texts' classes: verified links that lead from each class to all
    others that any link leads to; with every all links, which are as many as
    the square of a group of near copies. Equal texts without any word are one
    class; texts of fewer than width words have one shingle. A null text is an
    empty one. Rows with a null id have a null class_id and no links. Ids are
    of any type with an order; repeated rows each get a row. Extra columns are
    ignored.
    """
    rows, told, links = _classed(df, id_col, text_col, width, threshold, Scratch(df.sparkSession), every)
    classes = rows.filter("doc is not null").join(told, "cls").select("doc", "class_id", "n_links")
    none = rows.filter("doc is null").select("doc", F.lit(None).cast(rows.schema["doc"].dataType).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return classes.unionByName(none).withColumnRenamed("doc", id_col), links


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: of those with the least id the text that is the least by its digest, once.

    Rows are told apart by id and text, so that an id with several texts loses
    only those that are copies. Of rows that are equal in both the least by
    all its columns stays. Rows with a null id stay.
    """
    scratch = Scratch(df.sparkSession)
    rows, told, _ = _classed(df, id_col, text_col, WIDTH, THRESHOLD, scratch)
    copies = rows.join(told, "cls").filter((F.col("doc") != F.col("class_id")) | (F.col("text_key") != F.col("class_key"))).select("doc", "text_key")
    kept = join_rows(df, copies, id_col, text_col, "left_anti", scratch, "copies")
    repeated = rows.filter("doc is not null").groupBy("doc", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "text_key")
    repeated = scratch.save(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    once = join_rows(kept, repeated, id_col, text_col, "left_anti", scratch, "repeated1")
    several = join_rows(kept, repeated, id_col, text_col, "left_semi", scratch, "repeated2")
    least = several.groupBy(id_col, text_key(text_col)).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("__row"))
    return once.unionByName(least.select(*(F.col(f"__row.`{c}`") for c in df.columns)))
