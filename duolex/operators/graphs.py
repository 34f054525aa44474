"""Graphs over rows: approximate nearest neighbours by descent, and communities by moves that raise modularity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import written, components, top_per_group
from .vectors import CELLS, normalised

#: Rows drawn as pivots of an order of `neighbours`, at most.
PIVOTS = 256
#: Keys with more than 1 / HOT_KEYS of all rows are at most so many; they are broadcast.
HOT_KEYS = 100_000


def spread_lookup(left: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """left joined to right, which has one row a key. Right's rows where `hot` holds (keys with many rows on the left, whose number the caller bounds) are broadcast; left is read twice."""
    many = right.filter(hot)
    return left.join(F.broadcast(many), key).unionByName(left.join(F.broadcast(many.select(key)), key, "left_anti").join(right.filter(~hot), key))


def _codes(points: DataFrame, kind: str) -> DataFrame:
    """id, c, x: a vector's direction as one signed byte a dimension, and the vector itself (v) as 4-byte floats where these hold it exactly, else as 8-byte ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                u, x = np.stack(batch["u"].to_numpy()), np.stack(batch["v"].to_numpy())
                c = np.round(u * (127 / np.abs(u).max(axis=1, keepdims=True))).astype(np.int8)
                short = x.astype(np.float32)
                exact = (short == x).all(axis=1)
                yield pd.DataFrame({"id": batch["id"], "c": [r.tobytes() for r in c], "x": [(s if e else r).tobytes() for s, r, e in zip(short, x, exact)]})

    return points.mapInPandas(run, f"id {kind}, c binary, x binary")


def _unpacked(codes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Codes as rows of whole numbers and their lengths. Products of rows are exact, so that a pair's similarity is the same wherever it is computed."""
    c = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)
    c = c.astype(np.float32 if c.shape[1] <= 1024 else np.float64)
    return c, np.sqrt(np.einsum("ij,ij->i", c, c))


def _best(src: np.ndarray, dst: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each src, a pair once, ties by dst."""
    order = np.lexsort((dst, -s, src))
    src, dst, s = src[order], dst[order], s[order]
    once = np.ones(len(src), bool)
    once[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, s = src[once], dst[once], s[once]
    keep = np.arange(len(src)) - np.searchsorted(src, src) < k
    return src[keep], dst[keep], s[keep]


def _block_pairs(known: DataFrame, n: int, k: int, trees: int, leaf: int, seed: int, kind: str) -> DataFrame:
    """src, dst, s: for each of some orders, a row's k best others better than its worst in the blocks of rows that lie together.

    An order is by the nearest of some rows drawn as pivots, then by the signs of
    random hyperplanes. Blocks overlap by half; two rows meet once an order.
    """
    many = min(PIVOTS, -(-n // leaf))
    drawn = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(trees * many).select("c").toPandas()["c"]
    pivots, length = _unpacked(drawn)
    pivots = pivots / length[:, None]
    planes = np.random.default_rng(seed).standard_normal((trees, 32, pivots.shape[1])).astype(np.float32)

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                c, _ = _unpacked(batch["c"])
                for t in range(trees):
                    own = pivots[t::trees]
                    first = (c @ own.T).argmax(axis=1).astype(">u2") if len(own) else np.zeros(len(c), ">u2")
                    keys = np.hstack([first.view(np.uint8).reshape(-1, 2), np.packbits(c @ planes[t].T > 0, axis=1)])
                    yield batch.assign(tree=t, key=[b.tobytes() for b in keys])[["tree", "key", "id", "c", "worst"]]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, met = None, 0
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= 2 * leaf:
                yield from near(held.iloc[:leaf], met)
                held, met = held.iloc[leaf // 2 :], leaf - leaf // 2
        if held is not None:
            yield from near(held, met)

    def near(rows: pd.DataFrame, met: int) -> Iterator[pd.DataFrame]:
        """The first `met` rows have met each other in the block before."""
        for lo, hi in _runs(rows["tree"].to_numpy()):
            if hi - lo > 1:
                yield from compared(rows.iloc[lo:hi], max(0, met - lo))

    def compared(part: pd.DataFrame, met: int) -> Iterator[pd.DataFrame]:
        (c, length), worst, m = _unpacked(part["c"]), part["worst"].to_numpy(np.float32), len(part)
        ids, place = np.unique(part["id"].to_numpy(), return_inverse=True)
        step = max(1, CELLS // m)
        for lo in range(0, m, step):
            s = ((c[lo : lo + step] @ c.T) / (length[lo : lo + step, None] * length[None, :])).astype(np.float32)
            rows = np.arange(lo, lo + len(s))
            s[rows - lo, rows] = -2
            if lo < met:
                s[: met - lo, :met] = -2
            good = s > worst[lo : lo + step, None]
            more = np.flatnonzero(good.sum(axis=1) > k)
            if len(more):
                good[more] &= s[more] >= np.partition(s[more], m - k, axis=1)[:, m - k, None]
            i, j = np.nonzero(good)
            src, dst, s = _best(place[lo + i], place[j], s[i, j], k)
            yield pd.DataFrame({"src": ids[src], "dst": ids[dst], "s": s})

    keyed = known.mapInPandas(signs, f"tree int, key binary, id {kind}, c binary, worst float")
    tasks = max(1, -(-n * trees // (4 * leaf)))
    return keyed.repartitionByRange(tasks, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").mapInPandas(blocks, f"src {kind}, dst {kind}, s float")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts], [*cuts, len(keys)])) if len(keys) else []


def _renewed(lists: DataFrame | None, pairs: DataFrame, k: int) -> DataFrame:
    """src, dst, s, old: the k best of each src among its list and new pairs, ties by id; old: it was in the list. One shuffle, by src."""
    rows = pairs.withColumn("old", F.lit(False))
    if lists is not None:
        rows = lists.withColumn("old", F.lit(True)).unionByName(rows)
    once = rows.repartition("src").groupBy("src", "dst").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    return written(top_per_group(once, ["src"], [F.desc("s"), "dst"], k).drop("rank"))


def _looked_up(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """left joined to right, which has one row a key; hot: keys with many rows on the left, if any."""
    if hot is None:
        return left.join(right, key)
    return spread_lookup(left, right.join(F.broadcast(hot.withColumn("hot", F.lit(True))), key, "left").fillna(False, ["hot"]), key, F.col("hot")).drop("hot")


def _met_pairs(met: DataFrame, k: int, kind: str) -> DataFrame:
    """src, dst, s: pairs of rows of the same mid that are better than src's worst, of which one is fresh there."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held["mid"].iloc[-1] if len(held) else None
            whole, held = held[held["mid"] != last], held[held["mid"] == last]
            yield from found(whole)
        if held is not None:
            yield from found(held)

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        (c, length), worst, fresh = _unpacked(rows["c"]), rows["worst"].to_numpy(np.float32), rows["fresh"].to_numpy(bool)
        ids, place = np.unique(rows["id"].to_numpy(), return_inverse=True)
        runs = np.array(_runs(rows["mid"].to_numpy()))
        size = int((runs[:, 1] - runs[:, 0]).max())
        step, out = max(1, CELLS // (size * size)), []
        for lo in range(0, len(runs), step):
            start, end = runs[lo : lo + step].T
            at = start[:, None] + np.arange(size)
            there = at < end[:, None]
            at = np.where(there, at, start[:, None])
            x, long, new = c[at], length[at], fresh[at]
            s = ((x @ x.transpose(0, 2, 1)) / (long[:, :, None] * long[:, None, :])).astype(np.float32)
            good = (s > worst[at][:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & ~np.eye(size, dtype=bool)
            g, i, j = np.nonzero(good)
            out.append((place[at[g, i]], place[at[g, j]], s[g, i, j]))
        src, dst, s = _best(*(np.concatenate(x) for x in zip(*out)), k)
        yield pd.DataFrame({"src": ids[src], "dst": ids[dst], "s": s})

    return met.repartition("mid").sortWithinPartitions("mid").mapInPandas(compare, f"src {kind}, dst {kind}, s float")


def _exact(pairs: DataFrame, kind: str) -> DataFrame:
    """src, dst, similarity of pairs with both vectors, to 12 digits."""

    def vectors(packed: pd.Series, size: int) -> np.ndarray:
        x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * size else np.float64) for b in packed]).astype(np.float64)
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                size = int(batch["size"].iloc[0])
                s = np.einsum("ij,ij->i", vectors(batch["x"], size), vectors(batch["y"], size))
                yield pd.DataFrame({"src": batch["src"], "dst": batch["dst"], "similarity": np.round(s, 12)})

    return pairs.mapInPandas(run, f"src {kind}, dst {kind}, similarity double")


def neighbours(points: DataFrame, id_col: str, vector: str, k: int, least: float = -1.0, width: int | None = None, trees: int = 32, leaf: int = 2048, tolerance: float = 0.001, seed: int = 7) -> DataFrame:
    """src, dst, similarity: about each point's k nearest others of at least the least similarity, by neighbour descent.

    Lists start from blocks of rows that lie together in some orders, eight at a
    time, until eight change under a tenth of the entries or `trees` are done.
    In each round a point's neighbours and up to k of those that it is a
    neighbour of are compared with each other, as a neighbour's neighbour is
    likely one; two that have met there before are not compared again, and a
    point around which nothing is new gets no vectors. Rounds end when fewer than tolerance of the lists' entries
    change. On the way each list has `width` entries (twice k), compared by codes of one byte a
    dimension; the k best of them by their exact similarity
    are returned: vectors without any order need the longer ones. The work of a round is linear in the points; a point that is
    everybody's neighbour is no hot key, as only its best k lists look back
    from it. ids must have no repeats; a zero vector is an error.
    """
    kind, most, k = points.schema[id_col].dataType.simpleString(), k, width or 2 * k
    raw = points.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = written(_codes(raw.withColumn("u", normalised(F.col("v"))), kind))
    n = own.count()
    if not n:
        return own.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("similarity"))
    limit = max(10_000, 4 * k * n // HOT_KEYS)

    def known() -> DataFrame:
        if lists is None:
            return own.select("id", "c", F.lit(-2.0).cast("float").alias("worst"))
        worst = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") == k, F.min("s")).otherwise(-2.0).cast("float").alias("worst"))
        return own.select("id", "c").join(worst, "id", "left").fillna(-2.0, ["worst"])

    def renewed(pairs: DataFrame) -> tuple[DataFrame, int]:
        better = _renewed(lists, pairs, k)
        return better.drop("old"), better.filter(~F.col("old")).count()

    def often() -> DataFrame | None:
        """Points of so many lists that they are broadcast."""
        hot = lists.groupBy(F.col("dst").alias("id")).count().filter(F.col("count") > limit - k - 1).select("id")
        hot = written(hot)
        return None if hot.isEmpty() else hot

    lists = None
    for done in range(0, trees, 8):
        lists, changed = renewed(_block_pairs(known(), n, k, min(8, trees - done), leaf, seed + done, kind))
        if changed <= 0.1 * n * k:
            break
    before = None
    while True:
        slot = F.pmod(F.xxhash64("src"), F.lit(k))
        back = lists.groupBy(F.col("dst").alias("mid"), slot).agg(F.max_by("src", F.struct("s", "src")).alias("id")).groupBy("mid").agg(F.collect_list("id").alias("back"))
        to = lists.groupBy(F.col("src").alias("mid")).agg(F.collect_list("dst").alias("to"))
        ids = F.array_distinct(F.flatten(F.array(F.array("mid"), F.coalesce("to", F.array()), F.coalesce("back", F.array()))))
        around = own.select(F.col("id").alias("mid")).join(to, "mid", "left").join(back, "mid", "left").select("mid", ids.alias("ids"))
        if before is None:
            around = around.withColumn("fresh", F.col("ids"))
        else:
            around = around.join(before, "mid").withColumn("fresh", F.array_except("ids", "seen")).drop("seen")
        around = written(around)
        before = around.select("mid", F.col("ids").alias("seen"))
        live = around.filter(F.size("fresh") > 0).select("mid", "fresh", F.explode("ids").alias("id")).select("mid", "id", F.array_contains("fresh", F.col("id")).alias("fresh"))
        met = _looked_up(live, known(), "id", often()).select("mid", "id", "fresh", "c", "worst")
        lists, changed = renewed(_met_pairs(met, k, kind))
        if changed <= tolerance * n * k:
            break
    ends = _looked_up(lists.select("src", F.col("dst").alias("id")), own.select("id", F.col("x").alias("y")), "id", often()).withColumnRenamed("id", "dst")
    ends = ends.join(own.select(F.col("id").alias("src"), "x", F.length("c").alias("size")), "src").select("src", "dst", "x", "y", "size")
    return top_per_group(_exact(ends, kind).filter(F.col("similarity") >= least), ["src"], [F.desc("similarity"), "dst"], most).drop("rank")


# communities


def _quality(graph: DataFrame, part: DataFrame, double: float, resolution: float) -> float:
    """The modularity of a partition. graph: a, b, w in both directions; part: node, comm, deg; double: the sum of all degrees."""
    a, b = part.select(F.col("node").alias("a"), F.col("comm").alias("ca")), part.select(F.col("node").alias("b"), F.col("comm").alias("cb"))
    inside = graph.join(a, "a").join(b, "b").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")))).first()[0] or 0.0
    tot = part.groupBy("comm").agg(F.sum("deg").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / double - resolution * tot / double**2


def modularity(edges: DataFrame, assigned: DataFrame, src: str = "source", dst: str = "target", weight: str = "similarity", resolution: float = 1.0) -> float:
    """The modularity of communities (node, community) of an undirected graph; nodes without edges add nothing."""
    graph = _both_ways(edges, src, dst, weight)
    part = assigned.join(graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("deg")), "node").select("node", F.col("community").alias("comm"), "deg")
    double = graph.agg(F.sum("w")).first()[0] or 0.0
    return _quality(graph, part, double, resolution) if double else 0.0


def _both_ways(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    rows = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(weight).cast("double").alias("w")).filter("a <> b and w > 0")
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _moved(graph: DataFrame, part: DataFrame, double: float, resolution: float, tolerance: float) -> tuple[DataFrame, bool]:
    """part after rounds of moves of single nodes to neighbours' communities, and whether any was made.

    A round moves all nodes that gain, a node alone to one alone only towards
    the smaller name. If that lowers the modularity (neighbours move past each
    other), from then on half of them by their hash are tried. If these lower it
    too, only moves are kept that are the best of all that touch their two
    communities; such moves can't disturb each other, so they raise it.
    """
    links = graph.filter("a <> b")
    moved, halved, turn, quality = False, False, 0, _quality(graph, part, double, resolution)
    while True:
        turn += 1
        comm = part.select(F.col("node").alias("b"), F.col("comm").alias("to"))
        near = links.join(comm, "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("k"))
        sizes = part.groupBy("comm").agg(F.sum("deg").alias("tot"), F.count("*").alias("members"))
        own = part.join(sizes, "comm")
        to = sizes.select(F.col("comm").alias("to"), F.col("tot").alias("to_tot"), F.col("members").alias("to_members"))
        rows = near.join(own, "node").join(to, "to")
        stay = near.join(part, "node").filter(F.col("to") == F.col("comm")).select("node", F.col("k").alias("k_own"))
        rows = rows.filter(F.col("to") != F.col("comm")).join(stay, "node", "left").fillna(0.0, ["k_own"])
        gain = 2 * (F.col("k") - F.col("k_own")) / double - 2 * resolution * F.col("deg") * (F.col("to_tot") - F.col("tot") + F.col("deg")) / double**2
        alone = (F.col("members") == 1) & (F.col("to_members") == 1) & (F.col("to") > F.col("comm"))
        rows = rows.withColumn("gain", F.round(gain, 15)).filter((F.col("gain") > 1e-12) & ~alone)
        best = rows.groupBy("node").agg(F.max_by(F.struct("to", "comm", "gain"), F.struct("gain", -F.col("to"))).alias("m")).select("node", "m.*")
        best = written(best)
        if best.isEmpty():
            return part, moved

        def after(moves: DataFrame) -> DataFrame:
            made = part.join(moves.select("node", "to"), "node", "left")
            return written(made.select("node", F.coalesce("to", "comm").alias("comm"), "deg"))

        half = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        tried = after(best.filter(half) if halved else best)
        now = _quality(graph, tried, double, resolution)
        if now <= quality and not halved:
            halved, tried = True, after(best.filter(half))
            now = _quality(graph, tried, double, resolution)
        if now <= quality:
            rank = F.struct("gain", F.xxhash64("node"), "node")
            touched = best.select("node", rank.alias("r"), F.explode(F.array("to", "comm")).alias("c"))
            lead = touched.groupBy("c").agg(F.max("r").alias("lead"))
            kept = touched.join(lead, "c").groupBy("node").agg(F.bool_and(F.col("r") == F.col("lead")).alias("kept")).filter("kept")
            tried = after(best.join(kept, "node", "left_semi"))
            now = _quality(graph, tried, double, resolution)
        if now <= quality:
            return part, moved
        gained, part, quality, moved = now - quality, tried, now, True
        if gained < tolerance:
            return part, moved


def communities(edges: DataFrame, src: str = "source", dst: str = "target", weight: str = "similarity", resolution: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """node, community (its least node), size: connected communities of an undirected weighted graph with a high modularity.

    Levels of local moves, refinement and aggregation (Traag, Waltman and van
    Eck 2019), each as joins: nodes move to neighbours' communities; within each
    community they start again from single nodes, and what they form there is a
    node of the next level, which begins with the communities found. Edges of
    both directions or repeats add up; loops, null or negative weights and nodes
    without edges are left out. Ties go to the smaller name, so the result is
    the same for the same graph. Ids are integers. A level's rounds end when one
    raises the modularity by less than tolerance.
    """
    graph = written(_both_ways(edges, src, dst, weight))
    double = graph.agg(F.sum("w")).first()[0] or 0.0
    base, members, start = graph, written(graph.select(F.col("a").alias("node")).distinct().withColumn("level", F.col("node"))), None
    if not double:
        return members.select("node", F.col("node").alias("community"), F.lit(1).cast("long").alias("size"))
    while True:
        degrees = graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("deg"))
        degrees = written(degrees)
        single = degrees.select("node", F.col("node").alias("comm"), "deg")
        part = single if start is None else degrees.join(start, "node").select("node", "comm", "deg")
        part, _ = _moved(graph, written(part), double, resolution, tolerance)
        ca, cb = part.select(F.col("node").alias("a"), F.col("comm").alias("ca")), part.select(F.col("node").alias("b"), F.col("comm").alias("cb"))
        inside = written(graph.join(ca, "a").join(cb, "b").filter("ca = cb").select("a", "b", "w"))
        refined, merged = _moved(inside, written(single), double, resolution, tolerance)
        if not merged:
            break
        fa, fb = refined.select(F.col("node").alias("a"), F.col("comm").alias("fa")), refined.select(F.col("node").alias("b"), F.col("comm").alias("fb"))
        start = written(refined.join(part.select("node", F.col("comm").alias("outer")), "node").groupBy(F.col("comm").alias("node")).agg(F.min("outer").alias("comm")))
        members = written(members.join(refined.select(F.col("node").alias("level"), F.col("comm").alias("up")), "level").select("node", F.col("up").alias("level")))
        graph = written(graph.join(fa, "a").join(fb, "b").groupBy(F.col("fa").alias("a"), F.col("fb").alias("b")).agg(F.sum("w").alias("w")))
    found = written(members.join(part.select(F.col("node").alias("level"), "comm"), "level").select("node", "comm"))
    na, nb = found.select(F.col("node").alias("a"), F.col("comm").alias("ca")), found.select(F.col("node").alias("b"), F.col("comm").alias("cb"))
    linked = components(base.join(na, "a").join(nb, "b").filter("ca = cb and a < b"), "a", "b")
    named = found.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
    return named.join(named.groupBy("community").agg(F.count("*").alias("size")), "community").select("node", "community", "size")
