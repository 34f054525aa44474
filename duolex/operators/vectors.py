"""Vector operators: similarities, neighbour graphs, densities, clusters. Vectors are array<double> columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import seeded_key
from .relational import checkpointed, quantiles, top_per_group, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at length 1; an empty or zero vector is an error."""
    size = F.sqrt(dot(v, v))
    good = F.when(F.coalesce(size, F.lit(0.0)) == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(size)
    return F.transform(v, lambda x: x.cast("double") / good)


#: Bytes of vectors that travel to the tasks at once, at most.
SHARED_BYTES = 256_000_000


def shared_vectors(df: DataFrame, id_col: str, vector: str, most: int = SHARED_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table whose size is checked before it comes to the driver."""
    size = df.agg(F.sum(F.size(vector) * 8).alias("bytes")).first().bytes or 0
    if size > most:
        raise ValueError(f"{size} bytes of vectors at once, {most} are allowed; pass a stated query set by parts")
    rows = df.select(id_col, vector).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


#: Similarities that a task holds at once.
CELLS = 1_000_000


def _blocks(batches: Iterator[pd.DataFrame], id_col: str, vector: str, known: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of some points and their similarities with all known vectors (of length 1), at most about cells at once."""
    block = max(1, cells // max(1, len(known)))
    for batch in batches:
        for lo in range(0, len(batch), block):
            part = batch.iloc[lo : lo + block]
            x = np.stack(part[vector].to_numpy()).astype(np.float64)
            yield part[id_col].to_numpy(), (x / np.linalg.norm(x, axis=1, keepdims=True)) @ known.T


def _against(points: DataFrame, others: DataFrame, id_col: str, vector: str, made: Callable, cells: int) -> DataFrame:
    """id_col, other, similarity: what made gives of the ids of others and the blocks of a task."""
    ids, known = shared_vectors(others, id_col, vector)
    shared = points.sparkSession.sparkContext.broadcast((ids, known / np.linalg.norm(known, axis=1, keepdims=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known = shared.value
        for own, other, similarity in made(ids, _blocks(batches, id_col, vector, known, cells)):
            yield pd.DataFrame({id_col: own, "other": other, "similarity": similarity})

    kind = points.schema[id_col].dataType.simpleString()
    return points.select(id_col, vector).mapInPandas(run, f"{id_col} {kind}, other {kind}, similarity double")


def similarities(points: DataFrame, others: DataFrame, id_col: str, vector: str, least: float = -np.inf, cells: int = CELLS) -> DataFrame:
    """id_col, other, similarity of every point with every row of others, of at least the least similarity, by blocked matrix products.

    others is a stated query set or a label set; it travels to the tasks and
    must be small, which is checked. For more, call it by parts. A task holds
    about `cells` similarities, however many others there are.
    """

    def made(ids: np.ndarray, blocks: Iterator) -> Iterator[tuple]:
        for own, near in blocks:
            i, j = np.nonzero(near >= least)
            yield own[i], ids[j], near[i, j]

    return _against(points, others, id_col, vector, made, cells)


def nearest_points(points: DataFrame, others: DataFrame, id_col: str, vector: str, k: int, cells: int = CELLS) -> DataFrame:
    """id_col, other, similarity (12 digits): the k points nearest to each row of others but itself, ties by id. A task keeps k for each, so that no row is made for a pair."""

    def made(ids: np.ndarray, blocks: Iterator) -> Iterator[tuple]:
        worst = np.full(len(ids), -np.inf)
        held: tuple = ()
        for own, near in blocks:
            near = np.round(near, 12)
            near[own[:, None] == ids[None, :]] = -np.inf
            if len(own) > k:
                worst = np.maximum(worst, np.partition(near, len(own) - k, axis=0)[len(own) - k])
            i, j = np.nonzero((near >= worst) & (near > -np.inf))
            found = own[i], j, near[i, j]
            if held:
                found = tuple(np.concatenate(x) for x in zip(held, found))
            order = np.lexsort((found[0], -found[2], found[1]))
            own_, j, s = (x[order] for x in found)
            first = np.searchsorted(j, np.arange(len(ids)))
            keep = np.arange(len(j)) - first[j] < k
            held = own_[keep], j[keep], s[keep]
            full = np.flatnonzero(np.bincount(held[1], minlength=len(ids)) == k)
            last = np.searchsorted(held[1], full, side="right") - 1
            worst[full] = np.maximum(worst[full], held[2][last])
        if held:
            yield held[0], ids[held[1]], held[2]

    return top_per_group(_against(points, others, id_col, vector, made, cells), ["other"], [F.desc("similarity"), id_col], k).drop("rank")


def near_thresholds(points: DataFrame, others: DataFrame, id_col: str, vector: str, thresholds: tuple[float, ...], within: float, k: int, seed: int, cells: int = CELLS // 4) -> DataFrame:
    """id_col, other, threshold: of the pairs (6 digits) within a distance of their nearest threshold, the first of equals, the k of each that are first by md5 of seed:other:id. A task keeps k for each."""
    import hashlib

    def made(ids: np.ndarray, blocks: Iterator) -> Iterator[tuple]:
        held: dict[int, list] = {t: [] for t in range(len(thresholds))}
        for own, near in blocks:
            away = np.round(np.abs(np.round(near, 6)[:, :, None] - np.array(thresholds)), 9)
            best = away.argmin(axis=2)
            close = (away.min(axis=2) <= within) & (own[:, None] != ids[None, :])
            for t, kept in held.items():
                i, j = np.nonzero(close & (best == t))
                last = kept[-1][0] if len(kept) == k else b"\xff" * 17
                fresh = [(h, a, b) for a, b in zip(ids[j].tolist(), own[i].tolist()) if (h := hashlib.md5(f"{seed}:{a}:{b}".encode()).digest()) < last]
                held[t] = sorted(kept + fresh)[:k]
        rows = [(b, a, thresholds[t]) for t, kept in held.items() for _, a, b in kept]
        if rows:
            yield tuple(zip(*rows))

    found = _against(points, others, id_col, vector, made, cells).withColumnRenamed("similarity", "threshold")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("other").cast("string"), F.col(id_col).cast("string")))
    return top_per_group(found, ["threshold"], [key], k).drop("rank")


def knn(points: DataFrame, id_col: str, vector: str, k: int, least: float, block: int = 8192, cells: int = CELLS) -> DataFrame:
    """src, dst, similarity: each point's k nearest others of at least the least similarity, ties by id; exact, in blocks of points.

    Each two blocks meet once, at one of them, half of the others at each; a
    task keeps the top k of both and holds about `cells` similarities. A window
    keeps the top k of those.
    """
    n = points.count()
    blocks = max(1, -(-n // block))
    packed = points.select(F.col(id_col).alias("id"), normalised(F.col(vector)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    grouped = packed.groupBy("block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat"))
    right = grouped.select(F.col("block").alias("r_block"), F.col("ids").alias("r_ids"), F.col("flat").alias("r_flat"))
    goes = lambda r: (r == F.col("block")) | ((F.col("block") < r) == ((F.col("block") + r) % 2 == 0))
    pairs = grouped.withColumn("r_block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), goes))).join(right, "r_block")

    def top(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> Iterator[pd.DataFrame]:
        step = max(1, cells // len(b))
        for lo in range(0, len(a), step):
            ids = a[lo : lo + step]
            near = np.round(x[lo : lo + step] @ y.T, 12)
            near[(ids[:, None] == b[None, :]) | (near < least)] = -2
            worst = np.partition(near, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(ids), -2.0)
            i, j = np.nonzero((near >= worst[:, None]) & (near > -2))
            order = np.lexsort((b[j], -near[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(ids)))[i] < k
            i, j = i[keep], j[keep]
            yield pd.DataFrame({"src": ids[i], "dst": b[j], "similarity": near[i, j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = np.array(row.ids), np.array(row.r_ids)
                x, y = np.array(row.flat).reshape(len(a), -1), np.array(row.r_flat).reshape(len(b), -1)
                yield from top(a, x, b, y)
                if row.block != row.r_block:
                    yield from top(b, y, a, x)

    kind = points.schema[id_col].dataType.simpleString()
    found = pairs.select("block", "ids", "flat", "r_block", "r_ids", "r_flat").mapInPandas(run, f"src {kind}, dst {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def mutual(edges: DataFrame) -> DataFrame:
    """source < target for edges that both ends have, with the larger similarity."""
    ends = edges.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target"), "similarity")
    return ends.groupBy("source", "target").agg(F.count("*").alias("n"), F.max("similarity").alias("similarity")).filter("n = 2").drop("n")


def nearest_label(points: DataFrame, labels: DataFrame, id_col: str, vector: str, least: float, block: int = 4096) -> DataFrame:
    """Each point's best label (NULL below least, the least id of equals), its similarity and its margin over the runner-up. The two best are found within a block of points, so that no row is made for a pair."""
    ids, known = shared_vectors(labels, id_col, vector)
    order = np.argsort(ids, kind="stable")
    shared = points.sparkSession.sparkContext.broadcast((ids[order], (known / np.linalg.norm(known, axis=1, keepdims=True))[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known = shared.value
        for batch in batches:
            for lo in range(0, len(batch), block):
                part = batch.iloc[lo : lo + block]
                x = np.stack(part[vector].to_numpy()).astype(np.float64)
                near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ known.T
                best = near.argmax(axis=1)
                top = near[np.arange(len(near)), best]
                near[np.arange(len(near)), best] = -np.inf
                second = near.max(axis=1) if len(ids) > 1 else np.full(len(near), np.nan)
                label = pd.Series(ids[best], dtype="object").where(pd.Series(top >= least), None)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "label": label, "similarity": top, "margin": np.where(np.isnan(second), None, top - second)})

    kinds = points.schema[id_col].dataType.simpleString(), labels.schema[id_col].dataType.simpleString()
    return points.select(id_col, vector).mapInPandas(run, f"{id_col} {kinds[0]}, label {kinds[1]}, similarity double, margin double")


def log_density(points: DataFrame, fitted: DataFrame, id_col: str, vector: str, bandwidth: float, out: str, cells: int = CELLS) -> DataFrame:
    """Gaussian kernel log density of each point over a bounded sample of fitted points, whose size is checked, by blocks and log-sum-exp."""
    _, sample = shared_vectors(fitted, id_col, vector)
    shared = points.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = shared.value
        n, d = y.shape
        block = max(1, cells // max(1, n))
        const = -0.5 * d * np.log(2 * np.pi) - d * np.log(bandwidth) - np.log(n)
        for batch in batches:
            values = []
            for lo in range(0, len(batch), block):
                x = np.stack(batch[vector].iloc[lo : lo + block].to_numpy()).astype(np.float64)
                e = -0.5 * np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T) / bandwidth**2
                top = e.max(axis=1)
                values.append(const + top + np.log(np.exp(e - top[:, None]).sum(axis=1)))
            yield pd.DataFrame({id_col: batch[id_col], out: np.concatenate(values) if values else []})

    kind = points.schema[id_col].dataType.simpleString()
    return points.select(id_col, vector).mapInPandas(run, f"{id_col} {kind}, {out} double")


def log1p_exp(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def zones(scored: DataFrame, score: str, group: str, positive: str, negative: str) -> DataFrame:
    """zone: shared by the middle of |score|, hot by the positive group's upper quartile, cold by the negative group's lower one."""
    scored = checkpointed(scored)  # the cuts read it several times
    hot = quantiles(scored.filter(F.col(group) == positive), [], score, (0.75,)).withColumnRenamed("q0", "hot")
    cold = quantiles(scored.filter(F.col(group) == negative), [], score, (0.25,)).withColumnRenamed("q0", "cold")
    near = quantiles(scored.select(F.abs(score).alias(score)), [], score, (0.25,)).withColumnRenamed("q0", "near")
    zone = F.when(F.abs(score) <= F.col("near"), "shared").when(F.col(score) >= F.col("hot"), "hot").when(F.col(score) <= F.col("cold"), "cold").otherwise("between")
    for cut in (hot, cold, near):
        scored = scored.crossJoin(F.broadcast(cut))  # one row
    return scored.withColumn("zone", zone).drop("hot", "cold", "near")


def balanced_sample(df: DataFrame, group: str, candidate: str, key: str, limit: int, seed: int) -> DataFrame:
    """At most limit rows of each group, the first of each candidate before the second of any, in an order by a seeded hash."""
    rows = df.withColumn("__key", seeded_key(seed, F.col(key)))
    turn = F.row_number().over(Window.partitionBy(group, candidate).orderBy("__key"))
    rows = rows.withColumn("__turn", turn).filter(F.col("__turn") <= limit)
    place = F.row_number().over(Window.partitionBy(group).orderBy("__turn", "__key"))
    return rows.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__key", "__turn", "__place")


#: Rows that one step of clustering decides in their order.
DECIDED_ROWS = 2000


def _opened(points: DataFrame, centres: np.ndarray, max_distance: float, step: int) -> tuple[list, np.ndarray]:
    """The rows (id, u) that open a cluster in the order of id: those far from all centres and from all rows before them that open one.

    The first `step` rows that aren't decided are, in order; then all rows near a
    new centre are, in their own tasks. So a step needs few rows in one place,
    and what it opens is what going through all rows one by one would.
    """
    ids, opened, known = [], np.empty((0, 0)), centres
    left = points

    def far(rows: DataFrame, near: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch[(1 - np.stack(batch["u"].to_numpy()) @ near.T).min(axis=1) > max_distance]

        return rows.mapInPandas(run, rows.schema)

    while True:
        left = written(far(left, known)) if len(known) else left
        rows = left.orderBy("id").limit(step).collect()
        if not rows:
            return ids, opened
        fresh: list[np.ndarray] = []
        for r in rows:
            u = np.array(r["u"])
            if not fresh or (1 - np.array(fresh) @ u).min() > max_distance:
                ids.append(r["id"])
                fresh.append(u)
        known = np.array(fresh)
        opened = known if not opened.size else np.vstack([opened, known])
        if opened.nbytes > SHARED_BYTES:
            raise ValueError(f"{len(opened)} clusters; their centres are over {SHARED_BYTES} bytes")


def dp_means(points: DataFrame, id_col: str, vector: str, max_distance: float, max_iterations: int = 25, step: int = DECIDED_ROWS) -> DataFrame:
    """id_col, cluster, similarity, size by cosine DP-means in the order of id.

    A row further than max_distance from every centre opens a cluster, also for
    the rows after it; centres become their rows' means, until no row changes.
    Rows that may open one are proposed in their tasks and validated in order,
    `step` at a time; the result is that of going through the rows one by one.
    Assignments and means are made in the rows' own tasks. The centres travel,
    and their size is checked. An empty table gives no rows, a zero vector is an
    error, ids have no repeats.
    """
    kind = points.schema[id_col].dataType.simpleString()
    own = written(points.select(F.col(id_col).alias("id"), normalised(F.col(vector)).alias("u")))
    first = own.orderBy("id").limit(1).collect()
    if not first:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("size"))
    centres, before = np.array([first[0]["u"]]), None
    for _ in range(max_iterations):
        ids, opened = _opened(own, centres, max_distance, step)
        work = np.vstack([centres, opened]) if len(ids) else centres
        since = np.array(ids)

        def assign(batches: Iterator[pd.DataFrame], work: np.ndarray = work, since: np.ndarray = since, old: int = len(centres)) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    away = 1 - np.stack(batch["u"].to_numpy()) @ work.T
                    if len(since):
                        away[:, old:][since[None, :] > batch["id"].to_numpy()[:, None]] = np.inf
                    yield pd.DataFrame({"id": batch["id"], "u": batch["u"], "c": away.argmin(axis=1)})

        now = written(own.mapInPandas(assign, f"id {kind}, u array<double>, c long"))

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            count: dict[int, int] = {}
            for batch in batches:
                for c, part in batch.groupby("c"):
                    total[c] = total.get(c, 0) + np.stack(part["u"].to_numpy()).sum(axis=0)
                    count[c] = count.get(c, 0) + len(part)
            if total:
                yield pd.DataFrame({"c": list(total), "n": list(count.values()), "s": list(total.values())})

        place = now.mapInPandas(sums, "c long, n long, s array<double>").select("c", "n", F.posexplode("s").alias("k", "x"))
        means = place.groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).groupBy("c").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e.x).alias("s"))
        found = sorted(means.collect())  # a row for each centre
        order = {r["c"]: k for k, r in enumerate(found)}
        sizes, made = [r["n"] for r in found], []
        for r in found:
            size = np.linalg.norm(r["s"])
            made.append(np.array(r["s"]) / size if size else work[r["c"]])
        centres = np.array(made)
        places = np.zeros(len(work), np.int64)
        places[list(order)] = list(order.values())

        def renamed(batches: Iterator[pd.DataFrame], places: np.ndarray = places) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(c=places[batch["c"].to_numpy(np.int64)])

        now = now.mapInPandas(renamed, now.schema)
        same = before is not None and now.alias("a").join(before.alias("b"), "id").filter("a.c <> b.c").isEmpty()
        before = now
        if same:
            break

    def named(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres, sizes: list = sizes) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                c = batch["c"].to_numpy(np.int64)
                near = (np.stack(batch["u"].to_numpy()) * centres[c]).sum(axis=1)
                yield pd.DataFrame({id_col: batch["id"], "cluster": c, "similarity": np.round(near, 12), "size": np.array(sizes)[c]})

    return before.mapInPandas(named, f"{id_col} {kind}, cluster long, similarity double, size long")


#: Different rows of a group, for each cluster, that starts are drawn from.
STARTED_ROWS = 100


def kmeans(points: DataFrame, id_col: str, group: str, vector: str, clusters: dict, starts: int = 20, rounds: int = 100, seed: int = 20) -> DataFrame:
    """id_col, group, cluster, inertia: each group's rows in clusters[group] clusters by their plain vectors, the best of several seeded starts.

    All starts of all groups go through the rows together: a round is one pass
    that adds up each centre's rows in their tasks, all tasks at once. A start
    whose centres moved no more is left out of the next rounds, which end when
    none moves. Starts are drawn, far apart, from STARTED_ROWS different rows
    a cluster in a seeded hash order. Only these and the centres come to the driver: groups x starts x clusters, which
    is small and independent of the rows. Clusters are numbered by their centres'
    coordinates. A group with fewer different rows than clusters has
    fewer; ties go to the first centre.
    """
    own = points.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(vector).alias("v")).filter(F.col("g").isin(*clusters))
    kinds = own.schema["id"].dataType.simpleString(), own.schema["g"].dataType.simpleString()
    most = max(clusters.values(), default=0)
    own = written(own)
    order = top_per_group(own.groupBy("g", "v").agg(F.min("id").alias("id")), ["g"], [seeded_key(seed, F.col("id"))], STARTED_ROWS * most)
    first: dict = {}
    for r in order.orderBy("g", "rank").collect():
        first.setdefault(r["g"], []).append(r["v"])

    def spread_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """Rows at random, far ones from those taken so far likelier (Arthur and Vassilvitskii 2007)."""
        taken = [int(rng.integers(len(x)))]
        while len(taken) < min(k, len(x)):
            d = ((x[:, None, :] - x[taken][None]) ** 2).sum(axis=2).min(axis=1)
            taken.append(int(rng.choice(len(x), p=d / d.sum())))
        return x[taken]

    centres = {g: [spread_centres(np.array(x), clusters[g], np.random.default_rng([seed, s])) for s in range(starts)] for g, x in first.items()}

    def one_pass(centres: dict, live: dict) -> dict:
        """(group, start, cluster): rows, their sum, squared distances, of the starts that are live."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for batch in batches:
                for g, part in batch.groupby("g"):
                    x = np.stack(part["v"].to_numpy())
                    for s in live[g]:
                        c = centres[g][s]
                        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
                        k = d.argmin(axis=1)
                        for j in np.unique(k).tolist():
                            n, total_x, total_d = total.get((g, s, j), (0, 0.0, 0.0))
                            total[g, s, j] = n + int((k == j).sum()), total_x + x[k == j].sum(axis=0), total_d + float(d[k == j, j].sum())
            if total:
                yield pd.DataFrame([(g, s, j, n, x.tolist(), d) for (g, s, j), (n, x, d) in total.items()], columns=["g", "s", "j", "n", "x", "d"])

        found: dict = {}
        for r in own.select("g", "v").mapInPandas(run, f"g {kinds[1]}, s int, j int, n long, x array<double>, d double").collect():  # a few rows from each task
            n, x, d = found.get((r["g"], r["s"], r["j"]), (0, 0.0, 0.0))
            found[r["g"], r["s"], r["j"]] = n + r["n"], x + np.array(r["x"]), d + r["d"]
        return found

    every = {g: list(range(len(own_))) for g, own_ in centres.items()}
    live = every
    for _ in range(rounds):
        found = one_pass(centres, live)
        moved = {g: [np.array([found[g, s, j][1] / found[g, s, j][0] if (g, s, j) in found else c[j] for j in range(len(c))]) for s, c in enumerate(own_)] for g, own_ in centres.items()}
        live = {g: [s for s in live[g] if not np.allclose(centres[g][s], moved[g][s], atol=1e-12)] for g in centres}
        centres = moved
        if not any(live.values()):
            break
    found = one_pass(centres, every)
    best = {}
    for g, starts_ in centres.items():
        inertia = [round(sum(found.get((g, s, j), (0, 0, 0.0))[2] for j in range(len(c))), 12) for s, c in enumerate(starts_)]
        s = int(np.argmin(inertia))
        best[g] = starts_[s][np.lexsort(starts_[s].T[::-1])], inertia[s]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("g"):
                c, inertia = best[g]
                k = ((np.stack(part["v"].to_numpy())[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                yield pd.DataFrame({id_col: part["id"], group: g, "cluster": k, "inertia": inertia})

    return own.mapInPandas(assign, f"{id_col} {kinds[0]}, {group} {kinds[1]}, cluster long, inertia double")


def trustworthiness(original: DataFrame, projected: DataFrame, id_col: str, vector: str, neighbours: int, block: int = 512) -> DataFrame:
    """One row: how far the projection's neighbours are neighbours in the original space; ties by id, distances to 12 digits.

    Ranks need every row's distance to all others. Both tables travel to the
    tasks, whose size is checked; each task ranks its rows in blocks. For a
    large table pass a sample.
    """
    ids, x = shared_vectors(original, id_col, vector)
    ids_p, y = shared_vectors(projected, id_col, vector)
    n = len(ids)
    if n < 3:
        return original.sparkSession.createDataFrame([(1.0,)], "trustworthiness double")
    k = min(neighbours, max(1, (n - 1) // 2))
    order, order_p = np.argsort(ids, kind="stable"), np.argsort(ids_p, kind="stable")
    shared = original.sparkSession.sparkContext.broadcast((x[order], y[order_p]))
    rows = original.sparkSession.range(n).select(F.col("id").cast("int").alias("row"))

    def far(z: np.ndarray, own: np.ndarray) -> np.ndarray:
        d = np.round(np.maximum(0, (z[own] ** 2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * z[own] @ z.T), 12)
        d[np.arange(len(own)), own] = -1
        return d

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = shared.value
        for batch in batches:
            for lo in range(0, len(batch), block):
                own = batch["row"].to_numpy()[lo : lo + block]
                rank = np.empty((len(own), len(x)), np.int64)
                np.put_along_axis(rank, far(x, own).argsort(axis=1, kind="stable"), np.arange(len(x))[None, :], axis=1)  # 0 is the row itself
                near = far(y, own).argsort(axis=1, kind="stable")[:, 1 : k + 1]
                yield pd.DataFrame({"penalty": [float(np.maximum(0, np.take_along_axis(rank, near, axis=1) - k).sum())]})

    penalty = F.coalesce(F.sum("penalty"), F.lit(0.0))
    return rows.mapInPandas(run, "penalty double").agg((1 - penalty * 2.0 / (n * k * (2 * n - 3 * k - 1))).alias("trustworthiness"))


def optional(module: str, message: str):
    """A package that may be missing; the error says what it is for."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as error:
        raise RuntimeError(message) from error


def leiden(points: DataFrame, edges: DataFrame, id_col: str = "id", resolution: float = 1.0, seed: int = 0, least: int = 1, most: int = 5_000_000) -> DataFrame:
    """id_col, community, size, retained (at least least members): Leiden communities of a weighted graph (source, target, similarity). Needs igraph and leidenalg.

    The algorithm moves one vertex at a time, so one task has the graph; more
    than most edges are an error.
    """
    message = "Leiden communities need igraph and leidenalg"
    optional("igraph", message)
    optional("leidenalg", message)
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges in one graph")
    own = points.select(F.col(id_col).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"))
    rows = own.unionByName(edges.select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.col("similarity").cast("double").alias("w")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import igraph
        import leidenalg

        names = sorted(rows.loc[rows["b"].isna(), "a"])
        at = {x: k for k, x in enumerate(names)}
        links = rows[rows["b"].notna()].sort_values(["a", "b"])
        graph = igraph.Graph(n=len(names), edges=[(at[a], at[b]) for a, b in zip(links["a"], links["b"])])
        found = leidenalg.find_partition(graph, leidenalg.RBConfigurationVertexPartition, weights=links["w"].tolist(), resolution_parameter=resolution, seed=seed)
        member = np.array(found.membership)
        size = np.bincount(member, minlength=1)[member]
        return pd.DataFrame({id_col: names, "community": member, "size": size, "retained": size >= least})

    return rows.groupBy().applyInPandas(run, f"{id_col} string, community long, size long, retained boolean")


def umap(points: DataFrame, id_col: str, vector: str, neighbours: int = 15, distance: float = 0.1, metric: str = "cosine", dimensions: int = 2, seed: int = 0, sample: int = 20_000) -> DataFrame:
    """id_col and projected: fitted on at most sample points, in a seeded hash order, on the driver; every point is transformed where it is. Needs umap-learn."""
    module = optional("umap", "a UMAP projection needs umap-learn")
    _, known = shared_vectors(points.orderBy(seeded_key(seed, F.col(id_col)), id_col).limit(sample), id_col, vector)
    model = module.UMAP(n_neighbors=neighbours, min_dist=distance, metric=metric, n_components=dimensions, random_state=seed).fit(known)
    shared = points.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = shared.value.transform(np.stack(batch[vector].to_numpy()).astype(np.float64))
            yield pd.DataFrame({id_col: batch[id_col], "projected": [r.tolist() for r in made]})

    kind = points.schema[id_col].dataType.simpleString()
    return points.select(id_col, vector).mapInPandas(run, f"{id_col} {kind}, projected array<double>")


def encode(texts: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """id_col and vector of every text by a model that load gives, once in each task: a function from texts to rows of numbers. No model comes with this library."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            texts = rows[text_col].fillna("").tolist()
            made = [np.asarray(model(texts[lo : lo + batch]), np.float64) for lo in range(0, len(texts), batch)]
            yield pd.DataFrame({id_col: rows[id_col], "vector": [v.tolist() for part in made for v in part]})

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<double>")


#: Rows whose lines are joined and hashed by one task.
HASHED_ROWS = 10_000


def ordered_hash(df: DataFrame, key: str, *columns: str, rows: int = HASHED_ROWS) -> DataFrame:
    """One row: corpus_hash and n. The lines key:column:... are hashed in key order within ranges of rows whole keys each, then the ranges' hashes in their order; keys are whole numbers."""
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in (key, *columns)))
    part = F.floor(F.col(key) / rows).alias("part")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), line.alias("line")))), lambda x: x.line)
    parts = df.groupBy(part).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"), F.count("*").alias("n"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x.hash)  # one of HASHED_ROWS rows
    return parts.agg(F.sha2(F.array_join(hashes, "\n"), 256).alias("corpus_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def cache_mismatches(told: dict, now: dict) -> list[str]:
    """The fields in which a cache of vectors differs from what it would be made of; it may be used again if there are none."""
    return [k for k in sorted({*told, *now}) if told.get(k) != now.get(k)]


def cached(spark, path: str, now: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The vectors at path if their metadata are now's, else made, written there and read back. The metadata are written last."""
    import json

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    told = jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    known = json.loads(spark.read.text(f"{path}/metadata").first()[0]) if told.getFileSystem(conf).exists(told) else {}
    if cache_mismatches(known, now):
        make().write.mode("overwrite").parquet(f"{path}/vectors")
        spark.createDataFrame([(json.dumps(now, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return spark.read.parquet(f"{path}/vectors")


def selected_threshold(config: dict, name: str) -> float:
    """A threshold of a configuration; it must be set and lie between 0 and 1."""
    value = config.get(name)
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 < value < 1:
        raise ValueError(f"{name} must be a number between 0 and 1, not {value!r}")
    return float(value)
