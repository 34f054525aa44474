"""Neighbour descent, communities and clustering by threshold, against exact and brute-force forms."""

import itertools
import random

import numpy as np
import pytest

from duolex.operators import graphs as G
from duolex.operators import vectors as V

SF = "/root/testdata/sf0.01"


def recall(found, exact):
    best = {}
    for r in exact:
        best.setdefault(r.src, []).append(r.similarity)
    own = {}
    for r in found:
        own.setdefault(r.src, []).append(r.similarity)
    hits = total = 0
    for src, want in best.items():
        worst = min(want) - 1e-9
        hits += min(len(want), sum(s >= worst for s in own.get(src, [])))
        total += len(want)
    return hits / total


def test_neighbours_reach_the_recall_on_the_given_vectors(spark):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as x")
    found = G.neighbours(points, "vec_id", "x", k=10, leaf=64).collect()
    assert recall(found, V.knn(points, "vec_id", "x", k=10, least=-1.0).collect()) >= 0.9
    assert len({(r.src, r.dst) for r in found}) == len(found) and all(r.src != r.dst for r in found)


def test_neighbours_with_a_hub_and_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([np.tile(rng.standard_normal(24), (400, 1)), rng.standard_normal((30, 24))[rng.integers(0, 30, 800)] + 0.3 * rng.standard_normal((800, 24))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = G.neighbours(points, "id", "v", k=8, leaf=64).collect()
    assert recall(found, V.knn(points, "id", "v", k=8, least=-1.0).collect()) >= 0.9
    assert max(np.unique([r.src for r in found], return_counts=True)[1]) <= 8


def test_neighbours_of_few_points(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    got = {(r.src, r.dst): round(r.similarity, 6) for r in G.neighbours(points, "id", "v", k=5, least=0.5).collect()}
    assert got == {(a, b): 0.707107 for a, b in ((1, 3), (3, 1), (2, 3), (3, 2))}
    assert G.neighbours(points.limit(0), "id", "v", k=5).collect() == []
    assert G.neighbours(points.limit(1), "id", "v", k=5).collect() == []


def test_neighbours_ship_little_for_each_point_and_reach_the_recall_with_many_blocks(spark):
    rng = np.random.default_rng(11)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 64)))], "id long, v array<double>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    found = G.neighbours(points, "id", "v", k=10, leaf=256).collect()
    assert 0 < shuffled() - before < 4000 * 30_000
    assert recall(found, V.knn(points, "id", "v", k=10, least=-1.0).collect()) >= 0.9


def test_neighbours_compare_codes_but_return_exact_similarities(spark):
    """Ids are texts; numbers that 4 bytes don't hold, far apart in size, are kept as they are."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 16)) * 10.0 ** rng.integers(-9, 9, (300, 1)) / 3
    points = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = G.neighbours(points, "id", "v", k=6, leaf=64).collect()
    assert recall(found, V.knn(points, "id", "v", k=6, least=-1.0).collect()) >= 0.97
    assert all(abs(r.similarity - u[int(r.src[1:])] @ u[int(r.dst[1:])]) < 1e-11 for r in found)


def quality(edges, part, resolution=1.0):
    double = 2 * sum(w for _, _, w in edges)
    deg, inside = {}, 0.0
    for a, b, w in edges:
        deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
        inside += 2 * w * (part[a] == part[b])
    tot = {}
    for node, d in deg.items():
        tot[part[node]] = tot.get(part[node], 0) + d
    return inside / double - resolution * sum(t * t for t in tot.values()) / double**2


def partitions(n):
    """All partitions of n nodes as restricted growth strings."""

    def grow(part, most):
        if len(part) == n:
            yield part
            return
        for k in range(most + 1):
            yield from grow([*part, k], max(most, k + 1))

    yield from grow([], 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_against_the_best_partition(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(range(8), 2) if rng.random() < (0.8 if a // 4 == b // 4 else 0.2)]
    df = spark.createDataFrame(edges, "source long, target long, similarity double")
    got = G.communities(df)
    part = {r.node: r.community for r in got.collect()}
    nodes = sorted(part)
    best = max(quality(edges, dict(zip(nodes, p))) for p in partitions(len(nodes)))
    assert quality(edges, part) >= 0.98 * best - 1e-12
    assert abs(G.modularity(df, got) - quality(edges, part)) < 1e-9


def test_communities_of_linked_cliques(spark):
    """Six cliques in a ring, given in either direction, with repeats, a loop and an edge without weight; the cliques are found, whatever the order."""
    edges = [(10 * c + i, 10 * c + j, 1.0) for c in range(6) for i, j in itertools.combinations(range(5), 2)] + [(10 * c, (10 * c + 10) % 60 + 1, 1.0) for c in range(6)]
    turned = [(b, a, w) if (a + b) % 2 else (a, b, w) for a, b, w in edges] + [(3, 3, 9.0), (70, 71, 0.0)]
    for rows in (turned, turned[::-1]):
        got = {r.node: (r.community, r.size) for r in G.communities(spark.createDataFrame(rows, "source long, target long, similarity double")).collect()}
        assert got == {10 * c + i: (10 * c, 5) for c in range(6) for i in range(5)}
    assert G.communities(spark.createDataFrame([], "source long, target long, similarity double")).collect() == []


def sequential_dp_means(ids, x, most, iterations=25):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres, before = [x[0]], None
    for _ in range(iterations):
        work, now = list(centres), []
        for v in x:
            far = [1 - float(np.dot(c, v)) for c in work]
            k = int(np.argmin(far))
            if far[k] > most:
                work.append(v)
                k = len(work) - 1
            now.append(k)
        used = sorted(set(now))
        now = [used.index(k) for k in now]
        centres = []
        for k in range(len(used)):
            mean = x[np.array(now) == k].mean(axis=0)
            centres.append(mean / np.linalg.norm(mean))
        if now == before:
            break
        before = now
    return dict(zip(ids, now))


@pytest.mark.parametrize("step,most", [(1, 0.7), (5, 0.4), (2000, 0.2)])
def test_dp_means_equals_the_sequential_form(spark, step, most):
    x = np.random.default_rng(4).standard_normal((60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    got = V.dp_means(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", most, step=step, max_iterations=4).collect()
    want = sequential_dp_means(range(60), x, most, 4)
    assert {r.id: r.cluster for r in got} == want
    assert all(r.size == sum(c == r.cluster for c in want.values()) for r in got)


def test_a_round_of_kmeans_is_one_job(spark):
    """Rows in several files: all tasks of a pass run at once, and the clusters are those of all rows."""
    x = np.random.default_rng(6).standard_normal((400, 3))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, g int, v array<double>").repartition(8)
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    made, settled = [], None
    for rounds in (0, 3, 100):
        before = count()
        settled = V.kmeans(df, "id", "g", "v", {0: 2}, starts=4, rounds=rounds).collect()
        made.append(count() - before)
    assert made[1] - made[0] <= 3
    part = {r.id: r.cluster for r in settled}
    means = [x[[part[i] == k for i in range(400)]].mean(axis=0) for k in (0, 1)]
    assert all(int(np.argmin([((x[i] - m) ** 2).sum() for m in means])) == k for i, k in part.items())
