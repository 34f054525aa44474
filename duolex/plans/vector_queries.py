"""Vectors of the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import vectors as V
from ..operators.relational import top_per_group
from .registry import query, table

SQL_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS s FROM v)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {SQL_V} SELECT vec_id, round(s, 6) AS length, round(x[1] / s, 6) AS first FROM u")
def normalised_vectors(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("u", V.normalised(F.col("x")))
    return p.select("vec_id", F.round(F.sqrt(V.dot(F.col("x"), F.col("x"))), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


@query(f"WITH {SQL_V} SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.x, b.x) / (a.s * b.s), 5) AS similarity FROM u a, u b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND list_dot_product(a.x, b.x) / (a.s * b.s) >= 0.2")
def cosine_pairs(spark, sf_dir):
    """Every vector against the query set of ids divisible by 100."""
    p = points(spark, sf_dir)
    s = V.similarities(p, p.filter("vec_id % 100 = 0"), "vec_id", "x", least=0.2).filter("vec_id <> other")
    return s.select(F.col("other").alias("vec_id"), F.col("vec_id").alias("other"), F.round("similarity", 5).alias("similarity"))


@query(f"""WITH {SQL_V}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.x, b.x) / (a.s * b.s), 12) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM p WHERE sim >= 0.1)
 SELECT least(src, dst) AS source, greatest(src, dst) AS target, round(max(sim), 5) AS similarity FROM k WHERE rn <= 5 GROUP BY 1, 2 HAVING count(*) = 2""")
def knn_mutual(spark, sf_dir):
    edges = V.mutual(V.knn(points(spark, sf_dir), "vec_id", "x", k=5, least=0.1))
    return edges.select("source", "target", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH {SQL_V}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.x, b.x) / (a.s * b.s), 12) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
 SELECT src, dst, round(sim, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 10""")
def nearest_of_queries(spark, sf_dir):
    """The ten nearest of each vector of the query set, exact: what the neighbour graph is measured against."""
    p = points(spark, sf_dir)
    top = V.nearest_points(p, p.filter("vec_id % 100 = 0"), "vec_id", "x", 10)
    return top.select(F.col("other").alias("src"), F.col("vec_id").alias("dst"), F.round("similarity", 5).alias("similarity"))


@query()
def neighbour_graph(spark, sf_dir):
    """About the ten nearest of every vector, by neighbour descent."""
    return G.neighbours(points(spark, sf_dir), "vec_id", "x", k=10)


@query(f"""WITH {SQL_V}, t AS (SELECT * FROM u WHERE vec_id < 10), p AS (SELECT a.vec_id, t.vec_id AS lab, list_dot_product(a.x, t.x) / (a.s * t.s) AS sim FROM u a, t), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, lab) AS rn FROM p)
 SELECT vec_id, coalesce(max(lab) FILTER (WHERE rn = 1 AND sim >= 0.2), -1) AS label, round(max(sim) FILTER (WHERE rn = 1), 5) AS similarity, round(max(sim) FILTER (WHERE rn = 1) - max(sim) FILTER (WHERE rn = 2), 5) AS margin FROM r GROUP BY vec_id""")
def nearest_topic(spark, sf_dir):
    p = points(spark, sf_dir)
    made = V.nearest_label(p, p.filter("vec_id < 10"), "vec_id", "x", least=0.2)
    return made.select("vec_id", F.coalesce("label", F.lit(-1)).alias("label"), F.round("similarity", 5).alias("similarity"), F.round("margin", 5).alias("margin"))


#: Rows of each group that densities are fitted on at most.
FITTED = 5000
SQL_KDE = f"""{SQL_V}, q AS (SELECT vec_id, label, label % 2 AS g, x[1:4] AS y FROM v), h AS (SELECT *, substr(sha256('1729:' || vec_id), 1, 16) AS k FROM q), t AS (SELECT *, row_number() OVER (PARTITION BY g, label ORDER BY k) AS turn FROM h),
 f AS (SELECT vec_id, g, y FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn, k) AS place FROM t) WHERE place <= {FITTED}), d AS (SELECT q.vec_id, f.g AS fg, sum(exp(-0.5 * list_distance(q.y, f.y) ** 2 / 0.09)) AS k, count(*) AS n FROM q, f GROUP BY ALL),
 l AS (SELECT vec_id, fg, ln(k) - ln(n) - 2 * ln(2 * pi()) - 4 * ln(0.3) AS ld FROM d), s AS (SELECT q.vec_id, q.g, ln(1 + exp(max(ld) FILTER (WHERE fg = 0))) - ln(1 + exp(max(ld) FILTER (WHERE fg = 1))) AS score FROM q JOIN l USING (vec_id) GROUP BY q.vec_id, q.g)"""


def density_scores(spark, sf_dir):
    """Every vector's two log densities, fitted on a balanced sample of FITTED rows of each group."""
    q = points(spark, sf_dir).select("vec_id", "label", (F.col("label") % 2).alias("g"), F.slice("x", 1, 4).alias("y"))
    fitted = V.balanced_sample(q, "g", "label", "vec_id", FITTED, 1729)
    a = V.log_density(q, fitted.filter("g = 0"), "vec_id", "y", 0.3, "d0")
    b = V.log_density(q, fitted.filter("g = 1"), "vec_id", "y", 0.3, "d1")
    return q.drop("y", "label").join(a, "vec_id").join(b, "vec_id").select("vec_id", "g", (V.log1p_exp(F.col("d0")) - V.log1p_exp(F.col("d1"))).alias("score"))


@query("""WITH h AS (SELECT vec_id, label % 2 AS g, label, substr(sha256('7:' || vec_id), 1, 16) AS k FROM embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY g, label ORDER BY k) AS turn FROM h)
 SELECT g, label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn, k) AS place FROM t) WHERE place <= 40""")
def balanced_sample(spark, sf_dir):
    """Forty rows of each group, taken from its labels in turn."""
    return V.balanced_sample(points(spark, sf_dir).select((F.col("label") % 2).alias("g"), "label", "vec_id"), "g", "label", "vec_id", 40, 7)


@query(f"WITH {SQL_KDE} SELECT vec_id, round(score, 5) AS score FROM s")
def density_ratio(spark, sf_dir):
    return density_scores(spark, sf_dir).select("vec_id", F.round("score", 5).alias("score"))


@query(f"""WITH {SQL_KDE}, c AS (SELECT quantile_cont(score, 0.75) FILTER (WHERE g = 0) AS hot, quantile_cont(score, 0.25) FILTER (WHERE g = 1) AS cold, quantile_cont(abs(score), 0.25) AS near FROM (SELECT g, round(score, 9) AS score FROM s)) SELECT CASE WHEN abs(round(score, 9)) <= near THEN 'shared' WHEN round(score, 9) >= hot THEN 'hot' WHEN round(score, 9) <= cold THEN 'cold' ELSE 'between' END AS zone, CAST(count(*) AS BIGINT) AS n FROM s, c GROUP BY 1""")
def density_zones(spark, sf_dir):
    scored = density_scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return V.zones(scored, "score", "g", 0, 1).groupBy("zone").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT count(*) AS n, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v),
 h AS (SELECT *, power(n, -2.0 / 6) AS f FROM m), g AS (SELECT i, j, x0 + (x1 - x0) * i / 9.0 AS gx, y0 + (y1 - y0) * j / 9.0 AS gy, f * a AS a, f * b AS b, f * c AS c, n FROM h, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j))
 SELECT i, j, round(sum(exp(-0.5 * (c * (gx - x) ** 2 - 2 * b * (gx - x) * (gy - y) + a * (gy - y) ** 2) / (a * c - b * b))) / (max(n) * 2 * pi() * sqrt(max(a * c - b * b))), 5) AS density FROM g, v GROUP BY i, j""")
def kde_grid(spark, sf_dir):
    """A 10 x 10 grid's Gaussian density with Scott's bandwidth; the grid is fixed, so only the points grow."""
    v = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    m = v.agg(F.count("*").alias("n"), F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("c"), *(f(k).alias(f"{k}{e}") for k in "xy" for e, f in (("0", F.min), ("1", F.max))))
    f = F.pow("n", F.lit(-2.0 / 6))
    steps = F.explode(F.sequence(F.lit(0), F.lit(9)))
    g = m.select("n", "x0", "x1", "y0", "y1", (f * F.col("a")).alias("a"), (f * F.col("b")).alias("b"), (f * F.col("c")).alias("c"), steps.alias("i")).select("*", steps.alias("j"))
    g = g.withColumn("dx0", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / 9.0).withColumn("dy0", F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("j") / 9.0)
    dx, dy, det = F.col("dx0") - F.col("x"), F.col("dy0") - F.col("y"), F.col("a") * F.col("c") - F.col("b") * F.col("b")
    e = F.exp(-0.5 * (F.col("c") * dx * dx - 2 * F.col("b") * dx * dy + F.col("a") * dy * dy) / det)
    made = v.crossJoin(F.broadcast(g)).groupBy("i", "j").agg(F.sum(e).alias("k"), F.max("n").alias("n"), F.max(F.sqrt(det)).alias("s"))  # 100 rows
    return made.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(F.col("k") / (F.col("n") * 2 * F.pi() * F.col("s")), 5).alias("density"))


@query("WITH t AS (SELECT label + 2 AS dim, round(avg(embedding[1]::DOUBLE), 6) AS t FROM embeddings GROUP BY label) SELECT min(dim) AS dimension FROM t WHERE (SELECT max(t) FROM t) - t <= 0.005")
def dim_elbow(spark, sf_dir):
    """The least dimension within 0.005 of the best."""
    t = points(spark, sf_dir).groupBy((F.col("label") + 2).alias("dim")).agg(F.round(F.avg(F.col("x")[0]), 6).alias("t"))
    return t.crossJoin(F.broadcast(t.agg(F.max("t").alias("m")))).filter("m - t <= 0.005").agg(F.min("dim").alias("dimension"))  # one row


@query("WITH m AS (SELECT avg(embedding[1]::DOUBLE) AS m, stddev_pop(embedding[1]::DOUBLE) AS s FROM embeddings) SELECT vec_id, round((embedding[1]::DOUBLE - m) / s, 5) AS z FROM embeddings, m")
def standard_scale(spark, sf_dir):
    v = points(spark, sf_dir).select("vec_id", F.col("x")[0].alias("x"))
    m = v.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return v.crossJoin(F.broadcast(m)).select("vec_id", F.round((F.col("x") - F.col("m")) / F.col("s"), 5).alias("z"))  # one row


@query(f"""WITH {SQL_V}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.x, b.x) / (a.s * b.s), 6) AS score FROM u a JOIN u b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id), n AS (SELECT *, CASE WHEN round(abs(score - 0.0), 9) <= round(abs(score - 0.1), 9) AND round(abs(score - 0.0), 9) <= round(abs(score - 0.2), 9) THEN 0.0 WHEN round(abs(score - 0.1), 9) <= round(abs(score - 0.2), 9) THEN 0.1 ELSE 0.2 END AS near FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY md5('7:' || a || ':' || b)) AS rn FROM n WHERE round(abs(score - near), 9) <= 0.03) SELECT a, b, CAST(near AS DOUBLE) AS threshold FROM r WHERE rn <= 10""")
def threshold_sample(spark, sf_dir):
    """Pairs of the query set (ids divisible by 100) with all rows near each threshold (ties to the lower one), at most ten of each by a seeded hash."""
    p = points(spark, sf_dir)
    close = V.near_thresholds(p, p.filter("vec_id % 100 = 0"), "vec_id", "x", (0.0, 0.1, 0.2), 0.03, 10, 7)
    return close.select(F.col("other").alias("a"), F.col("vec_id").alias("b"), "threshold")


@query("SELECT vec_id FROM embeddings ORDER BY md5('1729:' || vec_id), vec_id LIMIT 50")
def hash_sample(spark, sf_dir):
    """A sample without replacement by a seeded hash order."""
    return points(spark, sf_dir).orderBy(F.md5(F.concat(F.lit("1729:"), F.col("vec_id").cast("string"))), "vec_id").limit(50).select("vec_id")


@query("WITH p AS (SELECT vec_id // 10000 AS part, sha256(string_agg(vec_id || ':' || label, chr(10) ORDER BY vec_id)) AS h, count(*) AS n FROM embeddings GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY part)) AS corpus_hash, CAST(sum(n) AS BIGINT) AS n FROM p")
def cache_metadata(spark, sf_dir):
    """What a cache of vectors is checked by: hashes of rows in order, over ranges of ids."""
    return V.ordered_hash(points(spark, sf_dir), "vec_id", "label")


@query()
def dp_means(spark, sf_dir):
    return V.dp_means(points(spark, sf_dir), "vec_id", "x", max_distance=0.9)


@query()
def kmeans_regions(spark, sf_dir):
    """One region for each 350 vectors and group, two at most, the best of twenty starts, with its size, mean and rank by its strength."""
    p = points(spark, sf_dir).withColumn("grp", (F.col("label") % 2).cast("int"))
    sizes = {r["grp"]: r["count"] for r in p.groupBy("grp").count().collect()}  # two groups
    found = V.kmeans(p, "vec_id", "grp", "x", {g: max(1, min(2, n // 350)) for g, n in sizes.items()}).join(p.select("vec_id", "x"), "vec_id")
    mean = F.avg(F.col("x")[0])
    made = found.groupBy("grp", F.col("cluster").alias("region")).agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean"), (F.abs(mean) * F.sqrt(F.count("*"))).alias("strength"), F.round(F.max("inertia"), 6).alias("inertia"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("strength"), "region"))  # two rows each
    return made.withColumn("rank", rank.cast("long")).drop("strength")


#: Rows that a projection is judged on at most.
JUDGED = 1000


@query(f"""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings ORDER BY md5('1729:' || vec_id), vec_id LIMIT {JUDGED}), d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.x, b.x) ** 2, 12) AS dx, round(list_distance(a.x[1:2], b.x[1:2]) ** 2, 12) AS dy FROM p a JOIN p b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dx, b) AS rx, row_number() OVER (PARTITION BY a ORDER BY dy, b) AS ry FROM d), n AS (SELECT count(*) AS n, least(10, greatest(1, (count(*) - 1) // 2)) AS k FROM p)
 SELECT round(1 - sum(greatest(rx - k, 0)) * 2.0 / (max(n) * max(k) * (2 * max(n) - 3 * max(k) - 1)), 6) AS trustworthiness FROM r, n WHERE ry <= k""")
def projection_trust(spark, sf_dir):
    """How far the first two coordinates keep the neighbours, on a sample in a seeded hash order."""
    p = points(spark, sf_dir).orderBy(F.md5(F.concat(F.lit("1729:"), F.col("vec_id").cast("string"))), "vec_id").limit(JUDGED)
    made = V.trustworthiness(p.select("vec_id", "x"), p.select("vec_id", F.slice("x", 1, 2).alias("x")), "vec_id", "x", 10)
    return made.select(F.round("trustworthiness", 6).alias("trustworthiness"))
