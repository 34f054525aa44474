"""Joins, aggregates and orders that fixed row orders or fallbacks make special, as DataFrame operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The columns of each key's first row; a partial aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("__r")).select(*keys, *(F.col(f"__r.{c}") for c in columns))


def last_per_key(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, *(F.col(f"__r.{c}") for c in columns))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, value: str, grain: int | None = None) -> DataFrame:
    """left with the value of each key's latest right row whose since is not after at; NULL without one. Null keys and times meet nothing.

    One union and one running window over both sides: linear in the rows, no
    range join. With keys of many rows, grain (units of at) cuts a key's rows
    into spans; what a span carries over comes from a small table of the spans'
    last values.
    """
    a = left.withColumn("__at", F.col(at)).withColumn("__kind", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    b = right.dropna(subset=[*keys, since]).select(*keys, F.col(since).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__value"))
    rows = a.unionByName(b, allowMissingColumns=True)
    if grain is None:
        carried = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__at", "__kind", "__value").rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(value, carried).filter("__kind = 1").drop("__at", "__kind", "__value")
    rows = rows.withColumn("__span", F.floor(F.col("__at") / grain))
    inside = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys, "__span").orderBy("__at", "__kind", "__value").rowsBetween(Window.unboundedPreceding, 0))
    ends = b.withColumn("__span", F.floor(F.col("__at") / grain)).groupBy(*keys, "__span").agg(F.max_by("__value", F.struct("__at", "__value")).alias("__end"))
    spans = rows.select(*keys, "__span").distinct().join(ends, [*keys, "__span"], "left")
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.withColumn("__before", before).drop("__end")
    made = rows.withColumn("__inside", inside).filter("__kind = 1").join(carried, [*keys, "__span"], "left")
    return made.withColumn(value, F.coalesce("__inside", "__before")).drop("__at", "__kind", "__value", "__span", "__inside", "__before")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, grain: int) -> DataFrame:
    """Pairs of intervals [lo, hi] of equal keys that overlap: both are put in bins of width grain and joined by bin, each pair in its first common bin only."""
    bins = F.sequence(F.floor(F.col(lo) / grain), F.floor(F.col(hi) / grain))
    a = left.withColumn("__bin", F.explode(bins))
    b = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(f"r_{lo}") / grain), F.floor(F.col(f"r_{hi}") / grain))))
    meet = (F.col(lo) <= F.col(f"r_{hi}")) & (F.col(f"r_{lo}") <= F.col(hi)) & (F.col("__bin") == F.floor(F.greatest(lo, f"r_{lo}") / grain))
    return a.join(b, [*keys, "__bin"]).filter(meet).drop("__bin")


def match_either(left: DataFrame, right: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Inner join on the first or the second keys as two equi-joins, each pair once; right's keys don't come along."""
    keys = [*dict.fromkeys([*first, *second])]
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})

    def on(names: list[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({f"__{k}": k for k in names})
        return left.join(renamed, names)

    both = F.lit(True)
    for k in first:
        if k not in second:
            both = both & F.col(k).eqNullSafe(F.col(f"__{k}"))
    one, two = on(first), on(second).filter(~both)
    drop = [f"__{k}" for k in keys]
    return one.drop(*drop).unionByName(two.drop(*drop))


def fallback(left: DataFrame, right: DataFrame, first: list[str], second: list[str], order: str, value: str) -> DataFrame:
    """left with the value that the first keys find, else the second keys; the last row wins for a key."""
    by_first = last_per_key(right, first, order, value).withColumnRenamed(value, "__a")
    by_second = last_per_key(right, second, order, value).withColumnRenamed(value, "__b")
    return left.join(by_first, first, "left").join(by_second, second, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def mode_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value, the least of equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(value), F.max("__n").alias("n"))


def unanimous(df: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """The value of the rows with the least priority if they agree, else NULL."""
    return df.groupBy(*keys, priority).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).groupBy(*keys).agg(
        F.min_by(F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")), priority).alias(value)
    )


#: Values of a list that rows are completed with, at most.
SPINE_ROWS = 100_000


def completed(df: DataFrame, spine: list[DataFrame], keys: list[str]) -> DataFrame:
    """A row for each combination of the spine's values; counts are 0 where df has none. The spine's tables but the first are lists of values, whose length is checked."""
    grid = spine[0]
    for other in spine[1:]:
        if other.limit(SPINE_ROWS + 1).count() > SPINE_ROWS:
            raise ValueError(f"more than {SPINE_ROWS} values in a list")
        grid = grid.crossJoin(F.broadcast(other))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.join(counts, keys, "left").fillna(0, ["n"])


def round_robin(df: DataFrame, bucket: str, order: list[Column | str], limit: int) -> DataFrame:
    """The first of each bucket, then the second of each, until limit rows."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("turn", rank).filter(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark keeps only k rows of a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def scratch_folder(spark) -> str:
    """The session's checkpoint folder, which all executors share. A local session without one gets a temporary folder."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="duolex-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """df written in scratch_folder and read from there, so that its lineage ends."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in scratch_folder and read from there. For loops: what the optimizer knows of a checkpoint's plan (constraints) stays with it and grows with each round; a table's ends."""
    path = f"{scratch_folder(df.sparkSession)}/duolex-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """node, component (its least node) by min-label propagation with pointer jumping; checkpointed each round, until nothing changes."""
    both = checkpointed(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct())
    roots = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        up = roots.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = roots.join(near, "node").join(up, "component", "left")
        after = checkpointed(after.select("node", F.least("component", "near", F.coalesce("up", "component")).alias("component"), F.col("component").alias("was")))
        roots = after.drop("was")
        if after.filter("component <> was").isEmpty():
            return roots


def quantiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """keys and q0, q1, ...: the exact quantiles of each group, between neighbouring values by their distance.

    An approximate quantile within 1 / accuracy of the rows brackets each; only
    what lies in the brackets is ranked, after the rows below are counted. No
    task holds a group's values.
    """
    own = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    edges = [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 / accuracy, 2 / accuracy)]
    bounds = own.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", edges, accuracy).alias("__e"))
    bounds = checkpointed(bounds.select(*keys, "__n", *(F.col("__e")[2 * k + j].alias(f"__{n}{k}") for k in range(len(shares)) for j, n in enumerate(("lo", "hi")))))

    def match(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # one row

    joined = match(own, bounds)
    ks, v = range(len(shares)), F.col("__v")
    outside = joined.groupBy(*keys).agg(*(f for k in ks for f in (
        F.count_if(v < F.col(f"__lo{k}")).alias(f"__below{k}"), F.max(F.when(v < F.col(f"__lo{k}"), v)).alias(f"__before{k}"), F.min(F.when(v > F.col(f"__hi{k}"), v)).alias(f"__after{k}"),
    )))
    inside = checkpointed(joined.filter(" or ".join(f"__v between __lo{k} and __hi{k}" for k in ks)).groupBy(*keys, "__v").agg(F.count("*").alias("__c")))
    rows, made = match(inside, checkpointed(match(bounds, outside))), None
    for k, s in enumerate(shares):
        upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")) + F.col(f"__below{k}")
        ranked = rows.filter(v.between(F.col(f"__lo{k}"), F.col(f"__hi{k}"))).withColumn("__upto", upto).withColumn("__at", (F.col("__n") - 1) * F.lit(s))

        def at(place: Column, k: int = k) -> Column:
            found = F.coalesce(F.min(F.when(F.col("__upto") > place, v)), F.max(f"__after{k}"))
            return F.when(F.max(place) < F.max(f"__below{k}"), F.max(f"__before{k}")).otherwise(found)

        low, high = at(F.floor("__at")), at(F.ceil("__at"))
        own = ranked.groupBy(*keys).agg((low + (high - low) * F.max(F.col("__at") - F.floor("__at"))).alias(f"q{k}"))
        made = own if made is None else match(made, own)
    return made


def best_pairs(df: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """keys, left_key, right_key: the first unordered pair of each group, rows of unlike kinds before like ones, then by order.

    The first pair is the least row with the least one of another kind, or the
    two least rows where all are of a kind. So no other pair is formed.
    """

    def two_least(rows: DataFrame, column: str) -> DataFrame:
        least = top_per_group(rows.select(*keys, column), keys, [column], 2)
        return least.groupBy(*keys).agg(F.min(column).alias("l"), F.max(column).alias("r"), F.count("*").alias("n")).filter("n = 2")

    any_ = two_least(df, order)
    unlike = two_least(df.groupBy(*keys, kind).agg(F.min(order).alias("one")), "one").select(*keys, F.col("l").alias("ul"), F.col("r").alias("ur"))
    return any_.join(unlike, keys, "left").select(*keys, F.coalesce("ul", "l").alias("left_key"), F.coalesce("ur", "r").alias("right_key"))


def longest_first(rows: list[tuple[str, int]], batches: int) -> dict[str, int]:
    """Each item's batch: items by falling size, each to the lightest batch so far. Sequential; meant for work lists."""
    import heapq

    heap, out = [(0, k) for k in range(batches)], {}
    for name, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        load, k = heapq.heappop(heap)
        out[name] = k
        heapq.heappush(heap, (load + size, k))
    return out
