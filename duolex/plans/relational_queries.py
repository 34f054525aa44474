"""Joins, aggregates, windows, orders and set operations over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from .registry import query, table

# ---- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lookup_join(spark, sf_dir):
    """Left lookup in which a missing match is an error."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey", "left")
    missing = F.raise_error(F.concat(F.lit("unknown order "), F.col("l_orderkey").cast("string")))
    return rows.withColumn("o_orderstatus", F.when(F.col("o_orderstatus").isNull(), missing).otherwise(F.col("o_orderstatus")))


@query("SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def optional_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce(T.blank_to_null(F.col("c_mktsegment")), F.lit("none")).alias("segment"))


@query("""WITH r AS (SELECT o_custkey AS k1, o_orderpriority AS k2, o_orderkey, o_orderstatus FROM orders), a AS (SELECT k1, k2, max_by(o_orderstatus, o_orderkey) AS v FROM r GROUP BY ALL), b AS (SELECT k1, max_by(o_orderstatus, o_orderkey) AS v FROM r GROUP BY ALL),
 c AS (SELECT c_custkey AS k1, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS k2 FROM customer) SELECT c.k1 AS custkey, coalesce(a.v, b.v) AS status FROM c LEFT JOIN a USING (k1, k2) LEFT JOIN b ON c.k1 = b.k1""")
def fallback_lookup(spark, sf_dir):
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k1"), F.col("o_orderpriority").alias("k2"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k1"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("k2"))
    return R.fallback(left, right, ["k1", "k2"], ["k1"], "o_orderkey", "status").select(F.col("k1").alias("custkey"), "status")


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50 OR c_custkey = s_suppkey""")
def either_key_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("m"), F.col("c_custkey").alias("same"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("m"), F.col("s_suppkey").alias("same"))
    return R.match_either(left, right, ["nation", "m"], ["same"]).select("c_custkey", "s_suppkey")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS topic, o_orderkey, o_orderstatus AS stance FROM orders), p AS (SELECT a.o_custkey, a.topic, a.o_orderkey AS left_key, b.o_orderkey AS right_key,
 row_number() OVER (PARTITION BY a.o_custkey, a.topic ORDER BY CASE WHEN a.stance <> b.stance THEN 0 ELSE 1 END, a.o_orderkey, b.o_orderkey) AS rn FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.topic = b.topic AND a.o_orderkey < b.o_orderkey) SELECT o_custkey, topic, left_key, right_key FROM p WHERE rn = 1""")
def pair_within_group(spark, sf_dir):
    """The best unordered pair of each group: rows of unlike stance first."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("topic"), "o_orderkey", "o_orderstatus")
    return R.best_pairs(orders, ["o_custkey", "topic"], "o_orderkey", "o_orderstatus")


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0 AND count(*) FILTER (WHERE event_type = 'error') > 0")
def two_sided_existence(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.filter("purchases > 0 and errors > 0")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


AS_OF_SQL = """WITH v AS (SELECT user_id, epoch(ts)::BIGINT AS since, event_id FROM events WHERE event_type = 'signup' OR event_type = 'click'), e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS at FROM events WHERE event_type = 'purchase')
 SELECT e.event_id AS purchase_id, coalesce((SELECT max_by(v.event_id, (v.since, v.event_id)) FROM v WHERE v.user_id = e.user_id AND v.since <= e.at), -1) AS event_id FROM e"""


def seconds(ts):
    """Whole seconds since 1970, the nearest one, halves to the even one (as SQL's cast of a fraction)."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def _as_of(spark, sf_dir, grain):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds(F.col("ts")).alias("at"))
    left = e.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase_id"))
    right = e.filter("event_type in ('signup', 'click')").select("user_id", F.col("at").alias("since"), "event_id")
    return R.as_of(left, right, ["user_id"], "at", "since", "event_id", grain).select("purchase_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


@query(AS_OF_SQL)
def asof_carry_forward(spark, sf_dir):
    return _as_of(spark, sf_dir, None)


@query(AS_OF_SQL)
def asof_in_spans(spark, sf_dir):
    """The same for keys with very many rows: spans of a week, whose last values are carried over."""
    return _as_of(spark, sf_dir, 7 * 86400)


@query("SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'undated' WHEN CAST(o_orderdate AS DATE) BETWEEN make_date(1996, 1, 1) AND make_date(1997, 6, 30) THEN 'in' ELSE 'out' END AS window_class FROM orders")
def window_class(spark, sf_dir):
    """Window from January 1 of the year before to the election day."""
    day = F.col("o_orderdate").cast("date")
    election = F.make_date(F.lit(1997), F.lit(6), F.lit(30))
    inside = day.between(F.make_date(F.year(election) - 1, F.lit(1), F.lit(1)), election)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(day.isNull(), "undated").when(inside, "in").otherwise("out").alias("window_class"))


@query("""WITH i AS (SELECT l_suppkey, l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT // 86400 AS lo, epoch(l_shipdate)::BIGINT // 86400 + CAST(l_quantity AS BIGINT) % 7 AS hi FROM lineitem)
 SELECT a.l_orderkey AS left_order, a.l_linenumber AS left_line, b.l_orderkey AS right_order, b.l_linenumber AS right_line FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.lo <= b.hi AND b.lo <= a.hi AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber)""")
def range_overlap(spark, sf_dir):
    day = F.floor(seconds(F.col("l_shipdate")) / 86400)
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", day.alias("lo"), (day + F.col("l_quantity").cast("long") % 7).alias("hi"))
    both = R.overlapping(i, i, ["l_suppkey"], "lo", "hi", grain=16)
    both = both.filter("l_orderkey < r_l_orderkey or (l_orderkey = r_l_orderkey and l_linenumber < r_l_linenumber)")
    return both.select(F.col("l_orderkey").alias("left_order"), F.col("l_linenumber").alias("left_line"), F.col("r_l_orderkey").alias("right_order"), F.col("r_l_linenumber").alias("right_line"))


SQL_MEMBERS = "x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT a.o AS o, b.o AS p, count(*) AS n FROM x a JOIN x b ON a.p = b.p AND a.o <> b.o GROUP BY ALL)"


@query(f"WITH {SQL_MEMBERS} SELECT o AS left_order, p AS right_order, CAST(n AS BIGINT) AS shared FROM n WHERE o < p AND n >= 2")
def set_overlap_join(spark, sf_dir):
    """Orders that share members of two sets, joined on the pairs of an order's members, so that only orders with two in common meet."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set("l_partkey").alias("s"))  # an order's lines
    one = sets.select("o", F.explode("s").alias("p"), "s").select("o", "p", F.explode(F.filter("s", lambda q: q > F.col("p"))).alias("q"))
    two = one.select(F.col("o").alias("right_order"), "p", "q")
    n = one.withColumnRenamed("o", "left_order").join(two, ["p", "q"]).filter("left_order < right_order").groupBy("left_order", "right_order").agg(F.count("*").alias("n"))
    # n members' pairs: shared * (shared - 1) / 2
    return n.select("left_order", "right_order", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("shared"))


@query(f"WITH {SQL_MEMBERS} SELECT o AS order_key, min_by(p, (-n, p)) AS best, CAST(max(n) AS BIGINT) AS overlap FROM n GROUP BY o")
def best_overlap(spark, sf_dir):
    return best_other(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("m")))


#: Members of a set, of those that it shares by twos, up to which the subsets that it shares are made (at most 1,023).
FEW_MEMBERS = 10


def best_other(rows, few: int = FEW_MEMBERS):
    """order_key, best, overlap: for every order the other one with most members in common, ties by its key.

    Orders with equal sets are one class, named by its least order. What two
    classes share is a subset of both, so each shared subset keeps its two
    least classes, and no pair of classes is formed. Subsets grow by a member at
    a time, only from those that another class has too: a subset of a shared
    one is shared. Sets with more than `few` members in shared pairs are
    compared by these pairs instead: each is counted against the classes that
    have one, in both directions.
    """
    sets = rows.filter("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sort_array(F.collect_set(F.col("m").cast("bigint"))).alias("s"))
    sets = R.checkpointed(sets.filter(F.size("s") > 0))
    classes = R.checkpointed(sets.groupBy("s").agg(F.min("order_key").alias("c"), F.count("*").alias("n")))
    copies = R.checkpointed(sets.join(classes.filter("n > 1"), "s").filter("order_key > c").select("order_key", "c", F.size("s").cast("long").alias("n")))
    found = copies.groupBy("c").agg(F.max("n").alias("n"), F.min("order_key").alias("p"))

    def shared(made):
        """made (c, t): the rows whose t other classes have too, with the least of them."""
        least = made.groupBy("t").agg(F.min("c").alias("p0"), F.max("c").alias("last")).filter("p0 < last").drop("last")
        return R.checkpointed(made.join(least, "t"))

    def least_others(own):
        n = F.size("t").cast("long").alias("n")
        second = own.groupBy("t", "p0").agg(F.min(F.when(F.col("c") > F.col("p0"), F.col("c"))).alias("p"))
        return own.filter("c > p0").select("c", n, F.col("p0").alias("p")).unionByName(second.select(F.col("p0").alias("c"), n, "p"))

    one = shared(classes.select("c", F.explode("s").alias("t")).select("c", F.array("t").alias("t")))
    found = found.unionByName(least_others(one))
    ms = F.sort_array(F.collect_list(F.col("t")[0]))
    twos = F.flatten(F.transform("ms", lambda a: F.transform(F.filter("ms", lambda b: b > a), lambda b: F.array(a, b))))
    own = shared(one.groupBy("c").agg(ms.alias("ms")).select("c", F.explode(twos).alias("t")))
    big = R.checkpointed(own.groupBy("c").agg(F.size(F.array_distinct(F.flatten(F.collect_list("t")))).alias("active")).filter(F.col("active") > few).select("c"))
    if not big.isEmpty():
        met = own.join(big, "c").select(F.col("c").alias("big"), "t").join(own.select("c", "t"), "t").filter("big <> c").groupBy("big", "c").agg(F.count("*").alias("k"))
        # n members' pairs: n * (n - 1) / 2
        met = R.checkpointed(met.select("big", "c", F.round((1 + F.sqrt(1 + 8 * F.col("k"))) / 2).cast("long").alias("n")))
        found = found.unionByName(met.select(F.col("big").alias("c"), "n", F.col("c").alias("p"))).unionByName(met.select("c", "n", F.col("big").alias("p")))
        own = own.join(big, "c", "left_anti")
    while True:
        found = found.unionByName(least_others(own))
        head, last = lambda t: F.slice(t, 1, F.size(t) - 1), lambda t: F.element_at(t, -1)
        longer = F.flatten(F.transform("ts", lambda t: F.transform(F.filter("ts", lambda u: (head(u) == head(t)) & (last(u) > last(t))), lambda u: F.concat(t, F.array(last(u))))))
        own = shared(own.groupBy("c").agg(F.collect_list("t").alias("ts")).filter(F.size("ts") > 2).select("c", F.explode(longer).alias("t")))
        if own.isEmpty():
            break
    best = R.checkpointed(found.filter("p is not null").groupBy("c").agg(F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("best"), F.max("n").alias("overlap")))
    # a copy's best is the class's least order, or what that one has found if it is less
    others = copies.drop("n").join(best, "c").select("order_key", F.least("c", "best").alias("best"), "overlap")
    return best.withColumnRenamed("c", "order_key").unionByName(others)


@query("""WITH y AS (SELECT unnest(range(1995, 1999)) AS year), c AS (SELECT n_nationkey, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
 SELECT n.n_nationkey, y.year, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM nation n CROSS JOIN y LEFT JOIN c ON c.n_nationkey = n.n_nationkey AND c.year = y.year""")
def grid_completion(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("year"))
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    return R.completed(rows, [table(spark, sf_dir, "nation").select("n_nationkey"), spark.range(1995, 1999).withColumnRenamed("id", "year")], ["n_nationkey", "year"])


@query("""WITH k AS (SELECT c_custkey, lower(split_part(c_name, '#', 1)) AS given, CAST(CAST(split_part(c_name, '#', 2) AS BIGINT) % 300 AS VARCHAR) AS last FROM customer), s AS (SELECT s_suppkey, 'customer' AS given, CAST(s_suppkey % 300 AS VARCHAR) AS last FROM supplier)
 SELECT c_custkey, s_suppkey FROM k JOIN s USING (given, last)""")
def name_key_join(spark, sf_dir):
    """Names match on derived given and last keys, an equi-join instead of a pairwise test."""
    parts = F.split("c_name", "#")
    k = table(spark, sf_dir, "customer").select("c_custkey", F.lower(parts[0]).alias("given"), (parts[1].cast("long") % 300).cast("string").alias("last"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("customer").alias("given"), (F.col("s_suppkey") % 300).cast("string").alias("last"))
    return k.join(s, ["given", "last"]).select("c_custkey", "s_suppkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 60 + 1000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT u.b, r.seen FROM r JOIN u ON u.a = r.node) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def alias_components(spark, sf_dir):
    """Rows linked by a shared alias merge transitively."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 60 + 1000).alias("b")).distinct()
    return R.components(e, "a", "b")


@query("""WITH last AS (SELECT o_custkey, max_by(year(o_orderdate), o_orderkey) AS cycle FROM orders GROUP BY 1) SELECT coalesce(CAST(cycle AS VARCHAR), 'unknown') AS cycle, CAST(count(*) AS BIGINT) AS n FROM customer LEFT JOIN last ON c_custkey = o_custkey GROUP BY 1""")
def last_assignment(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.year("o_orderdate"), "o_orderkey").cast("string").alias("cycle"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").groupBy(F.coalesce("cycle", F.lit("unknown")).alias("cycle")).agg(F.count("*").alias("n"))


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT (l_partkey, l_suppkey)) AS BIGINT) AS parts, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY ALL")
def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("parts"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_per_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return R.last_per_key(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "value")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmax_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM c) WHERE rn = 1")
def mode_tiebreak(spark, sf_dir):
    return R.mode_value(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("WITH m AS (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) SELECT o.o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND o.o_orderpriority = m.p GROUP BY 1")
def unanimous_value(spark, sf_dir):
    return R.unanimous(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus")


@query("""WITH r AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS k, l_linestatus, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem), b AS (SELECT l_orderkey, min(k) AS k FROM r GROUP BY 1)
 SELECT r.l_orderkey, array_to_string(list_sort(list_distinct(list(s))), ' | ') AS suppliers, CAST(max(r.k) AS INTEGER) AS status_rank FROM r JOIN b USING (l_orderkey, k) GROUP BY 1""")
def ranked_merge(spark, sf_dir):
    """Only rows at a group's best status give values; the values are joined. Collected by status first, so one shuffle does."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    by_rank = table(spark, sf_dir, "lineitem").select("l_orderkey", rank.alias("k"), F.col("l_suppkey").cast("string").alias("s")).groupBy("l_orderkey", "k").agg(T.joined_distinct(F.col("s")).alias("suppliers"))
    return by_rank.groupBy("l_orderkey").agg(F.min_by("suppliers", "k").alias("suppliers"), F.min("k").alias("status_rank"))


@query("SELECT user_id, min_by(event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END) AS worst, bool_and(event_type <> 'error') AS clean FROM events GROUP BY user_id")
def worst_status(spark, sf_dir):
    order = F.create_map(*(F.lit(x) for k, v in enumerate(("error", "purchase", "signup", "click", "view")) for x in (v, k)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", order[F.col("event_type")]).alias("worst"), F.bool_and(F.col("event_type") != "error").alias("clean"))


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ' | ') AS types, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def distinct_join(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(T.joined_distinct(F.col("p_type")).alias("types"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name AS v, s_acctbal AS bal, 2 AS prio FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, 1 FROM customer WHERE c_custkey <= 200)
 SELECT k, min(prio) AS prio, round(max(bal), 6) AS bal, min_by(v, (prio, v)) AS name, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY k""")
def upsert_merge(spark, sf_dir):
    """Field-wise merge of two sources: best priority, largest number, first name, rows."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.col("s_acctbal").alias("bal"), F.lit(2).alias("prio"))
    c = table(spark, sf_dir, "customer").filter("c_custkey <= 200").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.col("c_acctbal").alias("bal"), F.lit(1).alias("prio"))
    return s.unionByName(c).groupBy("k").agg(F.min("prio").alias("prio"), F.round(F.max("bal"), 6).alias("bal"), F.min_by("v", F.struct("prio", "v")).alias("name"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS domain, min(o_orderstatus) AS prio, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, domain FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY prio, n DESC, domain) AS rn FROM c) WHERE rn = 1""")
def domain_vote(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("domain")).agg(F.min("o_orderstatus").alias("prio"), F.count("*").alias("n"))
    return c.groupBy("o_custkey").agg(F.min_by("domain", F.struct("prio", -F.col("n"), "domain")).alias("domain"))


@query("""WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), g AS (SELECT min(n) AS lo, max(n) AS hi, count(*) AS k FROM t)
 SELECT 'languages' AS gate, k >= 4 AS passed FROM g UNION ALL SELECT 'balance', hi <= 3.0 * lo FROM g UNION ALL SELECT 'labelled', (SELECT count(*) FROM labels) > 0""")
def gates(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))
    own = n.select(F.explode(F.array(F.struct(F.lit("languages").alias("gate"), (F.col("k") >= 4).alias("passed")), F.struct(F.lit("balance").alias("gate"), (F.col("hi") <= 3.0 * F.col("lo")).alias("passed")))).alias("g")).select("g.*")
    return own.unionByName(table(spark, sf_dir, "labels").agg((F.count("*") > 0).alias("passed")).select(F.lit("labelled").alias("gate"), "passed"))


@query("""WITH e AS (SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
 SELECT c_custkey, CASE WHEN n = 0 THEN 'unsearched' WHEN f > 0 AND o > 0 THEN 'verified' WHEN f > 0 THEN 'archived' WHEN o > 0 THEN 'live' ELSE 'undated' END AS status FROM e""")
def coverage_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count("*").alias("n"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "unsearched").when((F.col("f") > 0) & (F.col("o") > 0), "verified").when(F.col("f") > 0, "archived").when(F.col("o") > 0, "live").otherwise("undated")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("""WITH s AS (SELECT l.doc_id, n_chars / 1000.0 AS score, quality = 1 AS positive FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0]) AS threshold),
 c AS (SELECT threshold, CAST(count(*) FILTER (WHERE positive AND score >= threshold) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT positive AND score >= threshold) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE NOT positive AND score < threshold) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE positive AND score < threshold) AS DOUBLE) AS fn FROM s, t GROUP BY threshold)
 SELECT threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS rec, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS spec, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced FROM c""")
def threshold_metrics(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select((F.col("n_chars") / 1000.0).alias("score"), (F.col("quality") == 1).alias("positive"))
    t = s.select(F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0, 8.0)))).alias("threshold"), "score", "positive")
    over, yes = F.col("score") >= F.col("threshold"), F.col("positive")
    c = t.groupBy("threshold").agg(F.count_if(yes & over).alias("tp"), F.count_if(~yes & over).alias("fp"), F.count_if(~yes & ~over).alias("tn"), F.count_if(yes & ~over).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return c.select("threshold", F.round(ratio("tp", "fp"), 6).alias("prec"), F.round(ratio("tp", "fn"), 6).alias("rec"), F.round(ratio("tn", "fp"), 6).alias("spec"), F.round((ratio("tp", "fn") + ratio("tn", "fp")) / 2, 6).alias("balanced"))


@query("""WITH v AS (SELECT user_id AS pair, event_type AS label, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, label) AS rn, lead(n) OVER (PARTITION BY pair ORDER BY n DESC, label) AS next FROM v)
 SELECT pair, CASE WHEN n >= 2 AND n > coalesce(next, 0) THEN label ELSE 'review' END AS label FROM r WHERE rn = 1""")
def vote_majority(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pair"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    votes = v.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("v"))  # a few labels
    lead = (-F.col("v")[0].m >= 2) & (-F.col("v")[0].m > F.when(F.size("v") > 1, -F.get("v", F.lit(1)).m).otherwise(0))
    return votes.select("pair", F.when(lead, F.col("v")[0].label).otherwise("review").alias("label"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement, CAST(count(*) FILTER (WHERE quality = toxic) AS BIGINT) AS disagree FROM labels")
def agreement_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("double")), 6).alias("agreement"), F.count_if(F.col("quality") == F.col("toxic")).alias("disagree"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts FROM c GROUP BY user_id""")
def counts_as_json(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("SELECT md5(text) AS source, CAST(count(DISTINCT source) AS BIGINT) AS holders FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def shared_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("source_key"), "source").agg(F.count("*")).groupBy(F.col("source_key").alias("source")).agg(F.count("*").alias("holders")).filter("holders > 1")


@query("WITH q AS (SELECT o_custkey, o_orderpriority FROM orders GROUP BY ALL) SELECT o_custkey FROM q GROUP BY 1 HAVING count(*) = 5")
def in_all_slices(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).filter("n = 5").select("o_custkey")


# ---- windows and orders --------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY turn, event_type) AS BIGINT) AS place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 100")
def round_robin_sample(spark, sf_dir):
    picked = R.round_robin(table(spark, sf_dir, "events"), "event_type", [F.md5(F.col("event_id").cast("string")), "event_id"], 100)
    return picked.select("event_id", F.row_number().over(Window.orderBy("turn", "event_type")).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(spark, sf_dir):
    return R.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, round(max(o_totalprice) FILTER (WHERE rn = 1), 4) AS best, round(max(o_totalprice) FILTER (WHERE rn = 2), 4) AS second, round(max(o_totalprice) FILTER (WHERE rn = 1) - max(o_totalprice) FILTER (WHERE rn = 2), 4) AS margin FROM r GROUP BY 1")
def top_two_margin(spark, sf_dir):
    top = R.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)
    one, two = F.max(F.when(F.col("rank") == 1, F.col("o_totalprice"))), F.max(F.when(F.col("rank") == 2, F.col("o_totalprice")))
    return top.groupBy("o_custkey").agg(F.round(one, 4).alias("best"), F.round(two, 4).alias("second"), F.round(one - two, 4).alias("margin"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type")
def quantile_cutoffs(spark, sf_dir):
    made = R.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", (0.25, 0.5, 0.75))
    return made.select("event_type", *(F.round(f"q{k}", 6).alias(n) for k, n in enumerate(("q25", "q50", "q75"))))


@query("SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_user, round(value / sum(value) OVER (PARTITION BY user_id), 8) AS share FROM events")
def group_total_share(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    totals = e.groupBy("user_id").agg(F.count("*").alias("n_user"), F.sum("value").alias("total"))
    return e.join(totals, "user_id").select("user_id", "event_id", "n_user", F.round(F.col("value") / F.col("total"), 8).alias("share"))


@query("WITH s AS (SELECT o_orderkey, o_custkey, (CASE WHEN o_orderpriority LIKE '1%' THEN 50 WHEN o_orderpriority LIKE '2%' THEN 30 ELSE 10 END) + (CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END) AS score FROM orders), g AS (SELECT o_custkey, max(score) + least(count(*) - 1, 24) AS group_score FROM s GROUP BY 1) SELECT o_custkey, CAST(group_score AS BIGINT) AS group_score FROM g ORDER BY group_score DESC, o_custkey LIMIT 200")
def priority_rank(spark, sf_dir):
    score = F.when(F.col("o_orderpriority").startswith("1"), 50).when(F.col("o_orderpriority").startswith("2"), 30).otherwise(10) + F.when(F.col("o_orderstatus") == "O", 20).otherwise(0)
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max(score) + F.least(F.count("*") - 1, F.lit(24))).cast("long").alias("group_score"))
    return g.orderBy(F.desc("group_score"), "o_custkey").limit(200)


@query("WITH g AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1 ORDER BY m DESC, o_custkey LIMIT 25) SELECT o_orderkey, o_custkey FROM orders JOIN g USING (o_custkey)")
def limit_by_group(spark, sf_dir):
    """The limit counts groups; all rows of the chosen groups stay."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).orderBy(F.desc("m"), "o_custkey").limit(25).select("o_custkey")
    return o.join(F.broadcast(g), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT sign, event_id FROM (SELECT event_id, CASE WHEN value >= 50 THEN 1 ELSE -1 END AS sign, row_number() OVER (PARTITION BY value >= 50 ORDER BY abs(round(value - 50, 6)) DESC, event_id) AS rn FROM events WHERE abs(value - 50) >= 0.005) WHERE rn <= 10")
def head_per_sign(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("abs(value - 50) >= 0.005").withColumn("sign", F.when(F.col("value") >= 50, 1).otherwise(-1))
    return R.top_per_group(e, ["sign"], [F.desc(F.abs(F.round(F.col("value") - 50, 6))), "event_id"], 10).select("sign", "event_id")


@query("WITH f AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, event_id FROM f ORDER BY event_id LIMIT 20")
def distinct_pick(spark, sf_dir):
    f = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return f.orderBy("event_id").limit(20)


@query("WITH s AS (SELECT lang, doc_id, text, len(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words FROM documents) SELECT lang, max_by(doc_id, (least(words, 40), -doc_id)) AS doc_id FROM s GROUP BY lang")
def representative_pick(spark, sf_dir):
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct(F.least(words, F.lit(40)).alias("w"), (-F.col("doc_id")).alias("d"))).alias("doc_id"))


@query()
def lpt_batches(spark, sf_dir):
    """Longest processing time first: the work list of part types is small, so the driver deals it."""
    sizes = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).collect()
    dealt = R.longest_first([(r.p_type, r.n) for r in sizes], 4)
    return spark.createDataFrame(sorted(dealt.items()) or [], "p_type string, batch int")


# ---- sets ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS BIGINT) AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind")))


@query("SELECT coalesce(s.k, c.k) AS k, coalesce(s.v, c.v) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer) c FULL JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) s ON s.k = c.k")
def later_source_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).alias("o"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.lit(1).alias("o"))
    return R.last_per_key(c.unionByName(s), ["k"], "o", "v")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersection(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a")).filter("r and a").select("l_partkey")


@query("SELECT c_custkey AS k, 'seed' AS origin FROM customer WHERE c_custkey <= 50 UNION ALL SELECT s_suppkey, 'added' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey <= 50)")
def seed_union(spark, sf_dir):
    seed = table(spark, sf_dir, "customer").filter("c_custkey <= 50").select(F.col("c_custkey").alias("k"), F.lit("seed").alias("origin"))
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("added").alias("origin"))
    return seed.unionByName(more.join(seed, "k", "left_anti"))
