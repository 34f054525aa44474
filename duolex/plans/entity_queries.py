"""Entity registers and composites: rosters, codes, fingerprints, precedence, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table


@query("""WITH v AS (SELECT o_custkey % 50 AS race, o_custkey AS candidate, max(o_totalprice) AS votes FROM orders GROUP BY ALL), r AS (SELECT race FROM v WHERE candidate % 11 = 0 GROUP BY race), m AS (SELECT race, max(votes) AS top FROM v GROUP BY race)
 SELECT v.race, v.candidate, round(v.votes, 4) AS votes, CASE WHEN votes = top THEN 'Win' ELSE 'Loss' END AS outcome FROM v JOIN m USING (race) WHERE v.race IN (SELECT race FROM r)""")
def roster_winners(spark, sf_dir):
    """A candidate's best count in each race; races with a named candidate only; the race's best wins."""
    v = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("race"), F.col("o_custkey").alias("candidate")).agg(F.max("o_totalprice").alias("votes"))
    races = v.groupBy("race").agg(F.max("votes").alias("top"), F.bool_or(F.col("candidate") % 11 == 0).alias("named")).filter("named")
    return v.join(races, "race").select("race", "candidate", F.round("votes", 4).alias("votes"), F.when(F.col("votes") == F.col("top"), "Win").otherwise("Loss").alias("outcome"))


@query("""SELECT o_custkey, substr(sha256(string_agg(DISTINCT o_orderpriority || ':' || o_orderstatus, '|' ORDER BY o_orderpriority || ':' || o_orderstatus)), 1, 24) AS fingerprint FROM orders GROUP BY o_custkey""")
def race_fingerprints(spark, sf_dir):
    """An id from the sorted members of a group, whatever the rows' order."""
    members = F.array_sort(F.collect_set(F.concat_ws(":", "o_orderpriority", "o_orderstatus")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.substring(F.sha2(F.array_join(members, "|"), 256), 1, 24).alias("fingerprint"))


#: Patterns of codes; a text has a code if exactly one pattern hits.
CODES = (("one", "tion"), ("two", "ung"), ("three", "ment"), ("four", "idad|ción"))


@query(
    "WITH h AS (SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{c}' END" for c, p in CODES)
    + "], lambda x: x IS NOT NULL) AS hits FROM documents) SELECT doc_id, CASE WHEN len(hits) = 1 THEN hits[1] ELSE '' END AS code FROM h"
)
def single_codes(spark, sf_dir):
    low = F.lower("text")
    hits = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(c)) for c, p in CODES)))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("h")).select("doc_id", F.when(F.size("h") == 1, F.col("h")[0]).otherwise("").alias("code"))


@query("""WITH c AS (SELECT p_partkey, '20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || upper(substr(p_type, 1, 2)) || '-' || replace(p_brand, '#', '') AS code FROM part)
 SELECT p_partkey, regexp_extract(code, '^(\\d{4})-([A-Z]{2})-([A-Za-z]+)(\\d+)$', 1) AS year, regexp_extract(code, '^(\\d{4})-([A-Z]{2})-([A-Za-z]+)(\\d+)$', 2) AS state, regexp_extract(code, '^(\\d{4})-([A-Z]{2})-([A-Za-z]+)(\\d+)$', 3) AS office, regexp_extract(code, '^(\\d{4})-([A-Z]{2})-([A-Za-z]+)(\\d+)$', 4) AS district FROM c""")
def race_codes(spark, sf_dir):
    code = F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-"), F.upper(F.substring("p_type", 1, 2)), F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("")))
    p = r"^(\d{4})-([A-Z]{2})-([A-Za-z]+)(\d+)$"
    return table(spark, sf_dir, "part").select("p_partkey", *(F.regexp_extract(code, p, k).alias(n) for k, n in enumerate(("year", "state", "office", "district"), 1)))


@query("""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS part FROM documents) SELECT doc_id, CAST(count(*) AS BIGINT) AS mentions, min(md5(part)) AS first_md5 FROM s WHERE length(part) BETWEEN 25 AND 1200 AND regexp_matches(lower(part), '(^|[^a-z])(license|rights|public)($|[^a-z])') GROUP BY doc_id""")
def mention_parts(spark, sf_dir):
    """Sentences of usable length that hold a pattern."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[.!?]\s+")).alias("part"))
    kept = parts.filter(F.length("part").between(25, 1200) & F.lower("part").rlike("(^|[^a-z])(license|rights|public)($|[^a-z])"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.min(F.md5("part")).alias("first_md5"))


@query("""WITH m AS (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 3 = 0), p AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), h AS (SELECT p_partkey AS k, p_brand AS v FROM part)
 SELECT p_partkey AS k, coalesce(m.v, p.v, h.v) AS v, CASE WHEN m.v IS NOT NULL THEN 'manual' WHEN p.v IS NOT NULL THEN 'processed' ELSE 'hint' END AS origin FROM part LEFT JOIN m ON m.k = p_partkey LEFT JOIN p ON p.k = p_partkey LEFT JOIN h ON h.k = p_partkey""")
def precedence_merge(spark, sf_dir):
    """A register's value by precedence: manual before processed before hint."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("h"))
    m = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("m"))
    p = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("p"))
    origin = F.when(F.col("m").isNotNull(), "manual").when(F.col("p").isNotNull(), "processed").otherwise("hint")
    return base.join(m, "k", "left").join(p, "k", "left").select("k", F.coalesce("m", "p", "h").alias("v"), origin.alias("origin"))


@query("""WITH s AS (SELECT lang, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'endorsed' ELSE 'opponent' END AS grp, quality FROM documents LEFT JOIN labels USING (doc_id)),
 c AS (SELECT lang, count(*) AS documents, count(quality) AS verified, count(*) FILTER (WHERE grp = 'endorsed') AS e, count(*) FILTER (WHERE grp = 'opponent') AS o FROM s GROUP BY lang)
 SELECT lang, CAST(documents AS BIGINT) AS documents, CAST(verified AS BIGINT) AS verified, e > 0 AND o > 0 AS paired, CASE WHEN e = 0 OR o = 0 THEN 'one_sided' WHEN greatest(e, o) > 3.0 * least(e, o) THEN 'imbalanced' ELSE 'ok' END AS balance FROM c""")
def sufficiency_audit(spark, sf_dir):
    grp = F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "endorsed").otherwise("opponent")
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("lang", grp.alias("g"), "quality")
    c = s.groupBy("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("verified"), F.count_if(F.col("g") == "endorsed").alias("e"), F.count_if(F.col("g") == "opponent").alias("o"))
    balance = F.when((F.col("e") == 0) | (F.col("o") == 0), "one_sided").when(F.greatest("e", "o") > 3.0 * F.least("e", "o"), "imbalanced").otherwise("ok")
    return c.select("lang", "documents", "verified", ((F.col("e") > 0) & (F.col("o") > 0)).alias("paired"), balance.alias("balance"))


@query("""WITH t AS (SELECT conv_id, role, turn, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) SELECT conv_id, turn AS left_turn, next_turn AS right_turn FROM t WHERE next_role IS NOT NULL AND next_role <> role""")
def stance_changes(spark, sf_dir):
    """Neighbouring turns of unlike roles: each turn is joined with the one after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("right_turn"))
    return t.filter("next_role is not null and next_role <> role").select("conv_id", F.col("turn").alias("left_turn"), "right_turn")


@query("""SELECT CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) % 10 AS bucket, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_view, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_click FROM events GROUP BY 1""")
def json_pivot(spark, sf_dir):
    """A JSON cell's field as a key, event types as columns."""
    e = table(spark, sf_dir, "events").select((F.from_json("props", "k long")["k"] % 10).alias("bucket"), "event_type")
    return e.groupBy("bucket").agg(F.count_if(F.col("event_type") == "view").alias("n_view"), F.count_if(F.col("event_type") == "click").alias("n_click"))


@query("""WITH t AS (SELECT d.doc_id, lang, quality, CASE WHEN regexp_matches(lower(text), 'tion') THEN 1 ELSE 0 END AS topic FROM documents d JOIN labels USING (doc_id)) SELECT lang, topic, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS mean_quality, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS emphasis FROM t GROUP BY lang, topic""")
def topic_emphasis(spark, sf_dir):
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.lower("text").rlike("tion").cast("int").alias("topic"), "quality")
    c = t.groupBy("lang", "topic").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    totals = c.groupBy("lang").agg(F.sum("n").alias("total"))
    return c.join(totals, "lang").select("lang", "topic", "n", "mean_quality", F.round(F.col("n") / F.col("total"), 6).alias("emphasis"))
