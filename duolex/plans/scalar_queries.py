"""Scalar functions, URLs, pages, validation and ledgers over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import audit as A
from ..operators import ledger as L
from ..sources.fetch import CHALLENGE_BYTES, CHALLENGES, challenged
from .registry import query, spread, table

# ---- identities, hashes, dates, lists -------------------------------------------------------------------------------


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha256(c_name || chr(10) || c_mktsegment), 1, 24) AS id FROM customer")
def slugs_and_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"), T.stable_hash(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS identity FROM benchmark")
def identity_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalised(F.col("text")).alias("identity"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'unknown' END AS s FROM orders)
 SELECT o_orderkey, coalesce(CAST(try_cast(CASE WHEN length(s) = 4 THEN s || '-01-01' WHEN length(s) = 7 AND s <> 'unknown' THEN s || '-01' ELSE s END AS DATE) AS VARCHAR), '') AS day FROM d""")
def date_coercion(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, day).when(k == 1, F.substring(day, 1, 7)).when(k == 2, F.substring(day, 1, 4)).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.to_date(s).cast("string"), F.lit("")).alias("day"))


@query("SELECT event_id, coalesce(try_cast(regexp_extract(props, '(\\d+)', 1) AS BIGINT), 0) AS k, event_type IN ('purchase', 'signup') AS wanted FROM events")
def coercions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_type").isin("purchase", "signup"), " TRUE ").otherwise("no")
    return e.select("event_id", T.to_int(F.regexp_extract("props", r"(\d+)", 1)).alias("k"), T.to_bool(flag).alias("wanted"))


@query("SELECT p_partkey, p_type || ' | ' || p_brand || CASE WHEN p_name NOT IN (p_type, p_brand) THEN ' | ' || p_name ELSE '' END AS joined FROM part")
def list_cells(spark, sf_dir):
    """Pipe lists merged without repeats in the order in which they are first seen."""
    merged = T.joined_first_seen(F.col("p_type"), F.concat_ws(" | ", "p_brand", F.lit(""), "p_type", "p_brand"), F.concat(F.lit(" "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", merged.alias("joined"))


@query("WITH b AS (SELECT o_orderpriority AS grp, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) SELECT grp, CAST(i AS INT) AS i, round(lo + (hi - lo) * i / 8.0, 6) AS x FROM b, range(9) t(i)")
def linear_grid(spark, sf_dir):
    """Nine evenly spaced values over the range of each group."""
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    grid = ends.select("grp", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    return grid.select("grp", "i", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(8.0), 6).alias("x"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g')) AS BIGINT) AS n, CAST(len(regexp_extract_all(text, '(19|20)[0-9][0-9]')) AS BIGINT) AS years FROM documents")
def sanitise_and_years(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.without_controls(F.col("text"))).cast("long").alias("n"), F.size(F.regexp_extract_all("text", F.lit("(19|20)[0-9][0-9]"), F.lit(0))).cast("long").alias("years"))


@query("""WITH m AS (SELECT doc_id, text, strpos(text, '@') AS pos FROM documents WHERE strpos(text, '@') > 0) SELECT doc_id, (CASE WHEN pos - 1 > 80 THEN '...' ELSE '' END) || trim(regexp_replace(substr(text, greatest(0, pos - 81) + 1, least(length(text), pos + 110) - greatest(0, pos - 81)), '\\s+', ' ', 'g')) || (CASE WHEN pos + 110 < length(text) THEN '...' ELSE '' END) AS excerpt FROM m""")
def excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", "@")).filter("at > 0")
    return d.select("doc_id", T.excerpt(F.col("text"), F.col("at") - 1, F.col("at")).alias("excerpt"))


@query("SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', 1) AS name, regexp_extract(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', 2) AS host FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')")
def structured_leads(spark, sf_dir):
    p = r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)"
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")) & F.col("text").rlike(p))
    return d.select("doc_id", F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).alias("host"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'menu|log ?in|subscribe|home|search') AS navigation FROM conversations")
def navigation_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").rlike("menu|log ?in|subscribe|home|search").alias("navigation"))


@query()
def sentences(spark, sf_dir):
    """Sentences with abbreviation rules, a scanner over the characters that SQL can't express. Documents without any have 0."""
    from ..sources.segment import with_sentences

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_sentences(spread(docs), "doc_id", "text").select("doc_id", "place")
    return found.unionByName(docs.select("doc_id"), allowMissingColumns=True).groupBy("doc_id").agg(F.count("place").alias("n"))


@query()
def segments_packed(spark, sf_dir):
    """Analysis segments: sentences packed to between 20 and 80 tokens."""
    from ..sources.segment import packed_segments

    return packed_segments(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


# ---- URLs and pages ------------------------------------------------------------------------------------------------

SQL_RAW = "(url || CASE page_id % 3 WHEN 0 THEN '?utm_source=x&b=2&a=1' WHEN 1 THEN '//x/?ref=y#top' ELSE '' END)"
SQL_PATH = "regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
SQL_HOST = "lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1))"


def raw_urls(spark, sf_dir):
    k = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").withColumn("raw", F.concat("url", F.when(k == 0, "?utm_source=x&b=2&a=1").when(k == 1, "//x/?ref=y#top").otherwise("")))


@query(
    f"""WITH r AS (SELECT page_id, {SQL_RAW} AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || {SQL_HOST.format(u="u")} || {SQL_PATH.format(u="u")} AS base, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS q FROM r),
 k AS (SELECT page_id, regexp_replace(base, '/+$', '') AS base, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({", ".join(f"'{t}'" for t in U.TRACKING)}))), '&') AS q FROM p)
 SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM k"""
)
def url_canonical(spark, sf_dir):
    return raw_urls(spark, sf_dir).select("page_id", U.canonical(F.col("raw")).alias("canonical"))


@query(f"SELECT regexp_replace({SQL_HOST.format(u='url')}, '^www\\.', '') AS domain, CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '/(news|press)') THEN 'press_release' WHEN regexp_matches(lower(url), '/(issue|polic|platform)') THEN 'policy_page' WHEN regexp_matches({SQL_HOST.format(u="url")}, '\\.gov$') THEN 'official' ELSE 'campaign_page' END AS source_type, CASE WHEN regexp_matches({SQL_HOST.format(u="url")}, '\\.gov$|\\.us$') THEN 'official' WHEN regexp_matches({SQL_HOST.format(u="url")}, 'elections?|vote|sos\\.|clerk') OR regexp_matches(lower({SQL_PATH.format(u="url")}), '/(elections?|results|canvass)') THEN 'marker' ELSE 'none' END AS authority FROM pages""")
def url_class(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.source_type(F.lit(None).cast("string"), F.col("url")).alias("source_type"), U.authority(F.col("url")).alias("authority"))


@query("SELECT page_id, 'https://web.archive.org/web/20200101000000/' AS archive, url AS live FROM pages")
def archive_split(spark, sf_dir):
    a = F.concat(F.lit("https://web.archive.org/web/20200101000000/"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(a, U.ARCHIVED, 1).alias("archive"), U.live(a).alias("live"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, coalesce(list_sort(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))[1], '') AS first_link, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.coalesce(F.array_min(links), F.lit("")).alias("first_link"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


SQL_BARE = "regexp_replace(html, '(?is)" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg")) + "|<!--.*?-->|<!doctype[^>]*>', ' ', 'g')"
SQL_LINES = rf"regexp_replace(regexp_replace({SQL_BARE}, '(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|table|section|article|header|footer|nav|main|title|body|head|html)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
SQL_PLAIN = f"""replace(replace(replace(replace(replace(replace({SQL_LINES}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')"""


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({SQL_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query()
def html_parsed(spark, sf_dir):
    """Block-structured text, title and links by a parser."""
    from ..sources.extract import parse_pages

    return parse_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html")


SQL_MARKED = "(CASE WHEN page_id % 5 = 0 THEN '<head><TITLE>Just a moment...</title>' WHEN page_id % 5 = 1 THEN '<script src=\"/cdn/cf-chl-x.js\">' WHEN page_id % 5 = 2 THEN 'solve a captcha' ELSE '' END || html)"


@query(f"SELECT page_id, {' OR '.join(f'strpos(lower(substr({SQL_MARKED}, 1, {CHALLENGE_BYTES})), {chr(39)}{c}{chr(39)}) > 0' for c in CHALLENGES)} AS challenged FROM pages")
def access_challenge(spark, sf_dir):
    k = F.col("page_id") % 5
    mark = F.when(k == 0, "<head><TITLE>Just a moment...</title>").when(k == 1, '<script src="/cdn/cf-chl-x.js">').when(k == 2, "solve a captcha").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", challenged(F.concat(mark, "html")).alias("challenged"))


# ---- validation ----------------------------------------------------------------------------------------------------


@query("SELECT 'error' AS severity, 'duplicate o_custkey' AS rule, CAST(o_custkey AS VARCHAR) AS row_key, CAST(count(*) AS VARCHAR) AS detail FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return A.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT 'error' AS severity, 'o_custkey unknown' AS rule, CAST(o_orderkey AS VARCHAR) AS row_key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def fk_violations(spark, sf_dir):
    return A.missing_parent(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0"), "c_custkey")


@query("SELECT 'error' AS severity, 'event_type outside its domain' AS rule, CAST(event_id AS VARCHAR) AS row_key, event_type AS detail FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')")
def enum_violations(spark, sf_dir):
    return A.outside_domain(table(spark, sf_dir, "events"), "event_id", "event_type", ["view", "click", "purchase", "signup"])


@query("SELECT 'error' AS severity, 'o_orderdate after l_shipdate' AS rule, CAST(l_orderkey AS VARCHAR) AS row_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS detail FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) > CAST(l_shipdate AS DATE)")
def temporal_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"))
    return A.not_after(l.join(o, "l_orderkey"), "l_orderkey", "o_orderdate", "l_shipdate")


@query("SELECT 'error' AS severity, 'several o_orderstatus' AS rule, CAST(o_custkey AS VARCHAR) AS row_key, min(o_orderstatus) || ' | ' || max(o_orderstatus) AS detail FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus)")
def single_value_violations(spark, sf_dir):
    return A.several_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT 'error' AS severity, 'label outside its domain' AS rule, user_id || '/' || event_id AS row_key, event_type AS detail FROM events WHERE event_type NOT IN ('view', 'click', 'error', 'signup')""")
def annotation_violations(spark, sf_dir):
    return A.annotation_errors(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["view", "click", "error", "signup"])


@query("""WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'odd' ELSE 'accept' END AS decision FROM supplier) SELECT 'error' AS severity, 'unknown id' AS rule, CAST(k AS VARCHAR) AS row_key, decision AS detail FROM r WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 11 AND 120)
 UNION ALL SELECT 'error', 'decision outside its domain', CAST(k AS VARCHAR), decision FROM r WHERE decision <> 'accept' UNION ALL SELECT 'error', 'no review', CAST(c_custkey AS VARCHAR), '' FROM customer WHERE c_custkey BETWEEN 11 AND 120 AND c_custkey NOT IN (SELECT k FROM r)""")
def review_violations(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").filter("c_custkey between 11 and 120").select(F.col("c_custkey").alias("k"))
    reviewed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, "odd").otherwise("accept").alias("decision"))
    return A.review_errors(expected, reviewed, "k", "decision", ["accept"])


@query("SELECT 'error' AS severity, 'conflict' AS rule, CAST(s_suppkey AS VARCHAR) AS row_key, 'nation' AS detail FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_nationkey <> c_nationkey")
def conflict_violations(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return A.conflicting(a, b, "k", ["nation"])


@query("SELECT 'error' AS severity, 'n_regionkey with fewer than 6 rows' AS rule, CAST(n_regionkey AS VARCHAR) AS row_key, CAST(count(*) AS VARCHAR) AS detail FROM nation GROUP BY n_regionkey HAVING count(*) < 6 UNION ALL SELECT 'error', 'blank field', CAST(n_nationkey AS VARCHAR), 'n_name' FROM nation WHERE trim(n_name) = ''")
def group_size_and_blank_violations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return A.report(A.small_groups(n, "n_regionkey", 6), A.blank_fields(n, "n_nationkey", ["n_name"]))


# ---- ledgers -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_custkey % 7 = 0")
def keyed_replacement(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = old.filter("o_custkey % 7 = 0").withColumn("o_orderstatus", F.lit("new"))
    return L.replace_keys(old, new, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT starts_with(p_brand, 'Brand#1') UNION ALL SELECT s_suppkey, 'Brand#1new' FROM supplier")
def prefix_replacement(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit("Brand#1new").alias("p_brand"))
    return L.replace_prefixed(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), new, "p_brand", "Brand#1")


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS tries, bool_or(value >= 98) AS done, max_by(CASE WHEN value < 50 THEN 'Remote end closed connection' ELSE 'bad page' END, event_id) AS last FROM events GROUP BY ALL), q AS (SELECT DISTINCT user_id, t AS event_type FROM events, (SELECT unnest(['view', 'click', 'error', 'never']) AS t))
 SELECT user_id || '/' || event_type AS job, CAST(coalesce(tries, 0) AS BIGINT) AS tries FROM q LEFT JOIN a USING (user_id, event_type) WHERE tries IS NULL OR (NOT done AND tries < 40 AND last LIKE 'Remote%') ORDER BY 2, 1 LIMIT 100""")
def attempts_ledger(spark, sf_dir):
    """The next jobs to try: never tried, or a transient last error and not yet 40 tries."""
    e = table(spark, sf_dir, "events")
    job = lambda kind: F.concat_ws("/", F.col("user_id").cast("string"), kind)
    error = F.when(F.col("value") < 50, "Remote end closed connection").when(F.col("value") < 98, "bad page")
    queue = e.select("user_id").distinct().select(F.explode(F.array(*(job(F.lit(k)) for k in ("view", "click", "error", "never")))).alias("job"))
    tried = e.select(job(F.col("event_type")).alias("job"), error.alias("error"), F.col("event_id").alias("at"))
    return L.due(queue, tried, "job", most=40, limit=100).select("job", F.col("tries").cast("long").alias("tries"))


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'kept' ELSE 'open' END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def status_preservation(spark, sf_dir):
    rebuilt = table(spark, sf_dir, "customer").select("c_custkey", F.lit("open").alias("status"))
    prior = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("kept").alias("status"))
    return L.keep_status(rebuilt, prior, "c_custkey", ["status"])


@query("""WITH s AS (SELECT user_id, event_id % 1000 AS job, count(*) FILTER (WHERE event_type = 'view') AS live, count(*) FILTER (WHERE event_type = 'error') AS arch FROM events GROUP BY ALL) SELECT user_id || '/' || job AS job, CASE WHEN live = 0 THEN 'live' WHEN arch = 0 THEN 'archive' ELSE 'none' END AS next_stage FROM s""")
def staged_retries(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "live").when(F.col("event_type") == "error", "archive").otherwise("other")
    job = F.concat_ws("/", "user_id", (F.col("event_id") % 1000).cast("string")).alias("job")
    s = table(spark, sf_dir, "events").select(job, stage.alias("stage"), F.lit(1).alias("tries"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return L.stages(s, "job", ["live", "archive"]).select("job", F.coalesce("next_stage", F.lit("none")).alias("next_stage"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def streamed_upsert(spark, sf_dir):
    """The events read as a stream into a table of each user's last event, and that table's latest version."""
    import uuid

    from ..operators.relational import scratch_folder
    from ..streaming.upsert import latest, upsert_stream

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet")
    root = f"{scratch_folder(spark)}/upsert-{uuid.uuid4().hex}"
    upsert_stream(stream.select("user_id", "event_id", "event_type", "value"), f"{root}/table", f"{root}/log", "user_id", "event_id").awaitTermination()
    return latest(spark, f"{root}/table")


def _is_folder(spark, path):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
