"""Composite flows over the star schema: registers, queues, audits, contexts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from .registry import query, table
from .rule_queries import pick, sql_pick
from .text_queries import SQL_FEATURES, grouped

PAIR = ("endorsed", "opponent")
#: A race is a customer's orders of a year; who takes part is named by the clerk, the role is by priority.
SQL_PEOPLE = """people AS (SELECT o_custkey || '-' || year(o_orderdate) AS race_id, 'Person ' || o_orderkey % 7 AS candidate_name, CASE WHEN o_orderpriority < '3' THEN 'endorsed' WHEN o_orderpriority < '5' THEN 'opponent' ELSE 'unopposed' END AS role,
 CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'I' END AS party, year(o_orderdate) || '-06-01' AS election_date, 'Body ' || o_orderkey % 4 AS body, o_orderkey, o_custkey FROM orders)"""


def people(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    return o.select(
        F.concat_ws("-", F.col("o_custkey").cast("string"), year).alias("race_id"),
        F.concat(F.lit("Person "), (F.col("o_orderkey") % 7).cast("string")).alias("candidate_name"),
        F.when(F.col("o_orderpriority") < "3", "endorsed").when(F.col("o_orderpriority") < "5", "opponent").otherwise("unopposed").alias("role"),
        F.when(F.col("o_orderkey") % 3 == 0, "D").otherwise("I").alias("party"),
        F.concat(year, F.lit("-06-01")).alias("election_date"),
        F.concat(F.lit("Body "), (F.col("o_orderkey") % 4).cast("string")).alias("body"),
        "o_orderkey",
        "o_custkey",
    )


SQL_JOINED = "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER (WHERE {1})), ' | '), '')"
SQL_REGISTRY = f"""{SQL_PEOPLE}, g AS (SELECT race_id, any_value(o_custkey) AS k, min(election_date) AS election_date, min(election_date) <> max(election_date) AS errors, {SQL_JOINED.format("candidate_name", "role = 'endorsed'")} AS e, {SQL_JOINED.format("candidate_name", "role = 'unopposed'")} AS u,
 {SQL_JOINED.format("candidate_name", "role = 'opponent'")} AS opponents, {SQL_JOINED.format("body", "true")} AS endorsing_bodies, CASE WHEN bool_or(role <> 'opponent' AND party = 'D') THEN 'in_scope' ELSE 'out_of_scope' END AS scope_kind FROM people GROUP BY race_id),
 f AS (SELECT race_id, election_date, errors, CASE WHEN e <> '' THEN e ELSE u END AS endorsed_candidate, opponents, endorsing_bodies, scope_kind,
 CASE WHEN k % 3 = 0 THEN 'Mayor' WHEN k % 2 = 0 THEN 'Council' ELSE '' END AS office, CASE WHEN k % 3 = 0 THEN 'manual_verified' WHEN k % 2 = 0 THEN 'processed_verified' ELSE 'unresolved' END AS office_status,
 CASE WHEN k % 2 = 0 THEN 'City ' || k % 10 ELSE '' END AS jurisdiction, CASE WHEN k % 2 = 0 THEN 'processed_verified' ELSE 'unresolved' END AS jurisdiction_status,
 CASE WHEN k % 3 = 0 THEN 'S' || k % 5 WHEN k % 2 = 0 THEN 'T' || k % 5 ELSE 'U' || k % 5 END AS state_code, CASE WHEN k % 3 = 0 THEN 'manual_verified' WHEN k % 2 = 0 THEN 'processed_verified' ELSE 'hint_verified' END AS state_code_status, '' AS official_source, 'unresolved' AS official_source_status FROM g),
 registry AS (SELECT *, array_to_string(list_filter([CASE WHEN office = '' THEN 'office' END, CASE WHEN jurisdiction = '' THEN 'jurisdiction' END, 'official_source'], lambda x: x IS NOT NULL), ' | ') AS unresolved_fields FROM f)"""


def registry(spark, sf_dir):
    rows = people(spark, sf_dir)
    k = F.col("k")
    races = rows.groupBy("race_id").agg(F.min("o_custkey").alias("k"))
    none = F.lit(None).cast("string")
    state = lambda letter: F.concat(F.lit(letter), (k % 5).cast("string")).alias("state_code")
    packages = {
        "manual": races.filter("k % 3 = 0").select("race_id", F.lit("Mayor").alias("office"), F.lit(" ").alias("jurisdiction"), state("S"), none.alias("official_source")),
        "processed": races.filter("k % 2 = 0").select("race_id", F.lit("Council").alias("office"), F.concat(F.lit("City "), (k % 10).cast("string")).alias("jurisdiction"), state("T"), none.alias("official_source")),
        "hint": races.select("race_id", none.alias("office"), none.alias("jurisdiction"), state("U"), none.alias("official_source")),
    }
    return C.race_registry(rows, packages, in_scope=("D",))


@query(f"WITH {SQL_REGISTRY} SELECT * FROM registry")
def race_registry(spark, sf_dir):
    """Each race's people, scope and fields by precedence of their sources, with what is open."""
    return registry(spark, sf_dir)


@query(f"WITH {SQL_REGISTRY} SELECT race_id, unresolved_fields, 'resolve_' || replace(unresolved_fields, ' | ', '; resolve_') AS queue_reason FROM registry WHERE unresolved_fields <> ''")
def race_unresolved(spark, sf_dir):
    return C.unresolved(registry(spark, sf_dir)).select("race_id", "unresolved_fields", "queue_reason")


@query(f"""WITH {SQL_REGISTRY}, r AS (SELECT *, substr(election_date, 1, 4) AS cycle_year FROM registry WHERE scope_kind = 'in_scope')
 SELECT state_code, cycle_year, CAST(count(*) AS BIGINT) AS race_count, md5(array_to_string(list_sort(list(race_id)), ' | ')) AS race_ids, array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(endorsed_candidate, ' | '), lambda x: x <> ''))))), ' | ') AS endorsed_candidates, array_to_string(list_sort(list_distinct(flatten(list(string_split(endorsing_bodies, ' | '))))), ' | ') AS endorsing_bodies FROM r GROUP BY ALL""")
def race_cycles(spark, sf_dir):
    return C.represented_cycles(registry(spark, sf_dir)).withColumn("race_ids", F.md5("race_ids"))


SQL_SUPPORT = f"""{SQL_PEOPLE}, who AS (SELECT race_id, candidate_name, min(role) AS role, min(election_date) AS election_date FROM people GROUP BY ALL), texts AS (SELECT race_id, candidate_name, count(*) AS documents, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM people JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY ALL),
 support AS (SELECT race_id, candidate_name, role, election_date, coalesce(documents, 0) AS documents, coalesce(tokens, 0) AS tokens, CASE WHEN documents IS NULL THEN 'missing' WHEN tokens >= 60 THEN 'supported' ELSE 'thin' END AS status FROM who LEFT JOIN texts USING (race_id, candidate_name))"""


def support(spark, sf_dir):
    p = people(spark, sf_dir)
    who = p.groupBy("race_id", "candidate_name").agg(F.min("role").alias("role"), F.min("election_date").alias("election_date"))
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("tokens"))
    return C.candidate_support(who, p.join(lines, "o_orderkey"), least=60)


@query(f"WITH {SQL_SUPPORT} SELECT * FROM support")
def candidate_support(spark, sf_dir):
    return support(spark, sf_dir)


@query(f"WITH {SQL_SUPPORT} SELECT role, substr(election_date, 1, 4) AS year, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE status = 'supported') AS BIGINT) AS supported, CAST(sum(tokens) AS BIGINT) AS tokens FROM support GROUP BY ALL")
def audit_group_years(spark, sf_dir):
    return C.group_years(support(spark, sf_dir))


@query(f"""WITH {SQL_SUPPORT}, p AS (SELECT race_id FROM support WHERE status = 'supported' GROUP BY 1 HAVING bool_or(role = 'endorsed') AND bool_or(role = 'opponent')), y AS (SELECT substr(election_date, 1, 4) AS year, count(DISTINCT role) AS n FROM support WHERE status = 'supported' GROUP BY 1),
 t AS (SELECT count(*) FILTER (WHERE status = 'supported') / greatest(count(*), 1) AS s, sum(tokens) FILTER (WHERE role = 'endorsed') AS a, sum(tokens) FILTER (WHERE role = 'opponent') AS b, count(*) FILTER (WHERE trim(role) = '') AS r FROM support)
 SELECT 'paired_races' AS gate, CAST((SELECT count(*) FROM p) AS DOUBLE) AS value, (SELECT count(*) FROM p) >= 5 AS passed UNION ALL SELECT 'supported_share', round(s, 6), s >= 0.9 FROM t UNION ALL SELECT 'token_balance', round(CAST(least(a, b) AS DOUBLE) / greatest(a, b), 6), least(a, b) * 1.0 / greatest(a, b) >= 0.5 FROM t
 UNION ALL SELECT 'one_sided_years', CAST((SELECT count(*) FROM y WHERE n < 2) AS DOUBLE), (SELECT count(*) FROM y WHERE n < 2) = 0 UNION ALL SELECT 'without_role', CAST(r AS DOUBLE), r = 0 FROM t""")
def audit_gates(spark, sf_dir):
    """The gates that a corpus has to pass."""
    return C.sufficiency_gates(support(spark, sf_dir), *PAIR, pairs=5, share=0.9, balance=0.5)


@query(f"""WITH {SQL_SUPPORT}, tried AS (SELECT race_id, candidate_name, count(*) AS tries, max_by(CASE WHEN o_orderkey % 5 = 0 THEN 'HTTP Error 503' WHEN o_orderkey % 5 < 3 THEN 'no such page' ELSE '' END, o_orderkey) AS last_error FROM people WHERE o_orderkey % 2 = 0 GROUP BY ALL)
 SELECT race_id, candidate_name, status, CAST(coalesce(tries, 0) AS BIGINT) AS tries, tries IS NULL OR last_error = 'HTTP Error 503' AS retryable FROM support LEFT JOIN tried USING (race_id, candidate_name) WHERE status <> 'supported'""")
def audit_gaps(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    error = F.when(k == 0, "HTTP Error 503").when(k < 3, "no such page").otherwise("")
    tried = people(spark, sf_dir).filter("o_orderkey % 2 = 0").select("race_id", "candidate_name", error.alias("error"), F.col("o_orderkey").alias("at"))
    return C.coverage_gaps(support(spark, sf_dir), tried).select("race_id", "candidate_name", "status", "tries", "retryable")


@query("""WITH e AS (SELECT o_custkey || '' AS race_id, 'Person ' || o_orderkey % 7 AS n, '2020-06-01' AS d, 'endorsed' AS role, 'https://host.org/p' || o_orderkey % 5 AS url, CASE WHEN o_orderkey % 7 < 2 THEN 'person' || o_orderkey % 7 || '.org' END AS dom FROM orders),
 r AS (SELECT c_custkey || '' AS race_id, 'Person ' || c_custkey % 7 AS n, '2020-06-01' AS d, 'endorsed' AS role, CASE WHEN c_custkey % 2 = 0 THEN 'https://vote.gov/a/ | https://vote.gov/b?utm_source=x' ELSE '' END AS official FROM customer),
 w AS (SELECT race_id, n, role, d, max(official) AS official FROM (SELECT race_id, n, role, d, official FROM r UNION ALL SELECT race_id, n, role, d, '' FROM e) GROUP BY ALL), k AS (SELECT race_id, n, count(DISTINCT url) AS known, min(dom) AS dom FROM e GROUP BY ALL),
 s AS (SELECT w.race_id, w.n, w.role, 'https://' || dom || '/' AS seed_url, 'campaign_domain' AS seed_kind, 1 AS p, known FROM w JOIN k USING (race_id, n) WHERE dom IS NOT NULL UNION SELECT e.race_id, e.n, e.role, url, 'known_document', 2, known FROM e JOIN k USING (race_id, n)
  UNION SELECT w.race_id, w.n, w.role, u, 'official_election_source', 3, coalesce(known, 0) FROM (SELECT *, unnest(['https://vote.gov/a', 'https://vote.gov/b']) AS u FROM w WHERE official <> '') w LEFT JOIN k USING (race_id, n))
 SELECT race_id, n AS candidate_name, seed_url, seed_kind, CAST(p AS INTEGER) AS seed_priority, CAST(known AS BIGINT) AS known_sources, substr(sha256(race_id || chr(10) || n || chr(10) || role || chr(10) || seed_kind || chr(10) || seed_url), 1, 24) AS discovery_seed_id FROM s""")
def discovery_queue(spark, sf_dir):
    """Three kinds of seeds for each candidate, each address once."""
    name = lambda k: F.concat(F.lit("Person "), (F.col(k) % 7).cast("string")).alias("candidate_name")
    key = lambda k: (F.col(k).cast("string").alias("race_id"), name("o_orderkey" if k == "o_custkey" else k), F.lit("endorsed").alias("role"), F.lit("2020-06-01").alias("election_date"))
    own = F.when(F.col("o_orderkey") % 7 < 2, F.concat(F.lit("person"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".org")))
    evidence = table(spark, sf_dir, "orders").select(*key("o_custkey"), F.concat(F.lit("https://host.org/p"), (F.col("o_orderkey") % 5).cast("string")).alias("url"), own.alias("campaign_domain"))
    official = F.when(F.col("c_custkey") % 2 == 0, "https://vote.gov/a/ | https://vote.gov/b?utm_source=x").otherwise("")
    roster = table(spark, sf_dir, "customer").select(*key("c_custkey"), F.lit("q").alias("queue_id"), official.alias("official_source"))
    return C.discovery_queue(evidence, roster).select("race_id", "candidate_name", "seed_url", "seed_kind", "seed_priority", "known_sources", "discovery_seed_id")


@query("""WITH c AS (SELECT DISTINCT n_name AS state_code, CAST(year(o_orderdate) AS VARCHAR) AS cycle_year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), g AS (SELECT unnest(['state_party', 'voter_guide', 'news']) AS category),
 s AS (SELECT n_name AS state_code, '1996' AS cycle_year, 'voter_guide' AS category, 'https://guide.org/' || n_nationkey AS url, 'Guide of ' || n_name AS title FROM nation WHERE n_nationkey % 2 = 0)
 SELECT state_code, cycle_year, category, coalesce(title, state_code || ' ' || cycle_year || ' ' || CASE category WHEN 'state_party' THEN 'State Party' WHEN 'voter_guide' THEN 'Voter Guide' ELSE 'News' END) AS title, coalesce(url, '') AS url, CASE WHEN url IS NULL THEN 'to_search' ELSE 'to_fetch' END AS status,
 substr(sha256(state_code || chr(10) || cycle_year || chr(10) || category || chr(10) || coalesce(url, '')), 1, 24) AS context_id FROM c CROSS JOIN g LEFT JOIN s USING (state_code, cycle_year, category)""")
def context_inventory(spark, sf_dir):
    """What is known and what is to be searched for each state, cycle and category."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state_code"))
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("string").alias("cycle_year")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    cycles = c.select("c_nationkey", "cycle_year").distinct().join(nations, "c_nationkey")
    categories = spark.createDataFrame([("state_party",), ("voter_guide",), ("news",)], "category string")
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    seeds = n.select(F.col("n_name").alias("state_code"), F.lit("1996").alias("cycle_year"), F.lit("voter_guide").alias("category"), F.concat(F.lit("https://guide.org/"), F.col("n_nationkey").cast("string")).alias("url"), F.concat(F.lit("Guide of "), "n_name").alias("title"))
    return C.context_inventory(cycles, categories, seeds)


def page_of(url):
    """A stand-in for the network: a page for every address, but for blogs, which time out."""
    if "blog" in url:
        raise TimeoutError("timed out")
    return url, "text/html", f"<title>t</title><aside>Page</aside> of <b>{url}</b><p>and more".encode()


@query("""WITH q AS (SELECT CAST(page_id AS VARCHAR) AS key, url, page_id % 4 AS k FROM pages), d AS (SELECT * FROM q WHERE k IN (1, 3) ORDER BY CASE k WHEN 3 THEN 0 ELSE 1 END, key LIMIT 100)
 SELECT key, CASE WHEN contains(url, 'blog') THEN '' ELSE 'Page of ' || url || chr(10) || chr(10) || 'and more' END AS text, CASE WHEN contains(url, 'blog') THEN 'TimeoutError: timed out' ELSE '' END AS error, CASE WHEN k = 3 THEN 1 ELSE 2 END AS tries, CAST(CASE WHEN contains(url, 'blog') THEN 0 ELSE 1 END AS BIGINT) AS segments FROM d""")
def extraction_batch(spark, sf_dir):
    """One batch of a hundred pages: what was never tried, then what timed out; neither what is done nor what can't be had."""
    pages = table(spark, sf_dir, "pages")
    key, k = F.col("page_id").cast("string").alias("key"), F.col("page_id") % 4
    queue = pages.select(key, "url", F.lit(None).cast("string").alias("archive"))
    attempts = pages.filter(k != 3).select(key, F.when(k == 1, "timed out").when(k == 2, "bad page").alias("error"), F.lit("2020").alias("at"))
    made = C.extraction_batch(queue, attempts, page_of, limit=100)
    tries = made["attempts"].groupBy("key").agg(F.count("*").cast("int").alias("tries"))
    segments = made["segments"].groupBy("key").agg(F.count("*").alias("segments"))
    rows = made["captures"].select("key", F.coalesce("error", F.lit("")).alias("error")).join(made["documents"], "key", "left").join(tries, "key").join(segments, "key", "left")
    return rows.select("key", F.coalesce("text", F.lit("")).alias("text"), "error", "tries", F.coalesce("segments", F.lit(0)).alias("segments"))


@query("""WITH v AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS race, year(o_orderdate) AS day, o_custkey AS candidate, max(o_totalprice) AS votes FROM orders GROUP BY ALL), r AS (SELECT race, day, max(votes) AS top FROM v GROUP BY ALL HAVING bool_or(candidate % 11 = 0))
 SELECT race, day, candidate, round(votes, 4) AS votes, CASE WHEN votes = top THEN 'Win' ELSE 'Loss' END AS outcome FROM v JOIN r USING (race, day)""")
def presidential_rosters(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("race"), F.year("o_orderdate").cast("long").alias("day"), F.col("o_custkey").alias("candidate"), F.col("o_totalprice").alias("votes"))
    return C.winners(v, ["race", "day"], "candidate", "votes", F.col("candidate") % 11 == 0).withColumn("votes", F.round("votes", 4))


NAMES = ("José R. Lee", "Jose Lee Jr.", "J. T. Smith", "JT Smith", "Ann Lee", "Ann (Annie) Lee", "Prince", "prince", "Al Li")
SQL_KEYS = ("jose lee", "jose lee", "jt smith", "jt smith", "ann lee", "ann lee", "prince", "prince", "al li")


@query(f"""WITH a AS (SELECT DISTINCT c_nationkey AS k, {sql_pick("c_custkey", NAMES)} AS name, {sql_pick("c_custkey", SQL_KEYS)} AS key FROM customer), b AS (SELECT DISTINCT s_nationkey AS k, {sql_pick("s_suppkey", NAMES)} AS name, {sql_pick("s_suppkey", SQL_KEYS)} AS key FROM supplier)
 SELECT a.k, a.name, b.name AS right_name FROM a JOIN b USING (k, key)""")
def name_matches(spark, sf_dir):
    """Names of one person in two tables: equal words, or the given name or initials and the last one."""
    rows = lambda t, n, k: table(spark, sf_dir, t).select(F.col(n).alias("k"), pick(F.col(k), NAMES).alias("name")).distinct()
    return C.match_names(rows("customer", "c_nationkey", "c_custkey"), rows("supplier", "s_nationkey", "s_suppkey"), ["k"], "name")


@query("SELECT p_partkey, regexp_extract_all(p_name || '; ' || p_type, '([a-zA-Z]+) ([a-zA-Z]+)', 1) AS first, regexp_extract_all(p_name || '; ' || p_type, '([a-zA-Z]+) ([a-zA-Z]+)', 2) AS second FROM part")
def guide_entries(spark, sf_dir):
    """A pattern's named groups for each of its matches."""
    found = C.named_groups(F.concat_ws("; ", "p_name", "p_type"), r"(?<first>[a-zA-Z]+) (?<second>[a-zA-Z]+)")
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.first", "f.second")


@query("SELECT 'warning' AS severity, 'o_orderstatus is open' AS rule, CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS detail FROM orders WHERE o_orderstatus IN ('O', 'P') AND year(o_orderdate) BETWEEN 1994 AND 1996")
def census_gate(spark, sf_dir):
    rows = C.within_years(table(spark, sf_dir, "orders"), F.year("o_orderdate"), 1994, 1996, strict=False)
    return C.census_errors(rows, "o_orderkey", "o_orderstatus", ("O", "P"), strict=False)


@query(f"""WITH {SQL_FEATURES}, u AS (SELECT count(DISTINCT term) AS n FROM (SELECT unnest(tokens) AS term FROM tok)), f AS (SELECT feature, count(*) AS n, count(DISTINCT doc_id) AS d FROM feats GROUP BY feature)
 SELECT 'tfidf' AS name, n AS "rows" FROM u UNION ALL SELECT 'hot_cold', n FROM u UNION ALL SELECT 'log_odds', count(*) FROM f WHERE n >= 5 UNION ALL SELECT 'prevalence', count(*) FROM f WHERE d >= 5""")
def lexical_tables(spark, sf_dir):
    """The rows of each table of the word analysis."""
    made = C.lexical_analysis(grouped(spark, sf_dir), "doc_id", "grp", "tokens", PAIR, least=5)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in made.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


@query("""SELECT 'documents' AS section, unnest(['n', 'sources']) AS metric, unnest([CAST((SELECT count(*) FROM documents) AS DOUBLE), CAST((SELECT count(DISTINCT source) FROM documents) AS DOUBLE)]) AS value
 UNION ALL SELECT 'labels', unnest(['n', 'good']), unnest([CAST((SELECT count(*) FROM labels) AS DOUBLE), (SELECT round(avg(quality), 6) FROM labels)])""")
def canonical_report(spark, sf_dir):
    """Several one-row summaries as one table."""
    documents = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    labels = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"))
    return C.report(documents=documents, labels=labels)
