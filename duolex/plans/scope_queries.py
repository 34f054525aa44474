"""Contrasts between people, names of one person, parts of texts, and evidence for a register's open fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contrasts, corpus, scoping
from ..operators import evidence as E
from .registry import query, table
from .rule_queries import pick, sql_pick
from .text_queries import SQL_INF, SQL_NEAR, SQL_NORMALISED

#: Coded statements: a race is five customers, three people take part in each.
SQL_STATEMENTS = """e AS (SELECT 'race ' || o_custkey // 5 AS race_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Person ' || o_orderkey % 3 ELSE 'PERSON  ' || o_orderkey % 3 END AS n, 'person ' || o_orderkey % 3 AS who, CASE WHEN o_orderkey % 10 < 3 THEN 'endorsed' ELSE 'opponent' END AS role,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'topic ' || o_orderkey // 7 % 2 END AS topic, CASE WHEN o_orderkey // 3 % 4 = 0 THEN '' ELSE 'part ' || o_orderkey // 3 % 4 END AS subtopic, CASE o_orderstatus WHEN 'F' THEN 'support' WHEN 'O' THEN 'oppose' ELSE 'mixed' END AS stance, 'quote ' || o_orderkey AS quote,
 'https://example.org/' || o_orderkey AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'Person ' || (o_orderkey + 1) % 3 ELSE ' ' END AS opponent, year(o_orderdate) || '-11-01' AS election_date, o_orderkey AS ord FROM orders WHERE o_orderpriority < '3'),
 k AS (SELECT race_id, who, arg_max(role, ord) AS role, arg_min(n, ord) AS shown FROM e GROUP BY ALL),
 x AS (SELECT e.race_id, topic, subtopic, a.shown AS candidate_a, coalesce(b.shown, opponent) AS candidate_b, 'explicit_conflict' AS contrast_type, 'explicit_disagreement' AS relationship_code, quote AS quote_a, '' AS quote_b, source AS source_a, '' AS source_b FROM e JOIN k a USING (race_id, who) LEFT JOIN k b ON b.race_id = e.race_id AND b.who = lower(opponent)
 WHERE trim(opponent) <> '' AND (e.role = 'endorsed' OR b.role = 'endorsed')),
 p AS (SELECT a.race_id, a.topic, a.subtopic, a.who AS wa, b.who AS wb, CASE WHEN (a.stance = 'support' AND b.stance = 'oppose') OR (a.stance = 'oppose' AND b.stance = 'support') THEN 'explicit_disagreement' ELSE 'different_mechanism' END AS code, a.quote AS quote_a, b.quote AS quote_b, a.source AS source_a, b.source AS source_b, a.ord AS oa, b.ord AS ob
 FROM e a JOIN e b ON a.race_id = b.race_id AND a.topic = b.topic AND a.who < b.who WHERE a.topic <> ''),
 f AS (SELECT * FROM p WHERE code = 'explicit_disagreement' OR (subtopic <> '' AND subtopic <> (SELECT subtopic FROM e WHERE e.ord = p.ob) AND (SELECT subtopic FROM e WHERE e.ord = p.ob) <> '') QUALIFY row_number() OVER (PARTITION BY race_id, topic, wa, wb ORDER BY code DESC, oa, ob) = 1),
 s AS (SELECT * FROM x UNION ALL SELECT f.race_id, topic, subtopic, a.shown, b.shown, 'coded_divergence', code, quote_a, quote_b, source_a, source_b FROM f JOIN k a ON a.race_id = f.race_id AND a.who = wa JOIN k b ON b.race_id = f.race_id AND b.who = wb WHERE a.role = 'endorsed' OR b.role = 'endorsed')"""


def statements(spark, sf_dir):
    k = F.col("o_orderkey")
    third = F.floor(k / 3) % 4
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    return table(spark, sf_dir, "orders").filter("o_orderpriority < '3'").select(
        text("race ", F.floor(F.col("o_custkey") / 5)).alias("race_id"),
        F.when(k % 2 == 0, text("Person ", k % 3)).otherwise(text("PERSON  ", k % 3)).alias("candidate_name"),
        F.when(k % 10 < 3, "endorsed").otherwise("opponent").alias("role"),
        F.when(k % 5 == 0, "").otherwise(text("topic ", F.floor(k / 7) % 2)).alias("topic"),
        F.when(third == 0, "").otherwise(text("part ", third)).alias("subtopic"),
        F.when(F.col("o_orderstatus") == "F", "support").when(F.col("o_orderstatus") == "O", "oppose").otherwise("mixed").alias("stance"),
        text("quote ", k).alias("quote"),
        text("https://example.org/", k).alias("source"),
        F.when(k % 4 == 0, text("Person ", (k + 1) % 3)).otherwise(" ").alias("opponent"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-11-01")).alias("election_date"),
        F.lit("verified").alias("status"),
        k.alias("ord"),
    )


@query(f"""WITH {SQL_STATEMENTS} SELECT substr(sha256(concat_ws(chr(10), race_id, topic, candidate_a, candidate_b, contrast_type, quote_a, quote_b)), 1, 24) AS sticking_point_id, * FROM s""")
def sticking_points(spark, sf_dir):
    """Conflicts that someone names, and coded divergence of two people's stances or subtopics; the SQL compares every two rows."""
    return contrasts.sticking_points(statements(spark, sf_dir))


SQL_KINDS = "count(*) FILTER (WHERE contrast_type = 'explicit_conflict') AS explicit_conflict, count(*) FILTER (WHERE contrast_type = 'coded_divergence') AS coded_divergence, count(*) AS total"


@query(f"WITH {SQL_STATEMENTS} SELECT topic, {SQL_KINDS} FROM s GROUP BY topic")
def sticking_point_topics(spark, sf_dir):
    return contrasts.sticking_point_topics(contrasts.sticking_points(statements(spark, sf_dir)))


@query(f"WITH {SQL_STATEMENTS}, y AS (SELECT race_id, substr(arg_max(election_date, ord), 1, 4) AS cycle FROM e GROUP BY race_id) SELECT coalesce(cycle, 'unknown') AS cycle, {SQL_KINDS} FROM s LEFT JOIN y USING (race_id) GROUP BY 1")
def sticking_point_cycles(spark, sf_dir):
    rows = statements(spark, sf_dir)
    return contrasts.sticking_point_cycles(contrasts.sticking_points(rows), rows)


PEOPLE = ("Jane Smith", "J. Smith", "Jane Q. Smith Jr.", "Smith, Jane", "John Smith", "J.D. Vance", "JD Vance", "Cher", "Ana María López", "A. Lopez", "CHER", "")
SQL_WORDS = "[['jane', 'smith'], ['j', 'smith'], ['jane', 'q', 'smith'], ['jane', 'smith'], ['john', 'smith'], ['j', 'd', 'vance'], ['jd', 'vance'], ['cher'], ['ana', 'maria', 'lopez'], ['a', 'lopez'], ['cher'], []]"


@query(f"""WITH a AS (SELECT DISTINCT c_nationkey AS k, {sql_pick("c_custkey", PEOPLE)} AS name, {SQL_WORDS}[c_custkey % 12 + 1] AS w FROM customer), b AS (SELECT DISTINCT s_nationkey AS k, {sql_pick("s_suppkey", PEOPLE)} AS right_name, {SQL_WORDS}[s_suppkey % 12 + 1] AS r FROM supplier)
 SELECT k, name, right_name FROM a JOIN b USING (k) WHERE len(w) > 0 AND len(r) > 0 AND w[-1] = r[-1] AND (len(w) = 1) = (len(r) = 1)
 AND len(list_filter(range(1, least(len(w), len(r))), lambda i: NOT (w[i] = r[i] OR (len(w[i]) = 1 AND starts_with(r[i], w[i])) OR (len(r[i]) = 1 AND starts_with(w[i], r[i]))))) = 0""")
def similar_names(spark, sf_dir):
    """Names of two tables that may be one person's, initials included."""
    rows = lambda t, n, key: table(spark, sf_dir, t).select(F.col(n).alias("k"), pick(F.col(key), PEOPLE).alias("name")).distinct()
    return corpus.similar_names(rows("customer", "c_nationkey", "c_custkey"), rows("supplier", "s_nationkey", "s_suppkey"), ["k"], "name")


PLACE, LINK = r"<(?:nav|article|footer|h[1-4]|div class=\"[a-z]+\")>", r"<a href=\"(?<link>[^\"]*)\">(?<label>[^<]*)</a>"


@query(f"""WITH c AS (SELECT page_id, string_split(regexp_replace(html, '({PLACE})', chr(1) || '\\1', 'g'), chr(1)) AS p FROM pages), s AS (SELECT page_id, unnest(range(len(p))) AS section, unnest(p) AS body FROM c),
 l AS (SELECT page_id, section, regexp_extract(body, '^{PLACE}') AS heading, regexp_extract_all(body, '{LINK.replace("?<link>", "").replace("?<label>", "")}', 1) AS links, regexp_extract_all(body, '{LINK.replace("?<link>", "").replace("?<label>", "")}', 2) AS labels FROM s)
 SELECT page_id, CAST(section AS INT) AS section, heading, CAST(unnest(range(len(links))) AS INT) AS place, unnest(links) AS link, unnest(labels) AS label FROM l""")
def entries_under_headings(spark, sf_dir):
    """Links of pages, each with the nearest part or heading that begins before it."""
    return scoping.entries_under(table(spark, sf_dir, "pages"), "page_id", "html", PLACE, LINK)


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), j AS (SELECT doc_id, p, CASE doc_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['paragraph 2'] WHEN 2 THEN ['from', trim(left(split_part(p[2], '|', 1), 12))] WHEN 3 THEN ['range', trim(left(split_part(p[1], '|', 1), 12)), trim(left(split_part(p[3], '|', 1), 12))] WHEN 4 THEN ['text', trim(left(split_part(p[1], '|', 1), 15))] ELSE ['both', trim(left(split_part(p[2], '|', 1), 10))] END AS l FROM d),
 r AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: contains(lower(p[i]), lower(l[2]))) AS a, list_filter(range(1, len(p) + 1), lambda i: contains(lower(p[i]), lower(l[3]))) AS b FROM j),
 c AS (SELECT doc_id, p, CASE WHEN l[1] = 'paragraph 2' THEN CASE WHEN len(p) >= 2 THEN [2] ELSE [] END WHEN coalesce(l[2], '') = '' THEN [] WHEN l[1] = 'from' AND len(a) = 1 THEN range(a[1], len(p) + 1) WHEN l[1] = 'range' AND coalesce(l[3], '') <> '' AND len(a) = 1 AND len(b) = 1 AND a[1] < b[1] THEN range(a[1], b[1])
 WHEN l[1] = 'text' AND len(a) = 1 THEN a WHEN l[1] = 'both' AND len(a) = 1 THEN list_sort(list_distinct(list_filter([1, 3, a[1]], lambda i: i <= len(p)))) ELSE [] END AS i FROM r)
 SELECT doc_id AS job_id, doc_id AS document_id, CASE WHEN len(i) > 0 THEN 'extracted' ELSE 'shared_document_unscoped' END AS status, CAST(len(i) AS INT) AS n_paragraphs, coalesce(array_to_string(list_transform(i, lambda k: p[k]), chr(10) || chr(10)), '') AS text FROM c""")
def scoped_documents(spark, sf_dir):
    """What a job's locators name of a document: paragraphs by number, by what they hold, and between two of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("p"))
    start = lambda k, n: F.trim(F.substring(F.substring_index(F.coalesce(F.get("p", F.lit(k - 1)), F.lit("")), "|", 1), 1, n))
    kind = F.col("doc_id") % 6
    locators = (
        F.when(kind == 0, "").when(kind == 1, "paragraph 2").when((kind == 2) & (start(2, 12) != ""), F.concat(F.lit("from: "), start(2, 12)))
        .when((kind == 3) & (start(1, 12) != "") & (start(3, 12) != ""), F.concat(F.lit("range: "), start(1, 12), F.lit(" => "), start(3, 12)))
        .when(kind == 4, start(1, 15)).when((kind == 5) & (start(2, 10) != ""), F.concat(F.lit("paragraph 1 | paragraph 3 | "), start(2, 10))).otherwise("")
    )
    jobs = docs.select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("document_id"), locators.alias("locators"))
    own = docs.select(F.col("doc_id").alias("document_id"), F.posexplode("p").alias("i", "text")).select("document_id", (F.col("i") + 1).alias("index"), "text", F.lit("").alias("locator"))
    return scoping.scoped(jobs, own)


#: Documents about races: what titles, addresses and texts may tell.
TITLE = ("Jane for City Council District 5, Queens", "State Senate district-12 in Virginia", "Denver mayor debate", "Ohio and Michigan voters", "Lieutenant Governor of Maryland", "Council District 9", "12th Congressional District, Texas", "Nothing told", "Voters in Los Angeles: Ward 3", "for assembly 40 in  Brooklyn")
ADDRESS = ("https://www.nyccfb.info/guide", "https://example.org/congressional-district-7", "https://jane.example.com/mayor/plan", "https://news.example.net/a%20b", "https://county.example.gov/results", "https://example.org/state-house/district-8")
KIND = ("news", "campaign_page", "official_voter_guide", "campaign_platform", "blog")
WINDOW = ("in_window", "undated", "out_of_window", "in_window")


def _sql_told() -> tuple[str, str, str]:
    """State, office and jurisdiction in SQL, from the tables of fixed values."""
    quote = lambda x: x.replace("'", "''")
    hit = lambda p, t="t": f"regexp_matches({t}, '(?i){quote(p)}')"
    take = lambda p, k, t="t": f"regexp_extract({t}, '(?i){quote(p)}', {k})"
    told = lambda number, head="District ": f"CASE WHEN {number} = '' THEN '' ELSE '{head}' || {number} END"
    named = "list_filter([" + ", ".join(f"CASE WHEN {hit(p)} THEN '{c}' END" for c, p in E.STATES) + "], lambda x: x IS NOT NULL)"
    state = "CASE WHEN host = 'www.nyccfb.info' THEN 'NY' WHEN len(named) = 1 THEN named[1] END"
    city = "coalesce(" + ", ".join(f"CASE WHEN trim({take(p, 1)}, ' -|') <> '' AND len(regexp_split_to_array(trim({take(p, 1)}, ' -|'), '\\s+')) <= 4 THEN trim({take(p, 1)}, ' -|') END" for p in E.CITIES) + ", '')"
    branches = []
    for office, pattern, district in E.OFFICES:
        if office == "Mayor":
            where = city
        elif district is None:
            where = "''"
        elif office == "City Council":
            where = f"trim(upper(left({take(district, 1)}, 1)) || lower(substr({take(district, 1)}, 2)) || ' ' || {take(district, 2)})"
        else:
            where = told("(" + " || ".join(take(district, k + 1) for k in range(district.count("(\\d+)"))) + ")")
        branches.append((hit(pattern), office, where))
    branches += [(f"contains(lower(url), '{mark}')", office, told(f"regexp_extract(lower(url), '{number}', 1)") if number else "''") for mark, office, number in E.ADDRESSES]
    branches += [(hit(p), office, told(take(p, 1), kind)) for office, p, kind in E.TITLES]
    cases = lambda k: "CASE " + " ".join(f"WHEN {b[0]} THEN {b[k] if k == 2 else repr(b[k])}" for b in branches) + " ELSE '' END"
    return f"{named} AS named", state, f"{cases(1)} AS office, {cases(2)} AS jurisdiction"


_NAMED, _STATE, _TOLD = _sql_told()
SQL_EVIDENCE = f"""d AS (SELECT 'race ' || o_custkey // 3 AS race_id, CAST(o_orderkey AS VARCHAR) AS document_id, {sql_pick("o_orderkey", TITLE)} AS title, {sql_pick("o_orderkey // 2", ADDRESS)} AS url, {sql_pick("o_custkey", KIND)} AS kind, {sql_pick("o_orderkey // 5", WINDOW)} AS win, CASE WHEN o_orderkey % 9 = 0 THEN 'endorsed' ELSE 'opponent' END AS role FROM orders),
 r AS (SELECT *, replace(title || ' | ' || replace(url, '%20', ' '), '', '') AS t, regexp_extract(url, '^https?://([^/]*)', 1) AS host, url LIKE '%.gov/%' OR kind = 'official_voter_guide' OR url LIKE '%/results' AS official FROM d),
 q AS (SELECT *, CASE WHEN official THEN 4 WHEN win = 'out_of_window' THEN 0 WHEN kind LIKE 'campaign%' THEN CASE WHEN win = 'undated' THEN 1 ELSE 2 END ELSE 3 END AS priority, {_NAMED}, {_TOLD} FROM r),
 v AS (SELECT race_id, 'state_code' AS field, priority, {_STATE} AS value, CASE WHEN host = 'www.nyccfb.info' THEN 'official_host:' ELSE 'title_url_text:' END || document_id AS source FROM q WHERE priority > 0 UNION ALL SELECT race_id, 'office', priority, office, 'title_url_text:' || document_id FROM q WHERE priority > 0 UNION ALL SELECT race_id, 'jurisdiction', priority, jurisdiction, 'title_url_text:' || document_id FROM q WHERE priority > 0
 UNION ALL SELECT race_id, 'official_source', priority + CASE WHEN role = 'endorsed' THEN 1 ELSE 0 END, CASE WHEN official THEN url END, 'official_url:' || document_id FROM q WHERE priority > 0),
 w AS (SELECT race_id, field, priority, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value, source FROM v WHERE coalesce(trim(value), '') <> ''), b AS (SELECT *, max(priority) OVER (PARTITION BY race_id, field) AS best FROM w),
 g AS (SELECT race_id, field, value, array_to_string(list_sort(list(DISTINCT source)), ' | ') AS sources FROM b WHERE priority = best GROUP BY ALL), n AS (SELECT race_id, field, min((value, sources)) AS one, count(*) AS n FROM g GROUP BY ALL),
 z AS (SELECT race_id, field, n > 1 AND field <> 'official_source' AS tied, one FROM n), f AS (SELECT race_id, field, CASE WHEN tied THEN '' ELSE one[1] END AS value, CASE WHEN tied THEN '' ELSE one[2] END AS sources, CASE WHEN tied THEN 'tied' ELSE 'resolved' END AS status FROM z)"""
_FIELDS = ", ".join(f"coalesce(max({c}) FILTER (WHERE field = '{f}'), '') AS {f if c == 'value' else f'{f}_{c}'}" for f in ("state_code", "office", "jurisdiction", "official_source") for c in ("value", "sources", "status"))


@query(f"WITH {SQL_EVIDENCE} SELECT race_id, {_FIELDS} FROM (SELECT DISTINCT race_id FROM d) LEFT JOIN f USING (race_id) GROUP BY race_id")
def inferred_fields(spark, sf_dir):
    """State, office, jurisdiction and authority of each race from its documents' ranked evidence, ties open."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    docs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("race "), F.floor(c / 3).cast("string")).alias("race_id"), k.cast("string").alias("document_id"), pick(k, TITLE).alias("title"), pick(F.floor(k / 2), ADDRESS).alias("source_url"), pick(c, KIND).alias("source_type"),
        pick(F.floor(k / 5), WINDOW).alias("campaign_window_status"), F.when(k % 9 == 0, "endorsed").otherwise("opponent").alias("role"), *(F.lit("").alias(x) for x in ("analysis_scope", "coverage_status", "extraction_status", "text")),
    )
    return E.inferred(docs)


def batch_files(partitions: int, cores: int) -> int:
    """Files of each of three batches: no task has more than the input's partitions have, and all cores have one."""
    return max(1, -(-partitions // 3), cores)


@query(f"""WITH i AS (SELECT doc_id, {SQL_INF} AS inf, sha256({SQL_NORMALISED}) AS exact FROM documents), h AS (SELECT doc_id, exact, {SQL_NEAR} AS near FROM i)
 SELECT doc_id, exact, near, CAST(count(*) OVER (PARTITION BY exact) AS BIGINT) AS n_exact, CASE WHEN near = '' THEN 1 ELSE CAST(count(*) OVER (PARTITION BY near) AS BIGINT) END AS n_near FROM h""")
def streamed_duplicates(spark, sf_dir):
    """Exact and near copies counted as documents arrive in three batches."""
    import uuid

    from ..operators.relational import scratch_folder
    from ..streaming.upsert import count_duplicates, duplicate_numbers

    root = f"{scratch_folder(spark)}/duplicates-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = batch_files(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    docs.repartition(3 * files).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    count_duplicates(stream, f"{root}/table", f"{root}/log", "doc_id", "text", "doc_id").awaitTermination()
    return duplicate_numbers(spark, f"{root}/table")
