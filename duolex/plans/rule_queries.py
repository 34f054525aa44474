"""Identities, predicates over rows and addresses, keys and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import predicates as P
from ..functions import urls as U
from ..operators import corpus as C
from .registry import query, table


def values(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sql_holds(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_ends(text: str, words) -> str:
    return "(" + " OR ".join(f"suffix({text}, '{w}')" for w in words) + ")"


def pick(key, items):
    """The item at key modulo their number."""
    return F.array(*(F.lit(x) for x in items))[(key % len(items)).cast("int")]


def sql_pick(key: str, items) -> str:
    return f"{values(items)}[{key} % {len(items)} + 1]"


# ---- identities and keys -------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS identity FROM conversations")
def accentless_identity(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", I.identity(F.col("text")).alias("identity"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(p_type || '| ' || p_brand || ' ||' || p_type, '|'), lambda x: trim(x)), lambda x: x <> ''))) AS labels FROM part")
def label_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", I.labels(F.concat("p_type", F.lit("| "), "p_brand", F.lit(" ||"), "p_type")).alias("labels"))


NAMES = ("None Listed", "Ann Lee", " democratic  primary field ", "")


@query(f"SELECT c_custkey, list_filter(list_transform(regexp_split_to_array(c_name || '; ' || {sql_pick('c_custkey', NAMES)} || ' | ' || c_mktsegment, '[;|]'), lambda x: trim(x)), lambda x: x <> '' AND lower(regexp_replace(x, '\\s+', ' ', 'g')) NOT IN ({', '.join(repr(x) for x in I.PLACEHOLDERS)})) AS names FROM customer")
def name_lists(spark, sf_dir):
    cell = F.concat("c_name", F.lit("; "), pick(F.col("c_custkey"), NAMES), F.lit(" | "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", I.names(cell).alias("names"))


CATEGORIES = ("dsa_national", "dsa_national | dsa_state_local", "dnc_national", "state_democratic_party|dnc_national", "dsa_national|dnc_national", "unknown", "")


@query(f"SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'dsa' WHEN 1 THEN 'dsa' WHEN 2 THEN 'democratic' WHEN 3 THEN 'democratic' END AS grp, {sql_pick('p_partkey', CATEGORIES)} AS categories FROM part")
def official_groups(spark, sf_dir):
    categories = pick(F.col("p_partkey"), CATEGORIES)
    return table(spark, sf_dir, "part").select("p_partkey", I.official_group(categories, strict=False).alias("grp"), categories.alias("categories"))


@query("""SELECT c_custkey, sha256('{"key":' || c_custkey || ',"name":"' || c_name || '","note":null,"segment":"' || c_mktsegment || '"}') AS hash, substr(sha256('1729:' || c_custkey), 1, 16) AS seeded FROM customer""")
def canonical_hashes(spark, sf_dir):
    fields = {"segment": F.col("c_mktsegment"), "key": F.col("c_custkey"), "note": F.lit(None).cast("string"), "name": F.col("c_name")}
    return table(spark, sf_dir, "customer").select("c_custkey", I.canonical_hash(**fields).alias("hash"), I.seeded_key(1729, F.col("c_custkey")).alias("seeded"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part")
def pretty_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", I.pretty(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("label"))


@query("SELECT o_orderkey, printf('%.3f', o_totalprice) AS price, printf('%.8f', o_custkey / 7.0) AS share FROM orders")
def fixed_decimals(spark, sf_dir):
    """Numbers as text with a fixed number of digits."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.3f", "o_totalprice").alias("price"), F.format_string("%.8f", F.col("o_custkey") / F.lit(7.0)).alias("share"))


# ---- rows ----------------------------------------------------------------------------------------------------------

SCOPES, COVERED, STATES = ("analysis", "context_only", ""), ("verified", "shared_document_unscoped"), ("extracted", "shared_document_unscoped", "media_no_transcript", " extracted ", "error")


@query(f"""WITH d AS (SELECT o_orderkey, {sql_pick("o_orderkey", SCOPES)} AS a, {sql_pick("o_custkey", COVERED)} AS c, {sql_pick("o_orderkey", STATES)} AS e FROM orders)
 SELECT o_orderkey, a <> 'context_only' AND c <> 'shared_document_unscoped' AND e <> 'shared_document_unscoped' AS analysis, a <> 'context_only' AND c <> 'shared_document_unscoped' AND trim(e) = 'extracted' AS pairing FROM d""")
def analysis_scope(spark, sf_dir):
    cells = pick(F.col("o_orderkey"), SCOPES), pick(F.col("o_custkey"), COVERED), pick(F.col("o_orderkey"), STATES)
    return table(spark, sf_dir, "orders").select("o_orderkey", P.supports_analysis(*cells).alias("analysis"), P.supports_pairing(*cells).alias("pairing"))


FETCH = ("fetched", "reused_raw", "failed")


@query(f"""WITH n AS (SELECT l_orderkey, count(*) AS p, sum(l_linenumber) AS s FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey, {sql_pick("o_orderkey", FETCH)} AS f, {sql_pick("o_orderkey", STATES)} AS e, CASE WHEN o_custkey % 4 = 0 THEN 'media_no_transcript' ELSE 'verified' END AS c, coalesce(p, 0) AS p, coalesce(s, 0) AS s, coalesce(p, 0) + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS tp, coalesce(s, 0) AS ts, CASE WHEN o_custkey % 11 = 0 THEN ' ' ELSE 'text' END AS t FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
 SELECT o_orderkey, f <> 'failed' AND ((trim(e) = 'extracted' AND trim(t) <> '' AND tp > 0 AND ts > 0 AND p = tp AND s = ts) OR (e = 'media_no_transcript' AND c = 'media_no_transcript')) AS completed FROM m""")
def completed_documents(spark, sf_dir):
    """Documents whose paragraphs and sentences are those that their metadata tell of."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("p"), F.sum("l_linenumber").alias("s"))
    m = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(n, "o_orderkey", "left").fillna(0, ["p", "s"])
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    coverage, text = F.when(who % 4 == 0, "media_no_transcript").otherwise("verified"), F.when(who % 11 == 0, " ").otherwise("text")
    told = F.col("p") + F.when(who % 3 == 0, 1).otherwise(0)
    done = P.is_completed(pick(key, FETCH), pick(key, STATES), coverage, text, F.col("p"), F.col("s"), told, F.col("s"))
    return m.select("o_orderkey", done.alias("completed"))


MEDIA = ("https://www.youtube.com/watch?v=1", "https://x.org/talk.MP4?a=b", "https://x.org/talk.html", "", "https://m.x.org/clip.webm")


@query(f"SELECT page_id, page_id % 3 <> 0 AND (page_id % 7 = 0 OR page_id % 5 IN (0, 1, 4)) AS silent FROM pages")
def silent_videos(spark, sf_dir):
    key = F.col("page_id")
    transcript, kind = F.when(key % 3 == 0, "spoken").otherwise(" "), F.when(key % 7 == 0, "video").otherwise("page")
    return table(spark, sf_dir, "pages").select("page_id", P.silent_video(transcript, kind, pick(key, MEDIA)).alias("silent"))


# ---- addresses -----------------------------------------------------------------------------------------------------

PATHS = (
    "/wp-content/endorse.html", "/endorsements/2020", "/events/candidate-forum", "/events/endorsement-forum/", "/candidates/ann", "/call-for-candidates", "/election-results", "/calendar/election/", "/about",
    "/slate.PNG", "/voter%2Dguide", "/", "/feed", "/comments/feed/x", "/issues/housing", "/privacy-policy", "/press/statement.pdf", "/news.css", "/Platform+now", "/electoral/working-group",
)
SQL_URL = f"'https://host.org' || {sql_pick('page_id', PATHS)} || CASE WHEN page_id % 3 = 0 THEN '?tribe-bar-date=1' ELSE '' END"
SQL_PATH = f"lower(url_decode(replace({sql_pick('page_id', PATHS)}, '+', '%2B')))"


def urls(spark, sf_dir):
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://host.org"), pick(key, PATHS), F.when(key % 3 == 0, "?tribe-bar-date=1").otherwise("")).alias("url"))


@query(f"""WITH u AS (SELECT page_id, {SQL_PATH} AS p, page_id % 3 = 0 AS dated FROM pages)
 SELECT page_id, CASE WHEN {sql_holds("p", P.ARCHIVE_EXCLUDED)} OR {sql_ends("p", P.ARCHIVE_SUFFIXES)} OR dated THEN false WHEN {sql_holds("p", P.EVENT_PATHS)} AND {sql_holds("p", P.EVENT_TERMS)} THEN false WHEN {sql_holds("p", P.ARCHIVE_TERMS)} THEN true
 WHEN contains(p, 'candidate') THEN NOT {sql_holds("p", P.NO_CANDIDATES)} WHEN contains(p, 'elect') THEN (contains(p, 'electoral') OR contains(p, 'election')) AND NOT {sql_holds("p", P.NO_ELECTION)} ELSE false END AS wanted FROM u""")
def historical_urls(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", P.historical_url(F.col("url")).alias("wanted"))


@query(f"""WITH u AS (SELECT page_id, {SQL_URL} AS url, {SQL_PATH} AS p FROM pages)
 SELECT page_id, p NOT IN ('', '/', '/feed', '/comments/feed') AND NOT starts_with(p, '/comments/feed/') AND NOT starts_with(p, '/wp-') AND NOT {sql_ends("p", P.DISCOVERY_SUFFIXES)} AND NOT {sql_holds("p", P.LEGAL_PATHS)} AND {sql_holds("p", P.DISCOVERY_PATHS)} AS wanted, {sql_holds("lower(url)", P.DISCOVERY_TERMS)} AS term FROM u""")
def discovery_urls(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", P.discovery_url(F.col("url")).alias("wanted"), P.discovery_term(F.col("url")).alias("term"))


TITLES = ("Our Endorsements", "Voter Guide", "Home", "Slates", "")


@query(f"SELECT page_id, {sql_holds(f'''lower({sql_pick('page_id', TITLES)} || ' ' || substr(html, 1, 6000))''', P.PAGE_TERMS)} AS endorses FROM pages")
def endorsement_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.endorsement_page(pick(F.col("page_id"), TITLES), F.col("html")).alias("endorses"))


HOSTS = ("smithforcongress.org", "vote-smith.org", "docs.google.com", "city.gov", "Jones2020.com", "lee.org")
SLUGS = ("jane-smith", "al-jones", "ann-lee")
SOURCES = ("Official Campaign", "news article", "campaign-website")


@query(f"""WITH c AS (SELECT c_custkey, lower({sql_pick("c_custkey", HOSTS)}) AS h, {sql_pick("c_nationkey", SLUGS)} AS s, c_custkey % 17 = 0 AS r, {sql_pick("c_custkey", SOURCES)} AS t FROM customer),
 o AS (SELECT *, r OR (h <> 'docs.google.com' AND NOT suffix(h, '.gov') AND NOT {sql_holds("h", P.FOREIGN_TERMS)} AND len(list_filter(string_split(s, '-'), lambda x: length(x) >= 4 AND contains(h, x))) > 0) AS own FROM c)
 SELECT c_custkey, own, own AND (r OR t <> 'news article') AS derived FROM o""")
def candidate_domains(spark, sf_dir):
    key, registered = F.col("c_custkey"), F.col("c_custkey") % 17 == 0
    own = P.own_domain(pick(key, HOSTS), pick(F.col("c_nationkey"), SLUGS), registered, ("docs.google.com", "vimeo.com"))
    return table(spark, sf_dir, "customer").select("c_custkey", own.alias("own"), P.derives_domain(own, F.array(pick(key, SOURCES)), registered).alias("derived"))


# ---- jobs ----------------------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END AS n, CAST(c_nationkey AS VARCHAR) AS race, CASE WHEN c_custkey % 2 = 0 THEN 'https://host.org/x' || c_custkey || ' | https://other.org/' ELSE 'HTTP://Host.org/y' || c_custkey END AS u, CASE WHEN c_custkey % 4 = 0 THEN '2020' WHEN c_custkey % 4 = 1 THEN 'soon' ELSE '' END AS d FROM customer),
 k AS (SELECT c_custkey, trim(n) AS n, race, CASE WHEN c_custkey % 2 = 0 THEN 'https://host.org/x' || c_custkey ELSE 'http://host.org/y' || c_custkey END AS url, CASE WHEN d = '2020' THEN '2020-01-01' ELSE d END AS d FROM j)
 SELECT race, url AS source_url, 'campaign_page' AS source_type, d AS publication_date, substr(sha256(trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') || chr(10) || race || chr(10) || url || chr(10) || 'campaign_page'), 1, 24) AS document_id,
 array_to_string(list_filter([CASE WHEN n = '' THEN 'candidate_name is required' END, CASE WHEN d = 'soon' THEN 'publication_date is no date' END], lambda x: x IS NOT NULL), '; ') AS errors FROM k""")
def document_jobs(spark, sf_dir):
    """Queue rows in one form, with a fixed id and what is wrong with them."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(key % 9 == 0, " ").otherwise(F.col("c_name")).alias("candidate_name"),
        F.col("c_nationkey").cast("string").alias("race_id"),
        F.lit("endorsed").alias("role"),
        F.lit("2020-06-01").alias("election_date"),
        F.when(key % 2 == 0, F.concat(F.lit("https://host.org/x"), key.cast("string"), F.lit(" | https://other.org/"))).alias("source_url"),
        F.concat(F.lit("HTTP://Host.org/y"), key.cast("string")).alias("seed_url"),
        F.when(key % 4 == 0, "2020").when(key % 4 == 1, "soon").alias("published_date"),
    )
    return C.jobs(rows).select(F.col("race_id").alias("race"), "source_url", "source_type", "publication_date", "document_id", F.array_join("errors", "; ").alias("errors"))
