"""Text statistics over documents: two groups by source number, tokens, weights, prevalence, duplicates, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats
from ..operators.relational import checkpointed
from .registry import query, spread, table


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---- SQL of the text functions -------------------------------------------------------------------------------------


def sql_stem(t: str, skip_joined: bool = False) -> str:
    joined = f"WHEN contains({t}, '_') THEN {t} " if skip_joined else ""
    return (
        f"CASE {joined}WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN regexp_replace({t}, 'ies$', 'y') WHEN {t} LIKE '%sses' THEN regexp_replace({t}, 'es$', '') "
        f"WHEN {t} LIKE '%s' AND length({t}) > 4 AND NOT regexp_matches({t}, '(ss|us|is)$') THEN regexp_replace({t}, 's$', '') ELSE {t} END"
    )


def sql_tokens(column: str) -> str:
    low = f"translate(lower(coalesce({column}, '')), '’‘“”–—', '''''\"\"--')"
    for pattern, word in T.PHRASES:
        low = f"regexp_replace({low}, '{pattern}', '{word}', 'g')"
    found = f"regexp_extract_all({low}, '[a-z][a-z_''-]+')"
    found = f"list_transform({found}, lambda t: regexp_replace(regexp_replace(t, '^[-'']+|[-'']+$', '', 'g'), '''s$', ''))"
    found = f"list_transform({found}, lambda t: {sql_stem('t', True)})"
    return f"list_filter({found}, lambda t: length(t) > 2 AND t NOT IN ({quoted([*T.STOPWORDS, *T.DOMAIN_STOPWORDS])}))"


SQL_BIGRAMS = "CASE WHEN len(tokens) >= 2 THEN list_transform(list_zip(tokens[1:len(tokens) - 1], tokens[2:]), lambda p: p[1] || ' ' || p[2]) ELSE [] END"
SQL_SEGMENT = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')"
SQL_NORMALISED = "lower(trim(regexp_replace(translate(text, '’‘“”–—', '''''\"\"--'), '\\s+', ' ', 'g')))"
SQL_GROUP = "CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'endorsed' ELSE 'opponent' END"
SQL_TOKENS = f"tok AS (SELECT doc_id, lang, source, {SQL_GROUP} AS grp, {sql_tokens('text')} AS tokens FROM documents)"
SQL_TERMS = f"{SQL_TOKENS}, terms AS (SELECT doc_id, grp, unnest(tokens) AS term FROM tok)"
SQL_FEATURES = f"{SQL_TOKENS}, feats AS (SELECT doc_id, grp, unnest(list_concat(tokens, {SQL_BIGRAMS})) AS feature FROM tok)"


def grouped(spark, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, grp, tokens of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    group = F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "endorsed").otherwise("opponent")
    return docs.select("doc_id", "lang", "source", group.alias("grp"), T.tokens(F.col("text")).alias("tokens"))


def digest(words: Column) -> Column:
    return F.md5(F.array_join(words, " "))


# ---- tokens --------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok")
def tokens(spark, sf_dir):
    return grouped(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), digest(F.col("tokens")).alias("tokens_md5"))


@query(f"SELECT doc_id, CAST(len({SQL_SEGMENT}) AS BIGINT) AS n FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.segment_tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) AS words_md5 FROM documents")
def generic_words(spark, sf_dir):
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.generic_tokens(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n"), digest(F.col("w")).alias("words_md5"))


@query(f"WITH {SQL_TOKENS} SELECT doc_id, CAST(len({SQL_BIGRAMS}) AS BIGINT) AS n_bigrams, md5(array_to_string({SQL_BIGRAMS}, '|')) AS bigrams_md5 FROM tok")
def bigrams(spark, sf_dir):
    made = grouped(spark, sf_dir).select("doc_id", T.bigrams(F.col("tokens")).alias("b"))
    return made.select("doc_id", F.size("b").cast("long").alias("n_bigrams"), F.md5(F.array_join("b", "|")).alias("bigrams_md5"))


# ---- two-group statistics ------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_TERMS},
 tf AS (SELECT doc_id, grp, term, count(*) AS n FROM terms GROUP BY ALL), len AS (SELECT doc_id, len(tokens) AS total FROM tok),
 df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), sizes AS (SELECT grp, count(*) AS docs FROM tok GROUP BY grp), n AS (SELECT count(*) AS docs FROM tok),
 s AS (SELECT tf.grp, tf.term, sum(CAST(tf.n AS DOUBLE) / total * (ln((1.0 + n.docs) / (1 + d)) + 1)) AS w FROM tf JOIN len USING (doc_id) JOIN df USING (term), n GROUP BY ALL),
 m AS (SELECT term, coalesce(max(w) FILTER (WHERE s.grp = 'endorsed') / max(docs) FILTER (WHERE s.grp = 'endorsed'), 0) AS a, coalesce(max(w) FILTER (WHERE s.grp = 'opponent') / max(docs) FILTER (WHERE s.grp = 'opponent'), 0) AS b FROM s JOIN sizes USING (grp) GROUP BY term)
 SELECT term, round(a, 6) AS endorsed, round(b, 6) AS opponent, round(a - b, 6) AS difference FROM m ORDER BY abs(round(a - b, 8)) DESC, term LIMIT 500""")
def group_tfidf(spark, sf_dir):
    made = stats.group_tfidf(grouped(spark, sf_dir), "doc_id", "grp", "tokens", ("endorsed", "opponent"))
    top = made.orderBy(F.desc(F.abs(F.round("difference", 8))), "term").limit(500)
    return top.select("term", *(F.round(c, 6).alias(c) for c in ("endorsed", "opponent", "difference")))


@query(f"""WITH {SQL_FEATURES}, c AS (SELECT feature, count(*) FILTER (WHERE grp = 'endorsed') AS a, count(*) FILTER (WHERE grp = 'opponent') AS b FROM feats GROUP BY feature),
 t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c),
 x AS (SELECT feature, a, b, ta, tb, 1000.0 * (a + b) / greatest(ta + tb, 1) AS alpha FROM c, t WHERE a + b >= 5),
 z AS (SELECT feature, a, b, (ln((a + alpha) / greatest(ta + 1000.0 - a - alpha, 1e-9)) - ln((b + alpha) / greatest(tb + 1000.0 - b - alpha, 1e-9))) / sqrt(1 / (a + alpha) + 1 / (b + alpha)) AS z FROM x)
 SELECT feature, CAST(a AS BIGINT) AS endorsed_count, CAST(b AS BIGINT) AS opponent_count, round(z, 5) AS z_score, CASE WHEN z >= 0 THEN 'endorsed' ELSE 'opponent' END AS favored_group FROM z""")
def mpif(spark, sf_dir):
    made = stats.log_odds(grouped(spark, sf_dir), "grp", "tokens", ("endorsed", "opponent"), least=5)
    return made.select("feature", "endorsed_count", "opponent_count", F.round("z_score", 5).alias("z_score"), "favored_group")


SQL_PREVALENCE = f"""WITH {SQL_FEATURES}, d AS (SELECT DISTINCT doc_id, grp, feature FROM feats), c AS (SELECT feature, count(*) FILTER (WHERE grp = 'endorsed') AS a, count(*) FILTER (WHERE grp = 'opponent') AS b FROM d GROUP BY feature),
 g AS (SELECT greatest(count(*) FILTER (WHERE grp = 'endorsed'), 1) AS na, greatest(count(*) FILTER (WHERE grp = 'opponent'), 1) AS nb FROM tok),
 p AS (SELECT feature, CAST(a AS BIGINT) AS endorsed_documents, CAST(b AS BIGINT) AS opponent_documents, round(CAST(a AS DOUBLE) / na, 6) AS endorsed_share, round(CAST(b AS DOUBLE) / nb, 6) AS opponent_share, round(CAST(a AS DOUBLE) / na - CAST(b AS DOUBLE) / nb, 6) AS difference FROM c, g WHERE a + b >= 10)"""


@query(f"{SQL_PREVALENCE} SELECT * FROM p")
def feature_prevalence(spark, sf_dir):
    return stats.prevalence(grouped(spark, sf_dir), "doc_id", "grp", "tokens", ("endorsed", "opponent"), least=10)


#: Stand-ins for the policy features, which the synthetic prose lacks.
POLICY = ("ing", "tion", "ther", "ent", "her", "tiona", "ist", "ung", "ent her", "ing tion")


@query(f"{SQL_PREVALENCE} SELECT feature, endorsed_share, opponent_share, least(endorsed_share, opponent_share) AS shared_emphasis, round(abs(endorsed_share - opponent_share), 6) AS share_gap FROM p WHERE feature IN ({quoted(POLICY)}) AND least(endorsed_share, opponent_share) >= 0.01")
def policy_overlap(spark, sf_dir):
    return stats.overlap(feature_prevalence(spark, sf_dir), POLICY, least=0.01)


@query(f"""WITH {SQL_TOKENS}, t AS (SELECT lang, grp, unnest(tokens) AS term FROM tok), c AS (SELECT lang, term, count(*) FILTER (WHERE grp = 'endorsed') AS a, count(*) FILTER (WHERE grp = 'opponent') AS b FROM t GROUP BY ALL)
 SELECT lang, round(coalesce(sum(CAST(a AS DOUBLE) * b) / nullif(sqrt(sum(CAST(a AS DOUBLE) * a)) * sqrt(sum(CAST(b AS DOUBLE) * b)), 0), 0), 6) AS cosine FROM c GROUP BY lang""")
def bow_cosine(spark, sf_dir):
    return stats.bag_cosine(grouped(spark, sf_dir), ["lang"], "grp", "tokens", ("endorsed", "opponent"))


SQL_HOT = f"""WITH lab AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'hot' WHEN l.toxic = 0 THEN 'cold' ELSE 'shared' END AS grp, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS tokens FROM documents d LEFT JOIN labels l USING (doc_id)),
 k AS (SELECT * FROM lab WHERE len(tokens) > 0), tf AS (SELECT doc_id, grp, term, count(*) AS n FROM (SELECT doc_id, grp, unnest(tokens) AS term FROM k) GROUP BY ALL),
 n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE grp = 'hot') AS h, count(*) FILTER (WHERE grp = 'cold') AS c FROM k),
 df AS (SELECT term, count(*) AS d, count(*) FILTER (WHERE grp = 'hot') AS dh, count(*) FILTER (WHERE grp = 'cold') AS dc FROM tf GROUP BY term HAVING count(*) >= 5),
 w AS (SELECT tf.term, coalesce(sum(CAST(tf.n AS DOUBLE) / len(k.tokens)) FILTER (WHERE tf.grp = 'hot'), 0) AS sh, coalesce(sum(CAST(tf.n AS DOUBLE) / len(k.tokens)) FILTER (WHERE tf.grp = 'cold'), 0) AS sc FROM tf JOIN k USING (doc_id) GROUP BY tf.term),
 p AS (SELECT term, sh / greatest(h, 1) * (ln((1 + n) / (1 + d)) + 1) - sc / greatest(c, 1) * (ln((1 + n) / (1 + d)) + 1) AS dt,
   CASE WHEN dh = 0 OR h = 0 THEN -1 WHEN dh >= n THEN 1 ELSE ln((dh / n) / ((d / n) * (h / n))) / -ln(dh / n) END - CASE WHEN dc = 0 OR c = 0 THEN -1 WHEN dc >= n THEN 1 ELSE ln((dc / n) / ((d / n) * (c / n))) / -ln(dc / n) END AS dn FROM df JOIN w USING (term), n),
 r AS (SELECT term, round(dt, 6) AS tfidf_difference, round(dn, 6) AS npmi_difference, CASE WHEN dt + dn >= 0 THEN 'hot' ELSE 'cold' END AS favored_group, abs(round(dt, 6)) + abs(round(dn, 6)) AS strength FROM p)"""


def hot_cold(spark, sf_dir):
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels")
    group = F.when(F.col("toxic") == 1, "hot").when(F.col("toxic") == 0, "cold").otherwise("shared")
    base = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").select("doc_id", group.alias("grp"), T.generic_tokens(F.col("text")).alias("tokens"))
    return stats.hot_cold(base, "doc_id", "grp", "tokens", "hot", "cold", least=5)


@query(f"{SQL_HOT} SELECT term, tfidf_difference, npmi_difference, favored_group FROM r")
def hot_cold_terms(spark, sf_dir):
    return hot_cold(spark, sf_dir).drop("strength")


@query(f"""{SQL_HOT}, o AS (SELECT term, favored_group, row_number() OVER (PARTITION BY favored_group ORDER BY strength DESC, term) AS rn, count(*) OVER (PARTITION BY favored_group) AS size FROM r),
 q AS (SELECT unnest([0.1, 0.2, 0.3, 0.4]) AS q) SELECT favored_group, term FROM o, q WHERE rn <= ceil(size * q) AND rn <= 200 GROUP BY ALL HAVING count(DISTINCT q) = 4""")
def quantile_stable_terms(spark, sf_dir):
    return stats.quantile_stable(hot_cold(spark, sf_dir), "favored_group", "term", "strength", (0.1, 0.2, 0.3, 0.4), top=200)


@query(f"""WITH {SQL_TERMS}, d AS (SELECT DISTINCT doc_id, grp, term FROM terms), n AS (SELECT grp, count(*) AS docs FROM tok GROUP BY grp), bg AS (SELECT term, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tok) AS share FROM d GROUP BY term),
 x AS (SELECT d.grp, d.term, count(*) AS c, CAST(count(*) AS DOUBLE) / max(docs) AS share FROM d JOIN n USING (grp) GROUP BY ALL HAVING count(*) >= greatest(3, max(docs) // 100)),
 s AS (SELECT x.grp, x.term, round(x.share * ln((x.share + 0.002) / (bg.share + 0.002)), 8) AS score, round(x.share, 8) AS share FROM x JOIN bg USING (term)),
 o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, share DESC, term DESC) AS rn FROM s) SELECT grp, term, round(score, 6) AS score, CAST(rn AS BIGINT) AS rank FROM o WHERE rn <= 5""")
def region_terms(spark, sf_dir):
    return stats.distinctive_terms(grouped(spark, sf_dir), "doc_id", "grp", "tokens", top=5)


#: Topics and seed patterns for the keyword baseline.
TOPICS = (("articles", ("the", "der", "les")), ("endings", ("tion", "ung", "ment", "ing")), ("pairs", ("th", "ch")))


@query(
    "WITH s AS (SELECT doc_id, code, ord, score FROM (SELECT doc_id, unnest(["
    + ", ".join(f"{{'code': '{c}', 'ord': {k}, 'score': ({' + '.join(f'CAST(regexp_matches(lower(text), {chr(39)}(^|[^a-z0-9_]){w}($|[^a-z0-9_]){chr(39)}) AS INTEGER)' for w in seeds)}) / sqrt({len(seeds)})}}" for k, (c, seeds) in enumerate(TOPICS))
    + "], recursive := true) FROM documents)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM s) SELECT doc_id, CASE WHEN score > 0 THEN code ELSE 'unclassified' END AS topic, round(score, 6) AS score FROM b WHERE rn = 1"
)
def keyword_topics(spark, sf_dir):
    return stats.keyword_topics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", TOPICS)


# ---- duplicates, boilerplate, provenance ---------------------------------------------------------------------------


@query(f"WITH h AS (SELECT doc_id, sha256({SQL_NORMALISED}) AS hash FROM documents) SELECT doc_id, hash, CAST(count(*) OVER (PARTITION BY hash) AS BIGINT) AS n_same FROM h")
def exact_dupes(spark, sf_dir):
    hashed = checkpointed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.exact_hash(F.col("text")).alias("hash")))  # texts are read once
    return stats.with_counts(hashed, "hash", "n_same")


SQL_NEAR = f"""CASE WHEN len(inf) < 6 THEN '' ELSE sha256(array_to_string(list_sort(list_distinct(inf)), ' ')) END"""
SQL_INF = f"list_transform(list_filter({SQL_SEGMENT}, lambda t: length(t) > 2 AND t NOT IN ({quoted(T.UNINFORMATIVE)})), lambda t: {sql_stem('t')})"


@query(f"WITH i AS (SELECT doc_id, {SQL_INF} AS inf FROM documents), h AS (SELECT doc_id, {SQL_NEAR} AS hash FROM i) SELECT doc_id, hash, CASE WHEN hash = '' THEN 1 ELSE CAST(count(*) OVER (PARTITION BY hash) AS BIGINT) END AS n_same FROM h")
def near_dupes(spark, sf_dir):
    hashed = checkpointed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.near_hash(F.col("text")).alias("hash")))  # texts are read once
    counted = stats.with_counts(hashed.filter("hash <> ''"), "hash", "n_same")
    return counted.unionByName(hashed.filter("hash = ''").withColumn("n_same", F.lit(1).cast("long")))


@query(f"""WITH i AS (SELECT doc_id, {SQL_NORMALISED} AS norm, {SQL_INF} AS inf, len({SQL_SEGMENT}) AS tc FROM documents), h AS (SELECT doc_id, norm, tc, sha256(norm) AS eh, {SQL_NEAR} AS nh FROM i),
 c AS (SELECT *, count(*) OVER (PARTITION BY eh) AS ne, count(*) OVER (PARTITION BY nh) AS nn FROM h)
 SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(norm, '{p}') THEN 'phrase:{p}' END" for p in T.BOILERPLATE)}, CASE WHEN ne > 1 AND tc <= 80 THEN 'repeated_cross_document_exact' WHEN nh <> '' AND nn > 1 AND tc <= 80 THEN 'repeated_cross_document_near' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM c""")
def boilerplate_flags(spark, sf_dir):
    return stats.boilerplate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", max_tokens=80)


@query("""SELECT lang, md5(text) AS text_md5, min(doc_id) AS first_doc, array_to_string(list_sort(list_distinct(list(source))), ' | ') AS sources, CAST(count(*) AS BIGINT) AS provenance_rows FROM documents GROUP BY lang, md5(text)""")
def provenance_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    return docs.groupBy("lang", "text_md5").agg(F.min("doc_id").alias("first_doc"), T.joined_distinct(F.col("source")).alias("sources"), F.count("*").alias("provenance_rows"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', '\n', 'g'), '\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents)
 SELECT doc_id, CAST(i AS BIGINT) AS place, md5(ps[i]) AS paragraph_md5 FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)""")
def paragraphs(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.paragraphs(F.regexp_replace("text", "\n", "\n\n")).alias("ps"))
    return lines.select("doc_id", F.posexplode("ps")).select("doc_id", (F.col("pos") + 1).cast("long").alias("place"), F.md5("col").alias("paragraph_md5"))


@query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def doc_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return stats.ordered_concat(turns, ["conv_id"], "turn", "text").select("conv_id", F.md5("joined").alias("text_md5"), F.col("n").alias("turns"))


@query(f"SELECT d.doc_id, CAST(len({SQL_SEGMENT}) AS BIGINT) AS token_count FROM documents d LEFT JOIN labels l USING (doc_id) WHERE trim(text) <> '' AND coalesce(l.quality, 1) <> 0 AND len({SQL_SEGMENT}) >= 20")
def eligible_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    counted = docs.filter((F.trim("text") != "") & (F.coalesce("quality", F.lit(1)) != 0)).select("doc_id", F.size(T.segment_tokens(F.col("text"))).cast("long").alias("token_count"))
    return counted.filter("token_count >= 20")


@query(f"""WITH g AS (SELECT lang, {SQL_GROUP} AS grp FROM documents), c AS (SELECT lang, count(*) FILTER (WHERE grp = 'endorsed') AS a, count(*) FILTER (WHERE grp = 'opponent') AS b FROM g GROUP BY lang), t AS (SELECT greatest(sum(a), 1) AS ta, greatest(sum(b), 1) AS tb FROM c)
 SELECT lang, CAST(a AS BIGINT) AS count_a, CAST(b AS BIGINT) AS count_b, round(CAST(a AS DOUBLE) / ta, 6) AS share_a, round(CAST(b AS DOUBLE) / tb, 6) AS share_b, round(CAST(a AS DOUBLE) / ta - CAST(b AS DOUBLE) / tb, 6) AS difference FROM c, t""")
def group_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "endorsed").otherwise("opponent"))
    return stats.group_shares(docs, "lang", "grp", ("endorsed", "opponent"))


@query(f"""SELECT {SQL_GROUP} AS grp, CAST(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS labelled, CAST(count(*) AS BIGINT) AS documents, round(CAST(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def coverage_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    grp = F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "endorsed").otherwise("opponent")
    made = docs.groupBy(grp.alias("grp")).agg(F.count("has").alias("labelled"), F.count("*").alias("documents"))
    return made.withColumn("share", F.round(F.col("labelled") / F.greatest("documents", F.lit(1)), 6))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang, md5(text) ORDER BY doc_id) AS rn, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS ro FROM (SELECT d.doc_id, source, lang, text, quality FROM documents d LEFT JOIN labels l USING (doc_id)))
 SELECT doc_id, source, lang FROM r WHERE (quality = 1 AND rn = 1)""")
def evidence_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("h", F.md5("text"))
    first = docs.groupBy("source", "lang", "h").agg(F.min_by(F.struct("doc_id", "quality"), "doc_id").alias("r"))
    return first.filter("r.quality = 1").select("r.doc_id", "source", "lang")


#: Phrases whose mention counts unless it is negated.
MECHANISMS = ((r"\bthe\s+of\b|\bof\s+the\b", "of_the"), (r"\bin\s+the\b", "in_the"), (r"\bde\s+la\b", "de_la"))


@query(
    "WITH m AS (SELECT doc_id, lang, "
    + SQL_GROUP
    + " AS grp, text, unnest(["
    + ", ".join(f"{{'feature': '{f}', 'hit': regexp_extract(text, '(?i)(^|[^a-z0-9_])({p.replace(chr(92) + 'b', '')})($|[^a-z0-9_])', 0)}}" for p, f in MECHANISMS)
    + """], recursive := true) FROM documents), k AS (SELECT lang, grp, feature, doc_id FROM m WHERE hit <> ''), s AS (SELECT lang, feature, count(*) FILTER (WHERE grp = 'endorsed') AS a, count(*) FILTER (WHERE grp = 'opponent') AS b, min(doc_id) FILTER (WHERE grp = 'endorsed') AS ea, min(doc_id) FILTER (WHERE grp = 'opponent') AS eb FROM k GROUP BY ALL)
 SELECT lang, feature, CAST(a AS BIGINT) AS endorsed, CAST(b AS BIGINT) AS opponent, ea AS endorsed_example, eb AS opponent_example FROM s WHERE a > 0 AND b > 0"""
)
def shared_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "endorsed").otherwise("opponent"))
    plain = tuple((f"(^|[^a-z0-9_])({p.replace(chr(92) + 'b', '')})($|[^a-z0-9_])", f) for p, f in MECHANISMS)
    return stats.two_sided_mentions(docs, ["lang"], "grp", "doc_id", "text", plain, ("endorsed", "opponent"), skip_negated=False)


_EDGE, _OUT = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
SQL_NEGATION = T.NEGATION.replace("\\b", _EDGE).replace("'", "''")


def _sql_inner(pattern: str) -> str:
    """The pattern's alternatives and the edge after them, with word edges as classes of characters, which both engines read alike."""
    return "(?:" + "|".join(x.removeprefix("\\b").removesuffix("\\b") for x in pattern.split("|")) + ")" + _OUT


@query(
    "WITH m AS (SELECT doc_id, lang, "
    + SQL_GROUP
    + " AS grp, unnest(["
    + ", ".join(f"{{'feature': '{f}', 'hit': regexp_matches(text, '(?i){_EDGE}{_sql_inner(p)}'), 'before': regexp_extract(text, '(?is)^(.*?{_EDGE}){_sql_inner(p)}', 1)}}" for p, f in MECHANISMS)
    + f"""], recursive := true) FROM documents), k AS (SELECT * FROM m WHERE hit AND NOT regexp_matches(lower(regexp_extract(before, '[^.!?\n]*$')), '{SQL_NEGATION}')),
 s AS (SELECT lang, feature, count(*) FILTER (WHERE grp = 'endorsed') AS a, count(*) FILTER (WHERE grp = 'opponent') AS b, min(doc_id) FILTER (WHERE grp = 'endorsed') AS ea, min(doc_id) FILTER (WHERE grp = 'opponent') AS eb FROM k GROUP BY ALL)
 SELECT lang, feature, CAST(a AS BIGINT) AS endorsed, CAST(b AS BIGINT) AS opponent, ea AS endorsed_example, eb AS opponent_example FROM s WHERE a > 0 AND b > 0"""
)
def affirmative_mentions(spark, sf_dir):
    """With the negation test, which looks back over the sentence before a text's first mention."""
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "endorsed").otherwise("opponent"))
    return stats.two_sided_mentions(docs, ["lang"], "grp", "doc_id", "text", MECHANISMS, ("endorsed", "opponent"))


SQL_WEIGHTS = """w0 AS (SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, user_id % 7 AS race, user_id AS cand FROM events),
 nr AS (SELECT grp, count(DISTINCT race) AS r FROM w0 GROUP BY grp), nc AS (SELECT grp, race, count(DISTINCT cand) AS c FROM w0 GROUP BY grp, race), nn AS (SELECT grp, race, cand, count(*) AS n FROM w0 GROUP BY ALL),
 w AS (SELECT w0.*, 1.0 / r / c / n AS weight FROM w0 JOIN nr USING (grp) JOIN nc USING (grp, race) JOIN nn USING (grp, race, cand))"""


def weighted_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("grp"), (F.col("user_id") % 7).alias("race"), F.col("user_id").alias("cand"))
    return stats.balanced_weights(rows, "grp", "race", "cand")


@query(f"WITH {SQL_WEIGHTS} SELECT event_id, round(weight, 9) AS weight FROM w")
def balanced_weights(spark, sf_dir):
    return weighted_events(spark, sf_dir).select("event_id", F.round("weight", 9).alias("weight"))


@query(f"WITH {SQL_WEIGHTS}, s AS (SELECT event_type, coalesce(sum(weight) FILTER (WHERE grp = 'a'), 0) AS a, coalesce(sum(weight) FILTER (WHERE grp = 'b'), 0) AS b FROM w GROUP BY event_type) SELECT event_type AS narrative, round(a, 6) AS share_a, round(b, 6) AS share_b, round(log2((a + 1e-6) / (b + 1e-6)), 5) AS lift, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS favored_group FROM s")
def narrative_lift(spark, sf_dir):
    return stats.lift(weighted_events(spark, sf_dir), "event_type", "grp", "weight", ("a", "b"))
