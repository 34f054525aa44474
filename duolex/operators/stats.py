"""Two-group text statistics as DataFrame operators. group columns hold the names given as pair; other groups count only where said.

Tokens are exploded with explode_outer and nulls dropped afterwards: for a plain
explode the optimizer adds a filter on the array's size below it, which would
tokenise every text once more.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import checkpointed


def count_if(group: str, value: str):
    return F.count(F.when(F.col(group) == value, 1))


def sum_if(group: str, value: str, what):
    return F.coalesce(F.sum(F.when(F.col(group) == value, what)), F.lit(0.0))


def term_sums(df: DataFrame, group: str, tokens: str, pair: tuple[str, str]) -> DataFrame:
    """term, df, df_0 and df_1 (documents, and those of each group), tf_0 and tf_1 (sums of the term's shares of the groups' documents).

    A document gives a row for each token, with its part of the document, and
    one for each different token, so that all is summed by term at once and no
    shuffle has documents in its key. The row without a term counts documents
    that have tokens.
    """
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("share"), F.lit(1).alias("first")))
    each = F.transform(tokens, lambda t: F.struct(t.alias("term"), (1.0 / F.size(tokens)).alias("share"), F.lit(0).alias("first")))
    first = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("share"), F.lit(1).alias("first")))
    rows = df.select(group, F.explode_outer(F.when(F.size(tokens) > 0, F.concat(none, each, first))).alias("x")).filter("x is not null")
    own = lambda g, what: F.coalesce(F.sum(F.when(F.col(group) == g, what)), F.lit(0))
    sums = [f(g).alias(f"{n}_{k}") for k, g in enumerate(pair) for n, f in (("df", lambda g: own(g, F.col("x.first"))), ("tf", lambda g: own(g, F.col("x.share"))))]
    return rows.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.first").alias("df"), *sums)


def group_tfidf(df: DataFrame, id_col: str, group: str, tokens: str, pair: tuple[str, str], sums: DataFrame | None = None) -> DataFrame:
    """term, the mean TF-IDF of each group's documents (empty ones included) and their difference. idf = ln((1 + N) / (1 + df)) + 1. sums: the term_sums, if they are there.

    As idf is a factor of the term, term frequencies are summed first; one shuffle by term.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(group).agg(F.count("*")).collect()}
    total = sum(sizes.values())
    by_term = (term_sums(df, group, tokens, pair) if sums is None else sums).filter("term is not null")
    idf = F.log((1.0 + total) / (1 + F.col("df"))) + 1
    made = by_term.select("term", *((F.col(f"tf_{k}") * idf / max(1, sizes.get(g, 0))).alias(g) for k, g in enumerate(pair)))
    return made.withColumn("difference", F.col(pair[0]) - F.col(pair[1]))


def features(df: DataFrame, *columns: str, tokens: str) -> DataFrame:
    """The columns and each unigram and bigram as feature, with repeats."""
    return df.select(*columns, F.explode_outer(F.concat(tokens, T.bigrams(F.col(tokens)))).alias("feature")).filter("feature is not null")


def log_odds(df: DataFrame, group: str, tokens: str, pair: tuple[str, str], least: int = 5, mass: float = 1000.0) -> DataFrame:
    """Log odds with an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008) over unigrams and bigrams of at least least occurrences."""
    a, b = pair
    counts = features(df.filter(F.col(group).isin(a, b)), group, tokens=tokens).groupBy("feature").agg(count_if(group, a).alias("a"), count_if(group, b).alias("b"))
    totals = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("ta"), F.coalesce(F.sum("b"), F.lit(0)).alias("tb"))
    made = counts.filter(F.col("a") + F.col("b") >= least).crossJoin(F.broadcast(totals))  # one row
    made = made.withColumn("alpha", mass * (F.col("a") + F.col("b")) / F.greatest(F.col("ta") + F.col("tb"), F.lit(1)))

    def odds(n: str, total: str):
        return F.log((F.col(n) + F.col("alpha")) / F.greatest(F.col(total) + mass - F.col(n) - F.col("alpha"), F.lit(1e-9)))

    z = (odds("a", "ta") - odds("b", "tb")) / F.sqrt(1 / (F.col("a") + F.col("alpha")) + 1 / (F.col("b") + F.col("alpha")))
    return made.select("feature", F.col("a").alias(f"{a}_count"), F.col("b").alias(f"{b}_count"), z.alias("z_score"), F.when(z >= 0, a).otherwise(b).alias("favored_group"))


def prevalence(df: DataFrame, id_col: str, group: str, tokens: str, pair: tuple[str, str], least: int = 10) -> DataFrame:
    """Share of each group's documents that hold a unigram or bigram, for those in at least least documents."""
    a, b = pair
    sizes = {r[0]: r[1] for r in df.groupBy(group).agg(F.count("*")).collect()}
    own = df.select(group, F.explode_outer(F.array_distinct(F.concat(tokens, T.bigrams(F.col(tokens))))).alias("feature")).filter("feature is not null")
    counts = own.groupBy("feature").agg(count_if(group, a).alias(f"{a}_documents"), count_if(group, b).alias(f"{b}_documents"))
    counts = counts.filter(F.col(f"{a}_documents") + F.col(f"{b}_documents") >= least)
    share = {g: F.col(f"{g}_documents") / max(1, sizes.get(g, 0)) for g in pair}
    return counts.select("*", *(F.round(share[g], 6).alias(f"{g}_share") for g in pair), F.round(share[a] - share[b], 6).alias("difference"))


def overlap(prevalent: DataFrame, wanted: tuple[str, ...], least: float = 0.01) -> DataFrame:
    """Wanted features that both groups' documents hold in at least the least share."""
    shared = F.least("endorsed_share", "opponent_share")
    made = prevalent.filter(F.col("feature").isin(*wanted) & (shared >= least))
    return made.select("feature", "endorsed_share", "opponent_share", shared.alias("shared_emphasis"), F.round(F.abs(F.col("endorsed_share") - F.col("opponent_share")), 6).alias("share_gap"))


def bag_cosine(df: DataFrame, keys: list[str], group: str, tokens: str, pair: tuple[str, str]) -> DataFrame:
    """Cosine of the two groups' token counts for each key; 0 if a group has no tokens."""
    counts = df.select(*keys, group, F.explode_outer(tokens).alias("term")).filter("term is not null").groupBy(*keys, "term").agg(count_if(group, pair[0]).cast("double").alias("a"), count_if(group, pair[1]).cast("double").alias("b"))
    cosine = F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))
    return counts.groupBy(*keys).agg(F.round(F.coalesce(cosine, F.lit(0.0)), 6).alias("cosine"))


def hot_cold(df: DataFrame, id_col: str, group: str, tokens: str, hot: str, cold: str, least: int = 1, sums: DataFrame | None = None) -> DataFrame:
    """Differences of mean TF-IDF and of normalised pointwise mutual information; documents of other groups count in the corpus only. sums: the term_sums, if they are there."""
    sums = checkpointed(term_sums(df, group, tokens, (hot, cold))) if sums is None else sums  # a row for each term; texts are read once
    counted = sums.filter("term is null").first()
    if counted is None or not counted.df_0 or not counted.df_1:
        raise ValueError("both comparison groups need documents")
    sizes, total = {hot: counted.df_0, cold: counted.df_1}, float(counted.df)
    by_term = sums.filter("term is not null")
    by_term = by_term.filter(F.col("df") >= least)
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1

    def npmi(k: int, size: int):
        both = F.col(f"df_{k}") / total
        return F.when(both == 0, -1.0).when(both >= 1, 1.0).otherwise(F.log(both / ((F.col("df") / total) * (size / total))) / -F.log(both))

    tfidf = F.col("tf_0") / sizes[hot] * idf - F.col("tf_1") / sizes[cold] * idf
    information = npmi(0, sizes[hot]) - npmi(1, sizes[cold])
    made = by_term.select("term", tfidf.alias("t"), information.alias("i"))
    rounded = (F.round("t", 6).alias("tfidf_difference"), F.round("i", 6).alias("npmi_difference"))
    return made.select("term", *rounded, F.when(F.col("t") + F.col("i") >= 0, hot).otherwise(cold).alias("favored_group"), (F.abs(F.round("t", 6)) + F.abs(F.round("i", 6))).alias("strength"))


def quantile_stable(ranked: DataFrame, group: str, term: str, strength: str, quantiles: tuple[float, ...], top: int) -> DataFrame:
    """Terms of each group that are in the top slice at every quantile. A slice that holds the smallest one's terms holds them all, so the least decides."""
    sizes = {r[0]: r[1] for r in ranked.groupBy(group).agg(F.count("*")).collect()}
    found = None
    for name, size in sorted(sizes.items()):
        least = min(top, *(int(-(-size * q // 1)) for q in quantiles))
        own = ranked.filter(F.col(group) == name).orderBy(F.desc(strength), term).limit(least).select(group, term)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else ranked.select(group, term).limit(0)


def distinctive_terms(df: DataFrame, id_col: str, group: str, tokens: str, top: int = 5, smooth: float = 0.002) -> DataFrame:
    """Terms by share x ln((share + smooth) / (background share + smooth)); ties by share, then the term, descending."""
    sizes = df.groupBy(group).agg(F.count("*").alias("docs"))
    total = df.count()
    own = df.select(group, F.explode_outer(F.array_distinct(tokens)).alias("term")).filter("term is not null").groupBy(group, "term").agg(F.count("*").alias("c"))
    background = own.groupBy("term").agg((F.sum("c") / max(1, total)).alias("background"))
    made = own.join(sizes, group).filter(F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("docs") / 100))).join(background, "term")
    share = F.col("c") / F.col("docs")
    scored = made.select(group, "term", F.round(share * F.log((share + smooth) / (F.col("background") + smooth)), 8).alias("score"), F.round(share, 8).alias("share"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.desc("share"), F.desc("term")))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select(group, "term", F.round("score", 6).alias("score"), "rank")


def keyword_topics(df: DataFrame, id_col: str, text: str, topics) -> DataFrame:
    """The topic with the most seed patterns found, over the root of their number; the first topic wins ties.

    What lies between words becomes one blank, once for all seeds; a seed that
    is a plain word is then looked for as that, others as patterns.
    """
    low, words = F.col("__low"), F.col("__words")
    own = df.select(id_col, F.lower(F.col(text)).alias("__low"))
    own = own.select(id_col, "__low", F.concat(F.lit(" "), F.regexp_replace("__low", "[^a-z0-9_]+", " "), F.lit(" ")).alias("__words"))
    found = lambda w: words.contains(f" {w} ") if re.fullmatch("[a-z0-9_]+", w) else low.rlike(f"(^|[^a-z0-9_]){w}($|[^a-z0-9_])")
    scores = [(sum((found(w).cast("int") for w in seeds), F.lit(0)) / F.sqrt(F.lit(float(len(seeds))))) for _, seeds in topics]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(code).alias("code")) for k, (s, (code, _)) in enumerate(zip(scores, topics)))))
    made = own.select(id_col, best.alias("b"))
    return made.select(id_col, F.when(F.col("b.score") > 0, F.col("b.code")).otherwise("unclassified").alias("topic"), F.round("b.score", 6).alias("score"))


def with_counts(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with the number of rows of its key. Counted by a partial aggregate and joined, so that a key with many rows isn't one task's."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(out)), key)


def boilerplate(df: DataFrame, id_col: str, text: str, max_tokens: int = 80, phrases=T.BOILERPLATE) -> DataFrame:
    """Reasons why a text is boilerplate, joined by ' | '."""
    t = F.col(text)
    made = df.select(id_col, T.normalised(t).alias("norm"), F.size(T.segment_tokens(t)).alias("tc"), T.exact_hash(t).alias("eh"), T.near_hash(t).alias("nh"))
    found = [F.when(F.contains("norm", F.lit(p)), F.lit(f"phrase:{p}")) for p in sorted(phrases)]
    slim = checkpointed(made.select(id_col, F.array_join(F.array_compact(F.array(*found)), " | ").alias("by_phrase"), "tc", "eh", "nh"))  # hashes instead of texts, read three times
    counted = with_counts(with_counts(slim, "eh", "ne"), "nh", "nn")
    repeated = F.when((F.col("ne") > 1) & (F.col("tc") <= max_tokens), "repeated_cross_document_exact").when((F.col("nh") != "") & (F.col("nn") > 1) & (F.col("tc") <= max_tokens), "repeated_cross_document_near")
    return counted.select(id_col, F.concat_ws(" | ", F.nullif("by_phrase", F.lit("")), repeated).alias("reasons"))


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str, sep: str = " ") -> DataFrame:
    """keys, joined (texts in order), n."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias("joined"), F.count("*").alias("n"))


def group_shares(df: DataFrame, key: str, group: str, pair: tuple[str, str]) -> DataFrame:
    counts = df.groupBy(key).agg(count_if(group, pair[0]).alias("count_a"), count_if(group, pair[1]).alias("count_b"))
    totals = counts.agg(F.greatest(F.sum("count_a"), F.lit(1)).alias("ta"), F.greatest(F.sum("count_b"), F.lit(1)).alias("tb"))
    a, b = F.col("count_a") / F.col("ta"), F.col("count_b") / F.col("tb")
    return counts.crossJoin(F.broadcast(totals)).select(key, "count_a", "count_b", F.round(a, 6).alias("share_a"), F.round(b, 6).alias("share_b"), F.round(a - b, 6).alias("difference"))


def two_sided_mentions(df: DataFrame, keys: list[str], group: str, id_col: str, text: str, patterns, pair: tuple[str, str], skip_negated: bool = True) -> DataFrame:
    """Features that texts of both groups mention, by key; only a text's first mention of a feature is tested for negation."""
    t, found = F.col(text), []
    for pattern, feature in patterns:
        at = F.regexp_instr(t, F.lit(f"(?i){pattern}"))
        hit = at > 0
        found.append(F.when(hit & ~T.negated(t, at - 1) if skip_negated else t.rlike(f"(?i){pattern}"), F.lit(feature)))
    rows = df.select(*keys, group, id_col, F.explode(F.array_compact(F.array(*found))).alias("feature"))
    a, b = pair
    sides = rows.groupBy(*keys, "feature").agg(
        count_if(group, a).alias(a), count_if(group, b).alias(b), F.min(F.when(F.col(group) == a, F.col(id_col))).alias(f"{a}_example"), F.min(F.when(F.col(group) == b, F.col(id_col))).alias(f"{b}_example")
    )
    return sides.filter((F.col(a) > 0) & (F.col(b) > 0))


def balanced_weights(df: DataFrame, group: str, race: str, candidate: str) -> DataFrame:
    """weight = 1 / races of the group / candidates of group and race / rows of group, race and candidate."""
    rows = df.groupBy(group, race, candidate).agg(F.count("*").alias("__n"))
    races = rows.groupBy(group, race).agg(F.count("*").alias("__c"))
    groups = races.groupBy(group).agg(F.count("*").alias("__r"))
    weights = rows.join(races, [group, race]).join(groups, group).withColumn("weight", 1.0 / F.col("__r") / F.col("__c") / F.col("__n")).drop("__n", "__c", "__r")
    return df.join(weights, [group, race, candidate])


def lift(weighted: DataFrame, narrative: str, group: str, weight: str, pair: tuple[str, str], smooth: float = 1e-6) -> DataFrame:
    sums = weighted.groupBy(F.col(narrative).alias("narrative")).agg(*(sum_if(group, g, F.col(weight)).alias(f"s{k}") for k, g in enumerate(pair)))
    a, b = F.col("s0"), F.col("s1")
    return sums.select("narrative", F.round(a, 6).alias("share_a"), F.round(b, 6).alias("share_b"), F.round(F.log2((a + smooth) / (b + smooth)), 5).alias("lift"), F.when(a >= b, pair[0]).otherwise(pair[1]).alias("favored_group"))
