"""Flows over the corpus's registers: jobs, queues, races, audits, extraction batches, contexts and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions import urls as U
from ..functions.predicates import field
from . import ledger, stats
from .relational import checkpointed, written

#: What a candidate's row is known by.
CANDIDATE = ("race_id", "slug", "election_date", "role")
# The order in which seeds of a queue are searched.
SEEDS = {"campaign_domain": 1, "known_document": 2, "official_election_source": 3, "campaign_live_discovery": 4, "campaign_archive_discovery": 4}


def first_of(df: DataFrame, *columns: str) -> Column:
    """The first non-blank of those of the columns that the table has, else an empty text."""
    there = [F.nullif(field(F.col(c).cast("string")), F.lit("")) for c in columns if c in df.columns]
    return F.coalesce(*there, F.lit(""))


def document_id(name: Column, race: Column, url: Column, kind: Column) -> Column:
    return T.stable_hash(T.slug(name), F.trim(race), F.coalesce(U.canonical(url), F.lit("")), F.lower(F.trim(kind)))


def jobs(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Queue rows in one form: the first address given, source type, publication date and document id filled in from what there is.

    errors lists required columns that are blank and dates that aren't; with
    strict a row with any is an error.
    """
    url = U.normalise(F.trim(F.substring_index(first_of(rows, "source_url", "seed_url", "reference_url"), " | ", 1)))
    told = first_of(rows, "source_type", "source_type_class")
    day = first_of(rows, "publication_date", "published_date", "effective_date")
    made = rows.select(
        *(first_of(rows, c).alias(c) for c in ("queue_id", "race_id", "candidate_name", "role", "election_date", "archive_url", "notes", "transcript_text")),
        F.coalesce(url, F.lit("")).alias("source_url"),
        F.coalesce(F.nullif(told, F.lit("")), U.source_type(F.lit(""), url)).alias("source_type"),
        F.when(day.rlike(r"^\d{4}$"), F.concat(day, F.lit("-01-01"))).otherwise(day).alias("publication_date"),
        F.coalesce(F.nullif(first_of(rows, "analysis_scope"), F.lit("")), F.lit("analysis")).alias("analysis_scope"),
        first_of(rows, "document_id").alias("document_id"),
    )
    blank = [F.when(F.col(c) == "", F.lit(f"{c} is required")) for c in ("candidate_name", "race_id", "role", "election_date")]
    dates = [F.when((F.col(c) != "") & F.col(c).try_cast("date").isNull(), F.lit(f"{c} is no date")) for c in ("election_date", "publication_date")]
    own = document_id(F.col("candidate_name"), F.col("race_id"), F.col("source_url"), F.col("source_type"))
    made = made.withColumn("document_id", F.coalesce(F.nullif("document_id", F.lit("")), own)).withColumn("errors", F.array_compact(F.array(*blank, *dates)))
    if strict:
        made = made.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", "; ")).cast("array<string>")).otherwise(F.col("errors")))
    return made


def discovery_queue(evidence: DataFrame, roster: DataFrame) -> DataFrame:
    """Seeds to search for each candidate: the own domain, each known document, each official source; the same address of a kind once.

    evidence: CANDIDATE without slug, candidate_name, url, campaign_domain (NULL
    if none). roster: the same key, candidate_name, queue_id, official_source
    (a pipe list).
    """
    keyed = lambda df: df.filter(field(F.col("candidate_name")) != "").withColumn("slug", T.slug(F.col("candidate_name")))
    evidence, roster = keyed(evidence), keyed(roster)
    none = F.lit("")
    known = roster.select(*CANDIDATE, "candidate_name", "queue_id", "official_source", F.lit(0).alias("turn"))
    known = known.unionByName(evidence.select(*CANDIDATE, "candidate_name", none.alias("queue_id"), none.alias("official_source"), F.lit(1).alias("turn")))
    columns = ("candidate_name", "queue_id", "official_source")
    who = known.groupBy(*CANDIDATE).agg(F.min_by(F.struct(*columns), F.struct("turn", *columns)).alias("w")).select(*CANDIDATE, "w.*")
    own = evidence.groupBy(*CANDIDATE).agg(F.count_distinct("url").alias("known_sources"), F.min("campaign_domain").alias("campaign_domain"))
    base = who.join(own, [*CANDIDATE], "left").fillna({"known_sources": 0})
    common = [*CANDIDATE, "candidate_name", "queue_id", "campaign_domain", "known_sources"]
    seeds = (
        base.filter("campaign_domain is not null").select(*common, F.concat(F.lit("https://"), "campaign_domain", F.lit("/")).alias("seed_url"), F.lit("campaign_domain").alias("seed_kind"))
        .unionByName(base.join(evidence.select(*CANDIDATE, F.col("url").alias("seed_url")), [*CANDIDATE]).select(*common, "seed_url", F.lit("known_document").alias("seed_kind")))
        .unionByName(base.select(*common, F.explode(F.split("official_source", r"\s+\|\s+")).alias("s")).filter("trim(s) <> ''").select(*common, U.canonical(F.trim("s")).alias("seed_url"), F.lit("official_election_source").alias("seed_kind")))
    )
    kind = F.create_map(*(F.lit(x) for pair in SEEDS.items() for x in pair))
    once = seeds.filter("seed_url is not null").groupBy(*common, "seed_kind", "seed_url").agg(F.count("*")).drop("count(1)")
    seed_id = T.stable_hash(F.col("race_id"), F.col("candidate_name"), F.col("role"), F.col("seed_kind"), F.col("seed_url"))
    return once.withColumns({"seed_priority": kind[F.col("seed_kind")], "discovery_seed_id": seed_id, "current_status": F.lit("not_searched")})


#: What a race's packages fill in.
RACE_FIELDS = ("office", "jurisdiction", "state_code", "official_source")


def race_registry(corpus: DataFrame, packages: dict[str, DataFrame], in_scope: tuple[str, ...]) -> DataFrame:
    """A row for each race: its people by role, scope, and RACE_FIELDS from the first package that has them, with each field's status.

    corpus: race_id, candidate_name, role, party, election_date, body. packages,
    in order of precedence: race_id and RACE_FIELDS, one row a race. A race is
    in scope if someone endorsed or unopposed has one of in_scope's parties. A
    race with several election dates is in errors.
    """
    role = lambda *names: T.joined_distinct(F.when(F.col("role").isin(*names), F.col("candidate_name")))
    backed = F.col("role").isin("endorsed", "unopposed") & F.col("party").isin(*in_scope)
    races = corpus.groupBy("race_id").agg(
        F.min("election_date").alias("election_date"),
        (F.min("election_date") != F.max("election_date")).alias("errors"),
        F.coalesce(F.nullif(role("endorsed"), F.lit("")), role("unopposed")).alias("endorsed_candidate"),
        role("opponent").alias("opponents"),
        T.joined_distinct(F.col("body")).alias("endorsing_bodies"),
        F.when(F.bool_or(backed), "in_scope").otherwise("out_of_scope").alias("scope_kind"),
    )
    for name, package in packages.items():
        own = package.select("race_id", *(F.nullif(field(F.col(f)), F.lit("")).alias(f"{name}__{f}") for f in RACE_FIELDS))
        races = races.join(own, "race_id", "left")
    for f in RACE_FIELDS:
        status = F.coalesce(*(F.when(F.col(f"{n}__{f}").isNotNull(), F.lit(f"{n}_verified")) for n in packages), F.lit("unresolved"))
        races = races.withColumns({f: F.coalesce(*(F.col(f"{n}__{f}") for n in packages), F.lit("")), f"{f}_status": status})
    open_ = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{f}_status") == "unresolved", F.lit(f)) for f in RACE_FIELDS))), " | ")
    return races.drop(*(f"{n}__{f}" for n in packages for f in RACE_FIELDS)).withColumn("unresolved_fields", open_)


def unresolved(registry: DataFrame) -> DataFrame:
    """The races with open fields and what to do about them."""
    todo = F.array_join(F.transform(F.split("unresolved_fields", r" \| "), lambda x: F.concat(F.lit("resolve_"), x)), "; ")
    return registry.filter("unresolved_fields <> ''").withColumn("queue_reason", todo)


def represented_cycles(registry: DataFrame) -> DataFrame:
    """States and years of the races in scope, with their races, people and bodies."""
    rows = registry.filter("scope_kind = 'in_scope' and state_code <> '' and election_date <> ''").withColumn("cycle_year", F.substring("election_date", 1, 4))
    people = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(c, r" \| "), lambda x: x != ""))))), " | ")
    return rows.groupBy("state_code", "cycle_year").agg(F.count_distinct("race_id").alias("race_count"), T.joined_distinct(F.col("race_id")).alias("race_ids"), people("endorsed_candidate").alias("endorsed_candidates"), people("endorsing_bodies").alias("endorsing_bodies"))


def candidate_support(people: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """people (race_id, candidate_name, role, election_date) with documents, tokens, and status: supported from least tokens on, thin below, missing without a document."""
    sums = texts.groupBy("race_id", "candidate_name").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    status = F.when(F.col("documents") == 0, "missing").when(F.col("tokens") >= least, "supported").otherwise("thin")
    return people.join(sums, ["race_id", "candidate_name"], "left").fillna(0, ["documents", "tokens"]).withColumn("status", status)


def group_years(support: DataFrame) -> DataFrame:
    """Candidates of each role and year, and how many are supported."""
    by = support.groupBy("role", F.substring("election_date", 1, 4).alias("year"))
    return by.agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "supported").alias("supported"), F.sum("tokens").alias("tokens"))


def paired_races(support: DataFrame, one: str, other: str) -> DataFrame:
    """Races with supported people of both roles."""
    has = lambda role: F.bool_or((F.col("role") == role) & (F.col("status") == "supported"))
    return support.groupBy("race_id").agg(has(one).alias("a"), has(other).alias("b")).filter("a and b").select("race_id")


def sufficiency_gates(support: DataFrame, one: str, other: str, pairs: int, share: float, balance: float) -> DataFrame:
    """gate, value, passed: paired races, the supported share, the lesser role's part of the tokens, years with both roles, nobody without a role."""
    by_year = group_years(support)
    both = by_year.filter("supported > 0").groupBy("year").agg(F.count_distinct("role").alias("n"))
    token = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("tokens"))), F.lit(0)).cast("double")
    one_row = support.agg(
        (F.count_if(F.col("status") == "supported") / F.greatest(F.count("*"), F.lit(1))).alias("s"),
        (F.least(token(one), token(other)) / F.greatest(F.greatest(token(one), token(other)), F.lit(1.0))).alias("b"),
        F.count_if(field(F.col("role")) == "").cast("double").alias("r"),
    )
    gate = lambda df, name, value, passed: df.select(F.lit(name).alias("gate"), F.round(value, 6).alias("value"), passed.alias("passed"))
    n_pairs = paired_races(support, one, other).agg(F.count("*").cast("double").alias("n"))
    n_years = both.agg(F.count_if(F.col("n") < 2).cast("double").alias("n"))
    return (
        gate(n_pairs, "paired_races", F.col("n"), F.col("n") >= pairs)
        .unionByName(gate(one_row, "supported_share", F.col("s"), F.col("s") >= share))
        .unionByName(gate(one_row, "token_balance", F.col("b"), F.col("b") >= balance))
        .unionByName(gate(n_years, "one_sided_years", F.col("n"), F.col("n") == 0))
        .unionByName(gate(one_row, "without_role", F.col("r"), F.col("r") == 0))
    )


def coverage_gaps(support: DataFrame, attempts: DataFrame) -> DataFrame:
    """People who aren't supported, and whether another try is worth it: none so far, or the last error was transient. attempts: race_id, candidate_name, error, at."""
    last = attempts.groupBy("race_id", "candidate_name").agg(F.count("*").alias("tries"), F.max_by(F.struct("error"), "at")["error"].alias("last_error"))
    gaps = support.filter("status <> 'supported'").join(last, ["race_id", "candidate_name"], "left").fillna(0, ["tries"])
    return gaps.withColumn("retryable", (F.col("tries") == 0) | (F.col("last_error").isNotNull() & ledger.transient(F.col("last_error"))))


#: Categories of an inventory at most.
CATEGORIES = 1000


def context_inventory(cycles: DataFrame, categories: DataFrame, seeds: DataFrame) -> DataFrame:
    """An entry for each state, cycle and category: the seeds' where there are some, else a synthetic one to be searched for.

    cycles: state_code, cycle_year. categories: category, a short list. seeds:
    the three, url and title.
    """
    keys = ["state_code", "cycle_year", "category"]
    names = [r.category for r in categories.select("category").distinct().orderBy("category").limit(CATEGORIES + 1).collect()]
    if len(names) > CATEGORIES:
        raise ValueError(f"more than {CATEGORIES} categories")
    wanted = cycles.select(*keys[:2]).distinct().withColumn("category", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    made = wanted.join(seeds, keys, "left")
    title = F.concat_ws(" ", "state_code", "cycle_year", I.pretty(F.col("category")))
    return made.select(
        T.stable_hash(*(F.col(k) for k in keys), F.col("url")).alias("context_id"),
        *keys,
        F.coalesce("title", title).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.when(F.col("url").isNull(), "to_search").otherwise("to_fetch").alias("status"),
    )


def extraction_batch(queue: DataFrame, attempts: DataFrame, fetcher: Callable, limit: int, most: int = 3) -> dict[str, DataFrame]:
    """One resumable batch: the rows that are due, fetched, extracted, segmented, and the attempts with theirs.

    queue: key, url, archive, and whatever else. attempts: key, error, at.
    Returns captures, documents (key, text), segments (key, place, text) and
    attempts, to be kept with ledger.replace_keys. The captures are written
    once, so that no address is fetched again for the other tables.
    """
    from ..sources import extract, fetch, segment

    todo = ledger.due(queue, attempts, "key", most, limit)
    captures = checkpointed(fetch.fetch(todo, "key", ["url", "archive"], fetcher))

    def documents(captures: DataFrame) -> DataFrame:
        good = captures.filter("error is null").withColumn("kind", extract.kind_of(F.col("content_type"), F.col("final_url")))
        text = F.decode("content", "UTF-8")
        pages = extract.parse_pages(good.filter("kind = 'html'").select("key", F.col("final_url").alias("url"), text.alias("html")), "key", "url", "html").select("key", "text")
        captions = F.array_join(F.transform(extract.srt_captions(text), lambda c: c.text), "\n\n")
        return pages.unionByName(good.filter("kind = 'srt'").select("key", captions.alias("text"))).unionByName(good.filter("kind = 'text'").select("key", T.without_controls(text).alias("text")))

    found = documents(captures)
    return {
        "captures": captures,
        "documents": found,
        "segments": segment.packed_segments(found, "key", "text"),
        "attempts": attempts.unionByName(captures.select("key", "error", F.col("retrieved_at").alias("at"))),
    }


def lexical_analysis(df: DataFrame, id_col: str, group: str, tokens: str, pair: tuple[str, str], least: int) -> dict[str, DataFrame]:
    """The tables of a two-group word analysis, from one table of tokens, which is written once, and one of sums by term."""
    df = written(df.select(id_col, group, tokens))
    sums = written(stats.term_sums(df, group, tokens, pair))
    return {
        "tfidf": stats.group_tfidf(df, id_col, group, tokens, pair, sums),
        "log_odds": stats.log_odds(df, group, tokens, pair, least=least),
        "prevalence": stats.prevalence(df, id_col, group, tokens, pair, least=least),
        "hot_cold": stats.hot_cold(df, id_col, group, tokens, *pair, sums=sums),
    }


def report(**metrics: DataFrame) -> DataFrame:
    """section, metric, value of one-row tables of numbers, one section each."""
    made = None
    for section, df in sorted(metrics.items()):
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns)))
        own = df.select(cells.alias("x")).select(F.lit(section).alias("section"), "x.*")
        made = own if made is None else made.unionByName(own)
    return made


def winners(votes: DataFrame, race: list[str], candidate: str, count: str, named: Column) -> DataFrame:
    """Each candidate's best count in the races that hold a named candidate; who has the race's best wins."""
    best = votes.groupBy(*race, candidate).agg(F.max(count).alias(count), F.bool_or(named).alias("named"))
    races = best.groupBy(*race).agg(F.max(count).alias("top"), F.bool_or("named").alias("held")).filter("held")
    return best.join(races, race).select(*race, candidate, count, F.when(F.col(count) == F.col("top"), "Win").otherwise("Loss").alias("outcome"))


def match_names(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of both whose names may be one person's within equal keys: an equi-join on name_key. right's other columns come along; its name is right_name."""
    b = right.withColumn("__key", I.name_key(F.col(name))).withColumnRenamed(name, "right_name")
    return left.withColumn("__key", I.name_key(F.col(name))).join(b, [*keys, "__key"]).drop("__key")


def ordered_name(name: Column) -> Column:
    """A name's words, given names first: those after a comma come before those before it."""
    before, after = I.name_tokens(F.substring_index(name, ",", 1)), I.name_tokens(F.regexp_replace(name, r"^[^,]*,?", ""))
    return F.concat(after, before)


def similar_names(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of both, within equal keys, whose names may be one person's; right's name is right_name.

    Names of one word must be equal. Others have the same last word, and their
    given names agree in order as far as both have them: equal, or one of them
    an initial of the other ("J. Smith" and "Jane Q. Smith", also written
    "Smith, Jane"). They meet by an equi-join on the last word and the first
    initial, which all such pairs share, so each pair is formed once and no
    others but those of this key; NULL and blank names meet nobody. Both tables
    are written with their words before they meet: else the optimizer makes the
    words anew for what it infers of the keys, of rows that the tables drop too.
    """
    words = F.col("__w")
    block = F.when(F.size(words) == 1, words[0]).when(F.size(words) > 1, F.concat_ws(" ", F.element_at(words, -1), F.substring(words[0], 1, 1)))
    keyed = lambda df: written(df.withColumn("__w", ordered_name(F.col(name))).withColumn("__block", block))
    a = keyed(left)
    b = keyed(right).withColumnsRenamed({name: "right_name", "__w": "__r"})
    given = F.arrays_zip(F.slice("__w", F.lit(1), F.size("__w") - 1).alias("a"), F.slice("__r", F.lit(1), F.size("__r") - 1).alias("b"))
    agree = lambda x, y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))
    fits = F.forall(given, lambda p: F.coalesce(agree(p["a"], p["b"]), F.lit(True)))
    return a.join(b, [*keys, "__block"]).filter((F.size("__w") == 1) == (F.size("__r") == 1)).filter(fits).drop("__w", "__r", "__block")


def named_groups(text: Column, pattern: str) -> Column:
    """array<struct> of a pattern's named groups for each of its matches, in order."""
    import re

    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groupindex
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for name, k in groups.items()))


def within_years(df: DataFrame, year: Column, first: int, last: int, strict: bool) -> DataFrame:
    """The rows of these years; with strict any other year is an error."""
    if not strict:
        return df.filter(year.between(first, last))
    wrong = F.raise_error(F.concat(F.lit("year outside the study: "), F.coalesce(year.cast("string"), F.lit("none"))))
    return df.filter(F.when(year.between(first, last), F.lit(True)).otherwise(wrong.cast("boolean")))


def census_errors(rows: DataFrame, key: str, status: str, open_: tuple[str, ...], strict: bool) -> DataFrame:
    """Rows with an open status: warnings, or errors if strict."""
    from . import audit

    return audit.violation(rows, F.col(status).isin(*open_), f"{status} is open", F.col(key), F.col(status), "error" if strict else "warning")
