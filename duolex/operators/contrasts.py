"""What people of a race disagree on: conflicts that someone names, and coded stances that diverge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions.predicates import field
from .relational import written

#: Roles of people who are backed.
BACKED = ("endorsed", "unopposed")
SHOWN = ("race_id", "topic", "subtopic", "candidate_a", "candidate_b", "contrast_type", "relationship_code", "quote_a", "quote_b", "source_a", "source_b")
#: What is carried of a row that a contrast may show.
ROW = ("ord", "subtopic", "quote", "source")


def _first(df: Column) -> Column:
    """The first row (by ord) where the condition holds, as a struct; NULL if none."""
    return F.min(F.when(df, F.struct(*ROW)))


def _stances(told: DataFrame) -> DataFrame:
    """For each person and topic: the first row for, the first against, and the first rows of the two subtopics that come first. That is all that a comparison with anybody else can need."""
    keys = ("race_id", "topic", "who")
    by_subtopic = told.filter("subtopic <> ''").groupBy(*keys, "subtopic").agg(_first(F.lit(True)).alias("row"))
    first = by_subtopic.groupBy(*keys).agg(F.min("row").alias("s1"))
    second = by_subtopic.join(first, [*keys]).filter(F.col("subtopic") != F.col("s1.subtopic")).groupBy(*keys).agg(F.min("row").alias("s2"))
    both = told.groupBy(*keys).agg(_first(F.col("stance") == "support").alias("yes"), _first(F.col("stance") == "oppose").alias("no"))
    return both.join(first, [*keys], "left").join(second, [*keys], "left")


def sticking_points(evidence: DataFrame) -> DataFrame:
    """SHOWN and sticking_point_id: a row for each named conflict and for each two people of a race who diverge on a topic, if one of them is backed.

    evidence: race_id, candidate_name, role, topic, subtopic, stance, quote,
    source, opponent, status, ord (the rows' order, without ties). Only verified
    rows with a quote count. A person's role is that of the last row, the name
    shown is the first one's. Two people disagree explicitly if a row of one
    supports what a row of the other opposes; else they differ in mechanism if
    two rows have different subtopics. The rows shown are the first of the
    first person, and of the second person's the first that stands against it.
    A person's rows are reduced to four before people are compared, so a race
    costs its people squared, whatever it holds of their rows. Rows are written
    once with both identities, as they are read some times; else each reading
    makes the identities anew, and again for what the optimizer infers of the keys.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = evidence.filter((F.col("status") == "verified") & (field(F.col("quote")) != ""))
    rows = rows.select("race_id", "candidate_name", *(text(c).alias(c) for c in ("role", "topic", "subtopic", "stance", "quote", "source", "opponent")), "ord", I.text_identity(F.col("candidate_name")).alias("who"))
    rows = written(rows.withColumn("other", F.when(field(F.col("opponent")) != "", I.text_identity(F.col("opponent")))))
    known = rows.groupBy("race_id", "who").agg(F.max_by("role", "ord").alias("role"), F.min_by("candidate_name", "ord").alias("shown"))
    me = known.select("race_id", "who", F.col("shown").alias("own_shown"))
    other = known.select("race_id", F.col("who").alias("other"), F.col("role").alias("other_role"), F.col("shown").alias("other_shown"))
    named = rows.filter("other is not null").join(me, ["race_id", "who"]).join(other, ["race_id", "other"], "left")
    named = named.filter(F.col("role").isin(*BACKED) | F.coalesce(F.col("other_role").isin(*BACKED), F.lit(False)))
    none = F.lit("")
    explicit = named.select(
        "race_id", "topic", "subtopic", F.col("own_shown").alias("candidate_a"), F.coalesce("other_shown", "opponent").alias("candidate_b"), F.lit("explicit_conflict").alias("contrast_type"),
        F.lit("explicit_disagreement").alias("relationship_code"), F.col("quote").alias("quote_a"), none.alias("quote_b"), F.col("source").alias("source_a"), none.alias("source_b"),
    )
    told = _stances(rows.filter(field(F.col("topic")) != "")).join(known, ["race_id", "who"])
    own = [c for c in told.columns if c not in ("race_id", "topic")]
    a, b = told.select("race_id", "topic", *(F.col(c).alias(f"a_{c}") for c in own)), told.select("race_id", "topic", *(F.col(c).alias(f"b_{c}") for c in own))
    pairs = a.join(b, ["race_id", "topic"]).filter((F.col("a_who") < F.col("b_who")) & (F.col("a_role").isin(*BACKED) | F.col("b_role").isin(*BACKED)))
    made = lambda code, left, right: F.struct(F.lit(code).alias("code"), left.alias("left"), right.alias("right"))
    col = F.col
    with_no, with_yes = col("a_yes").isNotNull() & col("b_no").isNotNull(), col("a_no").isNotNull() & col("b_yes").isNotNull()
    first_yes = with_no & (~with_yes | (col("a_yes.ord") < col("a_no.ord")))
    unlike = lambda x, y: col(f"{x}.subtopic") != col(f"{y}.subtopic")
    relation = (
        F.when(first_yes, made("explicit_disagreement", col("a_yes"), col("b_no")))
        .when(with_yes, made("explicit_disagreement", col("a_no"), col("b_yes")))
        .when(unlike("a_s1", "b_s1"), made("different_mechanism", col("a_s1"), col("b_s1")))
        .when(col("a_s1").isNotNull() & col("b_s2").isNotNull(), made("different_mechanism", col("a_s1"), col("b_s2")))
        .when(col("a_s2").isNotNull() & col("b_s1").isNotNull(), made("different_mechanism", col("a_s2"), col("b_s1")))
    )
    coded = pairs.withColumn("r", relation).filter("r is not null").select(
        "race_id", "topic", col("r.left.subtopic").alias("subtopic"), col("a_shown").alias("candidate_a"), col("b_shown").alias("candidate_b"), F.lit("coded_divergence").alias("contrast_type"),
        col("r.code").alias("relationship_code"), col("r.left.quote").alias("quote_a"), col("r.right.quote").alias("quote_b"), col("r.left.source").alias("source_a"), col("r.right.source").alias("source_b"),
    )
    parts = ("race_id", "topic", "candidate_a", "candidate_b", "contrast_type", "quote_a", "quote_b")
    return explicit.unionByName(coded).select(T.stable_hash(*(F.col(c) for c in parts)).alias("sticking_point_id"), *SHOWN)


def _by_kind(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(*(F.count_if(F.col("contrast_type") == k).alias(k) for k in ("explicit_conflict", "coded_divergence")), F.count("*").alias("total"))


def sticking_point_topics(points: DataFrame) -> DataFrame:
    """topic, explicit_conflict, coded_divergence, total."""
    return _by_kind(points, "topic")


def sticking_point_cycles(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """cycle, explicit_conflict, coded_divergence, total: by the year of the race's last told election date; unknown without one. evidence: race_id, election_date, ord."""
    dated = evidence.filter((field(F.col("race_id")) != "") & (field(F.col("election_date")) != ""))
    years = dated.groupBy("race_id").agg(F.substring(F.max_by("election_date", "ord"), 1, 4).alias("cycle"))
    return _by_kind(points.join(years, "race_id", "left").withColumn("cycle", F.coalesce("cycle", F.lit("unknown"))), "cycle")
