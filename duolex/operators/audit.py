"""Validation: each check gives rows (severity, rule, row_key, detail); a table is good if no row is an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(df: DataFrame, when: Column, rule: str, key: Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.filter(when).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return violation(counts, F.col("n") > 1, f"duplicate {key}", F.col(key), F.col("n"))


def blank_fields(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    blank = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required)))
    return violation(df.withColumn("__blank", F.explode(blank)), F.lit(True), "blank field", F.col(key), F.col("__blank"))


def outside_domain(df: DataFrame, key: str, column: str, allowed: list) -> DataFrame:
    return violation(df, ~F.col(column).isin(allowed) | F.col(column).isNull(), f"{column} outside its domain", F.col(key), F.col(column))


def missing_parent(df: DataFrame, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias(column))
    return violation(df.join(known, column, "left_anti"), F.lit(True), f"{column} unknown", F.col(key), F.col(column))


def small_groups(df: DataFrame, column: str, least: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return violation(counts, F.col("n") < least, f"{column} with fewer than {least} rows", F.col(column), F.col("n"))


def not_after(df: DataFrame, key: str, earlier: str, later: str) -> DataFrame:
    """Dates out of order are errors, those that can't be read are warnings."""
    a, b = F.col(earlier).try_cast("date"), F.col(later).try_cast("date")
    bad = violation(df, a > b, f"{earlier} after {later}", F.col(key), F.col(earlier))
    return bad.unionByName(violation(df, (a.isNull() & F.col(earlier).isNotNull()), f"{earlier} is no date", F.col(key), F.col(earlier), "warning"))


def several_values(df: DataFrame, group: str, column: str) -> DataFrame:
    spread = df.groupBy(group).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return violation(spread, F.col("lo") != F.col("hi"), f"several {column}", F.col(group), F.concat_ws(" | ", "lo", "hi"))


def conflicting(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields that both tables fill in differently."""
    b = other.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    clash = F.array_compact(F.array(*(F.when((F.col(c) != F.col(f"__{c}")) & (F.trim(F.col(c).cast("string")) != "") & (F.trim(F.col(f"__{c}").cast("string")) != ""), F.lit(c)) for c in columns)))
    return violation(df.join(b, key).withColumn("__clash", F.explode(clash)), F.lit(True), "conflict", F.col(key), F.col("__clash"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def is_ok(found: DataFrame) -> bool:
    return found.filter("severity = 'error'").isEmpty()


def annotation_errors(df: DataFrame, pair: str, annotator: str, label: str, allowed: list[str]) -> DataFrame:
    key = F.concat_ws("/", F.col(pair).cast("string"), F.col(annotator).cast("string"))
    missing = violation(df, F.col(pair).isNull() | F.col(annotator).isNull(), "missing id", key, F.col(label))
    bad = violation(df, ~F.col(label).isin(allowed), "label outside its domain", key, F.col(label))
    twice = df.groupBy(pair, annotator).agg(F.count("*").alias("n"))
    return report(missing, bad, violation(twice, F.col("n") > 1, "duplicate annotation", key, F.col("n")))


def review_errors(expected: DataFrame, reviewed: DataFrame, key: str, decision: str, allowed: list[str]) -> DataFrame:
    """Unknown ids, invalid decisions, duplicates and ids without a review."""
    unknown = violation(reviewed.join(expected.select(key), key, "left_anti"), F.lit(True), "unknown id", F.col(key), F.col(decision))
    uncovered = violation(expected.join(reviewed.select(key), key, "left_anti"), F.lit(True), "no review", F.col(key), F.lit(""))
    return report(unknown, outside_domain(reviewed, key, decision, allowed), duplicate_keys(reviewed, key), uncovered)
