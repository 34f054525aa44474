"""State that resumable batches keep: keyed replacement, attempts, retries, preserved status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of errors that may pass.
TRANSIENT = (
    "connection refused", "connection reset", "remote end closed", "temporarily unavailable", "timed out", "timeout",
    "http error 429", "http error 500", "http error 502", "http error 503", "http error 504",
)


def transient(error: Column) -> Column:
    return F.lower(F.coalesce(error, F.lit(""))).rlike("|".join(TRANSIENT))


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of keys that weren't processed again, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_prefixed(old: DataFrame, new: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key has the prefix go, generated rows come."""
    return old.filter(~F.col(key).startswith(prefix) | F.col(key).isNull()).unionByName(new)


def keep_status(rebuilt: DataFrame, prior: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rebuilt rows take the status columns that rows of the same key had before."""
    old = prior.groupBy(key).agg(*(F.max(c).alias(f"__{c}") for c in columns))
    made = rebuilt.join(old, key, "left")
    return made.withColumns({c: F.coalesce(F.nullif(f"__{c}", F.lit("")), c) for c in columns}).drop(*(f"__{c}" for c in columns))


def due(queue: DataFrame, attempts: DataFrame, key: str, most: int, limit: int) -> DataFrame:
    """The next rows to try: not done, fewer than most attempts, only transient errors again; least tried first."""
    seen = attempts.groupBy(key).agg(F.count("*").alias("tries"), F.bool_or(F.col("error").isNull()).alias("done"), F.max_by("error", "at").alias("last_error"))
    open_ = queue.join(seen, key, "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    wanted = (F.col("tries") == 0) | (~F.col("done") & (F.col("tries") < most) & transient(F.col("last_error")))
    return open_.filter(wanted).orderBy("tries", key).limit(limit)


def stages(status: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Each key's next stage: the first never tried, else the first that may be retried once, else none."""
    by_stage = {n: F.max(F.when(F.col("stage") == n, F.struct("tries", "ok", "error"))) for n in names}
    wide = status.groupBy(key).agg(*(e.alias(f"s_{n}") for n, e in by_stage.items()))
    fresh = [F.when(F.col(f"s_{n}").isNull(), n) for n in names]
    again = [F.when(~F.col(f"s_{n}.ok") & (F.col(f"s_{n}.tries") < 2) & transient(F.col(f"s_{n}.error")), n) for n in names]
    return wide.select(key, F.coalesce(*fresh, *again).alias("next_stage"))
