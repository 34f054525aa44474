"""Streaming forms of the resumable batches: keyed upsert by foreachBatch, and a retry ledger with its own state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.ledger import TRANSIENT, replace_keys


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Keeps the last row of each key in a table of versions: each batch writes a new folder and then the pointer to it, so a repeated batch changes nothing."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        before = [v for v in versions(spark, target) if v < number]
        whole = replace_keys(spark.read.parquet(f"{target}/v={before[-1]}"), last, key) if before else last
        whole.write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_duplicates(stream: DataFrame, target: str, checkpoint: str, key: str, text: str, order: str) -> StreamingQuery:
    """Keeps each document's exact and near hash and how many documents have it, as batches of new or changed documents arrive.

    A batch's last row of a key counts. Versions under target: docs (key, exact,
    near), counts (hash, n) and changes (key, n_exact, n_near: the documents,
    earlier ones too, whose numbers this batch has changed). A batch adds one
    for each new hash and takes one off for each that its documents had before,
    so only hashes are aggregated again, never texts; a repeated batch writes
    the same version again. A text without a near hash is only its own copy.
    """
    spark = stream.sparkSession

    def ones(docs: DataFrame, n: int) -> DataFrame:
        both = docs.select(F.explode(F.array(F.concat(F.lit("e:"), "exact"), F.when(F.col("near") != "", F.concat(F.lit("n:"), "near")))).alias("hash"))
        return both.filter("hash is not null").groupBy("hash").agg((F.count("*") * n).alias("n"))

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(text, order).alias("t")).select(key, T.exact_hash(F.coalesce("t", F.lit(""))).alias("exact"), T.near_hash(F.coalesce("t", F.lit(""))).alias("near"))
        last.write.mode("overwrite").parquet(f"{target}/new/v={number}")
        last = spark.read.parquet(f"{target}/new/v={number}")
        before = [v for v in versions(spark, f"{target}/changes") if v < number]
        delta, docs, counts = ones(last, 1), last, ones(last, 1)
        if before:
            old, known = (spark.read.parquet(f"{target}/{part}/v={before[-1]}") for part in ("docs", "counts"))
            replaced = old.join(last.select(key), key, "left_semi")
            delta = delta.unionByName(ones(replaced, -1)).groupBy("hash").agg(F.sum("n").alias("n")).filter("n <> 0")
            docs = replace_keys(old, last, key)
            counts = known.unionByName(delta).groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 0")
        docs.write.mode("overwrite").parquet(f"{target}/docs/v={number}")
        counts.write.mode("overwrite").parquet(f"{target}/counts/v={number}")
        docs, counts = (spark.read.parquet(f"{target}/{part}/v={number}") for part in ("docs", "counts"))
        touched = delta.select(F.substring("hash", 1, 2).alias("kind"), F.expr("substring(hash, 3)").alias("h"))
        keys = docs.join(touched.filter("kind = 'e:'"), docs.exact == F.col("h"), "left_semi").select(key).unionByName(docs.join(touched.filter("kind = 'n:'"), docs.near == F.col("h"), "left_semi").select(key)).unionByName(last.select(key)).distinct()
        _numbers(docs.join(keys, key, "left_semi"), counts, key).select(key, "n_exact", "n_near").write.mode("overwrite").parquet(f"{target}/changes/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(docs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    of = lambda kind, n: counts.filter(F.col("hash").startswith(f"{kind}:")).select(F.expr("substring(hash, 3)").alias("exact" if kind == "e" else "near"), F.col("n").alias(n))
    made = docs.join(of("e", "n_exact"), "exact").join(of("n", "n_near"), "near", "left")
    return made.select(key, "exact", "near", "n_exact", F.coalesce("n_near", F.lit(1)).alias("n_near"))


def duplicate_numbers(spark, target: str) -> DataFrame:
    """key, exact, near, n_exact, n_near of all documents so far."""
    last = versions(spark, f"{target}/changes")[-1]
    docs, counts = (spark.read.parquet(f"{target}/{part}/v={last}") for part in ("docs", "counts"))
    return _numbers(docs, counts, next(c for c in docs.columns if c not in ("exact", "near")))


def versions(spark, target: str) -> list[int]:
    """Complete versions of an upserted table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def latest(spark, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v={versions(spark, target)[-1]}")


def retry_ledger(stream: DataFrame, key: str, most: int = 2) -> DataFrame:
    """key, tries, status of every attempt (columns key, error) so far: done, retry (a transient error, under most tries) or failed."""
    kind = stream.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, done = state.get if state.exists else (0, False)
        error = None
        for batch in batches:
            tries += len(batch)
            done = done or bool(batch["error"].isna().any())
            error = batch["error"].iloc[-1]
        state.update((tries, done))
        again = not done and tries < most and pd.Series([error]).str.lower().str.contains("|".join(TRANSIENT)).fillna(False).iloc[0]
        yield pd.DataFrame({key: [keys[0]], "tries": [tries], "status": ["done" if done else "retry" if again else "failed"]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, tries long, status string", "tries long, done boolean", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out, and state behind it goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
