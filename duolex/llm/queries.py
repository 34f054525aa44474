"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remainder, table


def vocabulary(name: str) -> str:
    """A public vocabulary's file; the package with the files is installed on every machine that runs a driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def span_digest(spans, kinds: tuple[str, ...]) -> F.Column:
    return F.sha2(span_text(F.filter(spans, lambda s: s.kind.isin(*kinds))), 256)


def span_count(spans, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def op1_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import to_media

    made = to_media(table(spark, sf_dir, "documents"))
    size = F.octet_length("samples")
    return made.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("frames").cast("string"), F.size("codes").cast("string"), F.hex(F.xxhash64("codes"))).alias("feature"),
    )


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard, sizes_of

    placed = shard(sizes_of(table(spark, sf_dir, "documents")), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(span_count(F.col("spans"), k).alias(f"n_{k}") for k in BASE),
        span_digest(F.col("spans"), BASE).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        span_count(F.col("spans"), "iban").alias("n_iban"),
        F.coalesce(F.round(F.aggregate("spans", F.lit(0.0), lambda a, x: F.greatest(a, x.score)), 3), F.lit(0.0)).alias("top_score"),
    )


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import KEEP, score_quality

    held_out = remainder(F.col("doc_id"), 5) == 0
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_language

    held_out = remainder(F.col("doc_id"), 4) == 2
    return predict_language(table(spark, sf_dir, "documents"), ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearjoin import near_classes

    return near_classes(table(spark, sf_dir, "documents"))[0]


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    held_out = remainder(F.col("doc_id"), 4) == 2
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), word_pattern())
    return found.select(
        "doc_id",
        *(span_count(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        span_digest(F.col("spans"), ("assign", "access", "hex")).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        span_count(F.col("spans"), "random").alias("n_random"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return token_digests(encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), word_pattern()))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import as_records, canonical_turns, format_turns, read_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    turns = canonical_turns(as_records(rows.unionByName(more)), ["conv_id", "turn"])
    return read_conversations(format_turns(turns), Scratch(spark))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")), Scratch(spark))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import encoded_turns, prefix_trie, rebuilt

    scratch = Scratch(spark)
    return prefix_trie(*rebuilt(encoded_turns(table(spark, sf_dir, "conversations"), scratch), scratch), scratch)


def token_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
