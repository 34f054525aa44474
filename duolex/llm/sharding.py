"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Equal texts are one cell; only a group that is larger than a shard is dealt into
several. Cells are linked if their texts share the least of their sentences'
hashes, as near copies mostly do, or are parts of one group. Every round counts
anew how many linked rows each shard holds now; a cell looks at these and wants
the shard with most of them that has room for it, and shards admit cells, large
ones first, as far as their quota goes. At first cells that have no place yet
are placed so; then placed cells move while that lowers the pairs of linked rows
in different shards (the cut). No pair of documents is ever formed. At the end
the documents without links, and those of cells that fit nowhere, fill the
shards up, so that row counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Classes by size and hash in which the cells of a round are admitted; a bound of the tables that quotas are found on.
CLASSES = 1024
#: Groups and cells are broadcast if they have more than 1 / BROADCAST_ROWS of all rows, of which there can't be more.
BROADCAST_ROWS = 100_000
#: Rows of a bucket, within which slots are numbered by one task, on average.
BUCKET_ROWS = 250_000


#: Characters of a sentence that counts as a link, at least.
SENTENCE_CHARS = 20


def sizes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (UTF-8 bytes plus 16), text_crc32, key (MD5 of the text), near (the least hash of its sentences; null without one): what sharding by equal and near texts needs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    pieces = F.filter(F.split(text, r"[.!?\n]+"), lambda x: F.length(x) >= SENTENCE_CHARS)
    near = F.array_min(F.transform(pieces, lambda x: F.xxhash64(F.trim(x))))
    return df.select(F.col(id_col), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("key"), near.alias("near"))


def _by_size(df: DataFrame, other: DataFrame, column: str, size: str, bound: int) -> DataFrame:
    """df joined (left) with other by column; other's rows with a size over bound are broadcast, and rows without a key aren't shuffled, so that no key with many rows is. df is read twice or more."""
    values = [c for c in other.columns if c != column]
    alone = df.filter(F.col(column).isNull()).select("*", *(F.lit(None).cast(other.schema[c].dataType).alias(c) for c in values))
    many = other.filter(F.col(size) > bound)
    df = df.filter(F.col(column).isNotNull())
    if not bound:
        return df.join(F.broadcast(many), column, "left").unionByName(alone)
    straight = df.join(F.broadcast(many), column)
    rest = df.join(F.broadcast(many.select(column)), column, "left_anti").join(other.filter(F.col(size) <= bound), column, "left")
    return straight.unionByName(rest).unionByName(alone)


def _cells(docs: DataFrame, id_col: str, quota: int, bound: int, scratch: Scratch) -> DataFrame:
    """docs with cell and link; null for documents without links. A group over the quota is dealt into cells that are smaller than it by four standard deviations of what chance puts into them."""
    near = F.min("near") if "near" in docs.columns else F.lit(None).cast("long")
    groups = scratch.save(docs.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), near.alias("near")), "groups")
    shared = scratch.save(groups.filter("near is not null").groupBy("near").agg(F.count("*").alias("texts"), F.sum("n").alias("all")).filter("texts > 1"), "shared")
    groups = _by_size(groups, shared, "near", "texts", bound)
    mean = max(1.0, ((quota + 4) ** 0.5 - 2) ** 2)
    dealt = F.when(F.col("n") > quota, F.ceil(F.col("n") / mean)).otherwise(1).cast("long")
    link = F.when(F.col("texts").isNotNull(), F.xxhash64("near", F.lit(1))).when(F.col("n") > quota, F.xxhash64("key", F.lit(2)))
    groups = groups.filter("n > 1 or texts > 1").select("key", "n", dealt.alias("dealt"), link.alias("link"))
    joined = _by_size(docs.drop("near"), scratch.save(groups, "linked"), "key", "n", bound)
    row = F.xxhash64(F.col(id_col), F.col("size"))
    return joined.withColumn("cell", F.when(F.col("n").isNotNull(), F.xxhash64("key", F.pmod(row, F.col("dealt"))))).drop("n", "dealt")


def _pulled(cells: DataFrame, bound: int) -> DataFrame:
    """cells with `pulls`: how many rows of its link each shard holds now, without the cell's own."""
    held = cells.filter("link is not null").groupBy("link", "shard").agg(F.sum("rows").alias("n"), F.count("*").alias("c"))
    links = held.groupBy("link").agg(F.sum("c").alias("members"), F.collect_list(F.struct("n", "shard")).alias("pulls"))  # at most one entry for each shard
    out = _by_size(cells, links, "link", "members", bound)
    own = F.transform("pulls", lambda p: F.struct((p.n - F.when(p.shard == F.col("shard"), F.col("rows")).otherwise(0)).alias("n"), p.shard.alias("shard")))
    return out.withColumn("pulls", F.filter(own, lambda p: p.n > 0)).drop("members")


def cut_pairs(cells: DataFrame) -> int:
    """Pairs of linked rows in different shards, counted from each link's rows in each shard."""
    held = cells.filter("link is not null").groupBy("link", "shard").agg(F.sum("rows").cast("double").alias("n"))
    one = held.groupBy("link").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return int(one.agg(F.sum((F.col("t") * F.col("t") - F.col("s")) / 2)).first()[0] or 0)


def _round(cells: DataFrame, quotas: list[int], turn: int, moving: bool, bound: int, scratch: Scratch) -> DataFrame | None:
    """cells after a round of admissions: of those without a place, or with moving of those with one; None if none was admitted. cells: cell, rows, link, shard, settled."""
    held = {r.shard: r.n for r in cells.filter("settled").groupBy("shard").agg(F.sum("rows").alias("n")).collect()}  # a row for each shard
    rooms = F.array(*(F.lit(int(q - held.get(s, 0))).cast("long") for s, q in enumerate(quotas)))
    fits = lambda shard: rooms[shard] >= F.col("rows")
    pulled = _pulled(cells, bound)
    tie = lambda shard: F.xxhash64("link", shard)
    wanted = F.array_max(F.transform(F.filter("pulls", lambda p: fits(p.shard)), lambda p: F.struct(p.n.alias("n"), tie(p.shard).alias("tie"), p.shard.alias("shard"))))
    if moving:
        here = F.coalesce(F.array_max(F.transform(F.filter("pulls", lambda p: p.shard == F.col("shard")), lambda p: p.n)), F.lit(0))
        asked = pulled.filter("settled").withColumn("want", wanted)
        asked = asked.filter((F.col("want.n") > here) & (F.col("want.shard") != F.col("shard")) & (F.pmod(F.xxhash64("cell", F.lit(turn)), F.lit(2)) == 0))
        asked = asked.select("cell", "rows", F.col("want.shard").alias("target"))
    else:
        free = F.filter(F.sequence(F.lit(0), F.lit(len(quotas) - 1)), lambda s: fits(s))
        other = F.element_at("free", (F.pmod(F.xxhash64(F.coalesce("link", "cell"), F.lit(turn)), F.size("free")) + 1).cast("int"))
        asked = pulled.filter("not settled").withColumns({"want": wanted, "free": free}).filter(F.size("free") > 0)
        target = F.coalesce(F.col("want.shard"), F.when(fits(F.col("shard")), F.col("shard")), other)
        asked = asked.select("cell", "rows", target.cast("int").alias("target"))
    order = (63 - F.floor(F.log2("rows"))) * CLASSES + F.pmod(F.xxhash64("cell", F.lit(-1 - turn)), F.lit(CLASSES))  # large ones first
    movers = scratch.save(asked.withColumn("class", order), f"movers{turn}")
    by_class = movers.groupBy("target", "class").agg(F.sum("rows").alias("rows"))  # at most shards x 64 x CLASSES rows
    upto = by_class.withColumn("upto", F.sum("rows").over(Window.partitionBy("target").orderBy("class"))).filter(F.col("upto") <= rooms[F.col("target")])
    last = {r.target: r["class"] for r in upto.groupBy("target").agg(F.max("class").alias("class")).collect()}  # a row for each shard
    if not last:
        return None
    ends = F.array(*(F.lit(int(last.get(s, -1))).cast("long") for s in range(len(quotas))))
    admitted = movers.filter(F.col("class") <= ends[F.col("target")]).select("cell", "target")
    placed = cells.join(admitted, "cell", "left")
    return scratch.save(placed.select("cell", "rows", "link", F.coalesce("target", "shard").alias("shard"), (F.col("settled") | F.col("target").isNotNull()).alias("settled")), f"cells{turn}")


def _placed(state: DataFrame, quotas: list[int], bound: int, scratch: Scratch) -> DataFrame:
    """The cells with their last shards."""
    held = state.filter("cell is not null").groupBy("cell", "link", "shard").agg(F.count("*").alias("n"))
    cells = held.groupBy("cell", "link").agg(F.sum("n").alias("rows"), F.max_by("shard", F.struct("n", F.xxhash64("cell", "shard"))).alias("shard"))
    cells, turn = scratch.save(cells.select("cell", "rows", "link", "shard", F.lit(False).alias("settled")), "cells"), 0
    while (after := _round(cells, quotas, turn, False, bound, scratch)) is not None:
        cells, turn = after, turn + 1
    cut = cut_pairs(cells)
    while cut and (after := _round(cells, quotas, turn, True, bound, scratch)) is not None:
        turn += 1
        now = cut_pairs(after)
        if now >= cut:
            break
        cells, cut = after, now
    return cells


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, size, key and any others but near) with shard int and slot long.

    Rows with equal key are linked, and so are those with equal near (a column
    that may be missing); nulls link nothing. Row counts of the shards differ by
    one at most, slots are gapless from 0 within a shard. Placing ends when no
    cell without a place fits anywhere, moving when a round doesn't lower the
    cut; there is no other limit of rounds. Repeated rows and null ids are rows
    like any other. An empty input gives an empty result. Per-shard numbers, one
    row for each shard, are all that comes to the driver.
    """
    scratch = Scratch(docs.sparkSession)
    docs = scratch.save(docs, "docs")
    total = docs.count()
    bound = total // BROADCAST_ROWS
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    first = F.pmod(F.xxhash64(F.col(id_col), F.col("size")), F.lit(shards)).cast("int")
    state = scratch.save(_cells(docs, id_col, max(1, total // shards), bound, scratch).withColumn("shard", first), "state")
    cells = _placed(state, quotas, bound, scratch).filter("settled").select("cell", F.col("rows").alias("n"), F.col("shard").alias("target"))
    placed = _by_size(state, cells, "cell", "n", bound).drop("n")
    placed = placed.withColumn("settled", F.col("target").isNotNull()).withColumn("shard", F.coalesce("target", "shard")).drop("target", "key", "cell", "link")
    return _filled(scratch.save(placed, "placed"), quotas, total, id_col)


def _filled(placed: DataFrame, quotas: list[int], total: int, id_col: str) -> DataFrame:
    """Exact quotas: what a shard has too much goes, documents that aren't settled first, to the shards that have too little."""
    shards = len(quotas)
    held = dict.fromkeys(range(shards), 0) | {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    surplus = [max(0, held[s] - quotas[s]) for s in range(shards)]
    deficit = [max(0, quotas[s] - held[s]) for s in range(shards)]
    before = [sum(surplus[:s]) for s in range(shards)]
    # rank of a row within its shard: rows before its bucket, and its place within the bucket
    buckets = max(8, total // shards // BUCKET_ROWS)
    row = F.xxhash64(F.col(id_col), "size", "text_crc32") if "text_crc32" in placed.columns else F.xxhash64(F.col(id_col), "size")
    bucket = F.pmod(row, F.lit(buckets)) + F.when(F.col("settled"), buckets).otherwise(0)
    placed = placed.withColumn("bucket", bucket.cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(id_col, "size")) - 1
    ranked = placed.withColumn("inside", inside).join(offsets, ["shard", "bucket"]).withColumn("rank", F.col("inside") + F.col("offset"))

    def of_shard(values: list[int], column: str = "shard"):
        return F.array(*(F.lit(int(x)).cast("long") for x in values))[F.col(column)]

    ends = [sum(deficit[: s + 1]) for s in range(shards)]
    pool = F.when(F.col("rank") < of_shard(surplus), of_shard(before) + F.col("rank"))
    ranked = ranked.withColumn("pool", pool)
    target = F.size(F.filter(F.array(*(F.lit(int(x)).cast("long") for x in ends)), lambda e: e <= F.col("pool")))
    ranked = ranked.withColumn("target", F.when(F.col("pool").isNotNull(), target))
    starts = [e - d for e, d in zip(ends, deficit)]
    kept = [held[s] - surplus[s] for s in range(shards)]
    slot = F.when(F.col("pool").isNull(), F.col("rank") - of_shard(surplus)).otherwise(of_shard(kept, "target") + F.col("pool") - of_shard(starts, "target"))
    own = [c for c in placed.columns if c not in ("shard", "settled", "bucket")]
    return ranked.select(*own, F.coalesce("target", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
