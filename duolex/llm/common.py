"""Parts that several text operators share.

Conventions for every operator of this package: it reads the id and the text
column (names are parameters) and ignores all other columns, so extra columns
with clashing names can't reach its result; rows are never dropped for being
null, empty, long or repeated unless the operator's docstring says so.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into one output batch at most, and their characters; a single longer text is a batch of its own.
SLICE_ROWS, SLICE_CHARS = 512, 2_000_000
#: Rows that go to a Python worker at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], texts: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small slices of the batches with their texts as Python strings (null: empty). texts: the text column's place."""
    for batch in batches:
        lo, column = 0, batch.column(texts)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if batch.num_rows else []
        while lo < batch.num_rows:
            hi, size = lo + 1, sizes[lo]
            while hi < batch.num_rows and hi - lo < SLICE_ROWS and size + sizes[hi] <= SLICE_CHARS:
                size += sizes[hi]
                hi += 1
            part = batch.slice(lo, hi - lo)
            yield part, [x if x is not None else "" for x in part.column(texts).to_pylist()]
            lo = hi


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS at most: whole texts make the default's batches large on both sides of a worker's pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables written in the folder that the cluster shares, to cut lineage so that a lost executor costs only its own tasks.

    The folder is the session's spark.checkpoint.dir. Only a local session
    without that setting gets a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="duolex-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root}/duolex-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids up to so many are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, column: str, how: str, scratch: Scratch, name: str) -> DataFrame:
    """df's rows with (left_semi) or without (left_anti) these ids, which are written and counted first, so that df is shuffled only for many ids. Rows with a null id count as not among them."""
    ids = scratch.save(ids.filter(F.col(column).isNotNull()).distinct(), name)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def text_key(text_col: str) -> Column:
    """The MD5 digest of the text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def join_rows(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str, scratch: Scratch, name: str) -> DataFrame:
    """df's rows with (left_semi) or without (left_anti) the ids and texts of rows (id, text_key), as in join_ids. Other texts of an id aren't touched."""
    rows = scratch.save(rows.toDF("__own_id", "__own_key").filter("__own_id is not null").distinct(), name)
    few = rows.count() <= BROADCAST_IDS
    rows = F.broadcast(rows) if few else rows
    return df.join(rows, (df[id_col] == rows["__own_id"]) & (text_key(text_col) == rows["__own_key"]), how)
