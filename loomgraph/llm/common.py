"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on one machine, if none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back.

    Cuts lineage in a way that survives lost executors, and computes `df` once.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"stash-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` for mapInArrow, which gives freed memory back to the system at its end.

    Python workers live on between stages, and what they keep counts against their executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_mod(col: Column, mod: int) -> Column:
    """crc32 of the decimal text of `col`, modulo `mod`; null stays null."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def maybe_in(docs: DataFrame, key: Column, ids: DataFrame, flag: str = "__maybe", bits: int = 1 << 25) -> DataFrame:
    """`docs` with a column `flag`: false for rows whose `key` is surely not in `ids` (one column).

    A bitmap of hashes of bounded size (`bits`), broadcast.  It spares rows a shuffle; those
    it lets pass need an exact join.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long"), F.lit(23)), F.lit(bits))
    p = place(ids[ids.columns[0]])
    marks = ids.select(p.alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    at = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined = docs.withColumn("__p", place(key)).withColumn("__bucket", F.bitmap_bucket_number("__p")).join(F.broadcast(marks), "__bucket", "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__p", "__bucket", "__bits")


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`docs` less the rows whose `key` is in `ids` (one column); most texts stay where they are."""
    gone = ids.select(ids[ids.columns[0]].alias("__id")).distinct()
    flagged = maybe_in(docs, F.col(key), gone)
    sure = flagged.where(~F.col("__maybe")).select(*docs.columns)
    rest = flagged.where("__maybe").join(gone, F.col(key) == F.col("__id"), "left_anti").select(*docs.columns)
    return sure.unionByName(rest)
