"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words are runs of anything but these characters.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets a temporary one, a cluster raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver share no folder")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='courtlight-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_of(column: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array, none of them empty."""
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE + "+")).otherwise(F.array().cast("array<string>"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], amount: str, out: str, buckets: int = 256) -> DataFrame:
    """Running total of amount before each row, by group and order, without bringing a group to one task.

    The first order column must be a hash spread evenly over the long range: rows are cut into ranges of it, each
    range is summed by a window of its own, and a table of group x range totals (at most `buckets` rows a group)
    gives where a range begins. `buckets` grows with the rows; it bounds nothing else.
    """
    # by the signed value, as windows and comparisons order it: the smallest long is in range 0
    cut = F.floor((order[0].cast("double") + F.lit(2.0**63)) / F.lit(2.0**64 / buckets)).cast("int")
    cut = F.least(cut, F.lit(buckets - 1))
    ranged = df.withColumn("__cut", cut)
    totals = ranged.groupBy(*group, "__cut").agg(F.sum(amount).alias("__sum"))
    before = W.partitionBy(*group).orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__cut").alias("__c"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*group, "__cut").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col("__cut") == F.col("__c")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    kept = [c for c in df.columns if c != out]
    return summed.join(starts, same).select(*kept, (F.col("__start") + F.col("__in")).alias(out))
