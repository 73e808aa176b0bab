"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Tasks that share the rows of one key in a join with one row a key.
SALTS = 16


def salted_join(many: DataFrame, key: str, one: DataFrame, one_key: str) -> DataFrame:
    """many joined with the one row of its key; a key's rows are dealt over SALTS tasks by a hash of the whole row."""
    salt = F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")
    spread = one.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = many.withColumn("__salt", salt).join(spread, (F.col(key) == F.col(one_key)) & (F.col("__salt") == F.col("__salt2")))
    return joined.drop("__salt", "__salt2")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and label (the smallest node reachable) for every node that has a link; longs without nulls.

    Alternates two star steps until nothing changes: every node first ties its larger neighbours to its smallest one,
    then itself and its smaller neighbours. A node's neighbours are only ever minimised (combined before the shuffle)
    and joined with salt, never gathered, so a star of any size is work for many tasks. Each round is a written table,
    so the plan stays short.
    """
    x, y = F.greatest(a, b), F.least(a, b)
    edges = materialise(links.select(x.alias("x"), y.alias("y")).filter("x <> y").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy(F.col("x").alias("n")).agg(F.min("y").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = materialise(salted_join(both.filter("y > x"), "x", least, "n").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "links")
        small = large.groupBy(F.col("x").alias("n")).agg(F.min("y").alias("m"))
        tied = salted_join(large, "x", small, "n")
        moved = tied.filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = materialise(moved.unionByName(small.select(F.col("n").alias("x"), F.col("m").alias("y"))).distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
        if seen == now:
            break
        seen = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
