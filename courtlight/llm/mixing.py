"""Mixing sources to target weights: budgets flow down a tree, shortages go to siblings first, then further up.

Every leaf of a path of columns (domain, language, source) gets a token budget and is filled from seeded epochs: whole
passes over its documents, then the shortest prefix of the next pass, in that epoch's order, that reaches the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, prefix_sums


def leaf_supply(docs: DataFrame, path: list[str], tokens: str) -> DataFrame:
    """Documents and tokens of each leaf; one row a leaf, summed before the shuffle."""
    return docs.groupBy(*path).agg(F.sum(tokens).alias("supply"), F.count("*").alias("n_docs"))


def _all_equal(left: list[str], right: list[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same &= F.col(a).eqNullSafe(F.col(b))
    return same


def _pour(budget: Column, weight: Column, capacity: Column, parent: list[str], df: DataFrame, out: str) -> DataFrame:
    """Split a parent's budget among children by weight, none above its capacity; what one can't take goes to the rest.

    Children fill up in ascending order of capacity / weight. If those before a child in that order are full, the
    child may take weight / (weights from it on) of what they left; it is full if that reaches its capacity.
    """
    by = W.partitionBy(*parent)
    order = by.orderBy(F.col("__ratio"), *[F.col(c) for c in df.columns if c.startswith("__key")])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    own = df.withColumns({"__w": weight, "__c": capacity, "__b": budget})
    own = own.withColumn("__ratio", F.when(F.col("__w") > 0, F.col("__c") / F.col("__w")).otherwise(F.lit(float("inf"))))
    own = own.withColumn("__left", F.greatest(F.lit(0.0), F.col("__b") - F.coalesce(F.sum(F.when(F.col("__w") > 0, F.col("__c")).otherwise(0.0)).over(before), F.lit(0.0))))
    own = own.withColumn("__rest", F.sum("__w").over(by) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    own = own.withColumn("__share", F.when((F.col("__w") > 0) & (F.col("__rest") > 0), F.col("__left") / F.col("__rest")).otherwise(F.lit(0.0)))
    # the level at which those that don't fill up stand is the share of the first of them, in this order
    own = own.withColumn("__open", F.when((F.col("__w") > 0) & (F.col("__share") * F.col("__w") < F.col("__c")), F.col("__share")))
    own = own.withColumn("__level", F.first("__open", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    filled = F.when(F.col("__w") <= 0, F.lit(0.0)).when(F.col("__level").isNull(), F.col("__c")).otherwise(F.least(F.col("__c"), F.col("__level") * F.col("__w")))
    return own.withColumn(out, filled).drop("__w", "__c", "__b", "__ratio", "__left", "__rest", "__share", "__open", "__level")


def budgets(supply: DataFrame, path: list[str], weights: dict[str, dict[str, float]], total: float, epochs: float = 1.0) -> DataFrame:
    """A budget for each leaf of supply (path columns, supply).

    weights[column][value] is a child's weight among its siblings, 1 where none is given. A leaf takes at most
    supply * epochs; a node takes at most what its leaves take, so a shortage below a node stays among its children as
    long as they have room, and only the rest passes to the node's own siblings. Sum of budgets: min(total, capacity).
    """
    rows = [(c, v, float(w)) for c, of in weights.items() for v, w in of.items()]
    given = supply.sparkSession.createDataFrame(rows, "__column string, __value string, __weight double")
    tree = supply.withColumn("__cap", F.coalesce(F.col("supply"), F.lit(0)).cast("double") * F.lit(float(epochs)))
    for depth, column in enumerate(path):
        mine = given.filter(F.col("__column") == column).select(F.col("__value").alias(f"__v{depth}"), F.col("__weight").alias(f"__weight{depth}"))
        # the caller's own list of weights, held on the driver already
        tree = tree.join(F.broadcast(mine), F.col(column).cast("string") == F.col(f"__v{depth}"), "left").drop(f"__v{depth}").withColumn(f"__weight{depth}", F.coalesce(f"__weight{depth}", F.lit(1.0)))
    shut = F.lit(False)
    for depth in range(len(path)):
        shut |= F.col(f"__weight{depth}") <= 0
    tree = tree.withColumn("__cap", F.when(shut, F.lit(0.0)).otherwise(F.col("__cap")))
    level = tree.select(*path, "__cap", *[f"__weight{d}" for d in range(len(path))])
    budget = None
    for depth in range(1, len(path) + 1):
        nodes = level.groupBy(*path[:depth]).agg(F.sum("__cap").alias("__cap"), F.first(f"__weight{depth - 1}").alias("__weight"))
        keyed = nodes.withColumn("__key", F.coalesce(F.col(path[depth - 1]).cast("string"), F.lit("")))
        if budget is None:
            keyed, parent = keyed.withColumns({"__parent": F.lit(float(total)), "__root": F.lit(1)}), ["__root"]
        else:
            names = [f"__p{i}" for i in range(depth - 1)]
            above = budget.select(*[F.col(c).alias(n) for c, n in zip(path, names, strict=False)], F.col("__budget").alias("__parent"))
            keyed, parent = keyed.join(above, _all_equal(path[: depth - 1], names)), path[: depth - 1]
        budget = _pour(F.col("__parent"), F.col("__weight"), F.col("__cap"), parent, keyed, "__budget").select(*path[:depth], "__budget")
    return budget.withColumnRenamed("__budget", "budget")


def mix(docs: DataFrame, path: list[str], weights: dict[str, dict[str, float]], tokens: Column, total_share: float = 1.0, epochs: float = 1.0, seed: int = 0, id_column: str = "doc_id") -> DataFrame:
    """docs with leaf_budget and copies: how often a document is taken, in all epochs together.

    total_share is the total budget as a share of all tokens. The last epoch of a leaf is cut behind the first
    document, in that epoch's seeded order, with which the leaf reaches its budget, so a leaf exceeds its budget by
    less than one document. Rows of one id are taken or left together, null ids too; null path values form a leaf of
    their own; null or negative tokens count as none. Columns of docs may have any names: leaf_budget and copies are
    replaced. Only ids, paths and token counts are shuffled; texts meet a table of one row a leaf.
    """
    inputs = [c for c in docs.columns if c not in ("leaf_budget", "copies")]
    keys = [f"__l{i}" for i in range(len(path))]
    narrow = materialise(docs.select(*[F.col(c).alias(k) for c, k in zip(path, keys, strict=True)], F.col(id_column).alias("__id"), F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("__tokens")), "mix-narrow")
    supply = materialise(leaf_supply(narrow, keys, "__tokens"), "mix-supply")
    whole = supply.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()
    named = {k: weights.get(c, {}) for c, k in zip(path, keys, strict=True)}
    planned = budgets(supply, keys, named, whole["supply"] * total_share, epochs)
    other = planned.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("budget").alias("leaf_budget"))
    same = lambda right: _all_equal(keys, [f"{k}{right}" for k in keys])
    full = F.when(F.col("supply") > 0, F.floor(F.col("leaf_budget") / F.col("supply") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    leaves = materialise(supply.join(other, same("_b")).select(*[F.col(k).alias(f"{k}_r") for k in keys], "leaf_budget", full.alias("__full"), (F.col("leaf_budget") - full * F.col("supply")).alias("__last")), "mix-leaves")

    order = lambda i: F.xxhash64(F.lit(seed), F.col("__full"), i.cast("string"))
    ranked = narrow.join(leaves, same("_r")).withColumn("__order", order(F.col("__id"))).select(*keys, "__id", "__tokens", "__order", "__last")
    begun = prefix_sums(ranked, keys, [F.col("__order"), F.col("__id")], "__tokens", "__begin", max(64, whole["n"] // 20_000))
    taken = begun.filter((F.col("__begin") < F.col("__last") - F.lit(1e-6)) & (F.col("__tokens") > 0))
    cuts = taken.groupBy(*keys).agg(F.max(F.struct("__order", "__id")).alias("__cut")).select(*[F.col(k).alias(f"{k}_c") for k in keys], "__cut")
    final = materialise(leaves.join(cuts, _all_equal([f"{k}_r" for k in keys], [f"{k}_c" for k in keys]), "left").select(*[f"{k}_r" for k in keys], "leaf_budget", "__full", "__cut"), "mix-cuts")

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in inputs]).alias("__row"), *[F.col(c).alias(k) for c, k in zip(path, keys, strict=True)], F.col(id_column).alias("__id"))
    place = F.struct(order(F.col("__id")).alias("__order"), F.col("__id"))
    more = F.coalesce((place <= F.col("__cut")).cast("long"), F.lit(0))
    return own.join(final, same("_r")).select("__row.*", "leaf_budget", (F.col("__full") + more).alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each copy taken, without the columns of mix()."""
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("leaf_budget", "copies", "__copy")
