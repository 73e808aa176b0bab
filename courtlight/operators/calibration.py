"""Homographies from point pairs: seeded consensus over bounded draws, then least squares on what agrees with the best.

Sums over points are Spark's; a calibration's small systems (four points, or nine by nine numbers) are solved in one call
each. Points of one calibration may lie anywhere and be many. What has one row a calibration is written between the passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.sources.folders import written

# fixed values: point pairs that a solution needs, and feet within which a point agrees with one
LEAST, AGREE_FT = 4, 3.0
#: Draws of four points, from so many of a calibration's distinct pairs, the first by a seeded hash.
DRAWS, POOL, SEED = 64, 32, 7
#: Relative sizes below which a draw, or a sum of squares, has more than one solution; a last number too small to scale by.
SINGULAR, SINGULAR_SUM, TINY = 1e-6, 1e-13, 1e-12


def _rows(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two equations a pair, linear in the nine numbers of the matrix."""
    one, zero = np.ones_like(u), np.zeros_like(u)
    first = np.stack([u, v, one, zero, zero, zero, -u * x, -v * x, -x], axis=-1)
    second = np.stack([zero, zero, zero, u, v, one, -u * y, -v * y, -y], axis=-1)
    return np.concatenate([first, second], axis=-2)


def _null(normal: np.ndarray) -> np.ndarray | None:
    """The solution of a sum of squares of equations, or None if there is more than one."""
    values, vectors = np.linalg.eigh(normal)
    return vectors[:, 0] if values[-1] > 0 and values[1] > SINGULAR_SUM * values[-1] else None


def _scaled(h: np.ndarray) -> list[float] | None:
    """The matrix with a last number of one, or None where it has none."""
    return list(h / h[-1]) if abs(h[-1]) > TINY else None


def _shape(c: dict[str, Column]) -> list[Column]:
    """The 45 sums that make up the normal matrix, on the JVM; pairs are u, v, x, y, scaled to the size of one."""
    one, zero = F.lit(1.0), F.lit(0.0)
    u, v, x, y = c["u"], c["v"], c["x"], c["y"]
    first = [u, v, one, zero, zero, zero, -u * x, -v * x, -x]
    second = [zero, zero, zero, u, v, one, -u * y, -v * y, -y]
    return [F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"n{i}_{j}") for i in range(9) for j in range(i, 9)]


SCALES = ("u_mean", "v_mean", "x_mean", "y_mean", "u_size", "x_size")


def _denormalised(h: np.ndarray, s: dict) -> np.ndarray:
    to = np.array([[1 / s["u_size"], 0, -s["u_mean"] / s["u_size"]], [0, 1 / s["u_size"], -s["v_mean"] / s["u_size"]], [0, 0, 1]])
    back = np.array([[s["x_size"], 0, s["x_mean"]], [0, s["x_size"], s["y_mean"]], [0, 0, 1]])
    return back @ h.reshape(3, 3) @ to


def reprojected(h: Column, u: Column, v: Column, x: Column, y: Column) -> Column:
    """Feet between where a matrix (nine numbers) puts an image point and where it belongs; null where it has no place."""
    w = h[6] * u + h[7] * v + h[8]
    px, py = (h[0] * u + h[1] * v + h[2]) / F.nullif(w, F.lit(0.0)), (h[3] * u + h[4] * v + h[5]) / F.nullif(w, F.lit(0.0))
    return F.sqrt((px - x) * (px - x) + (py - y) * (py - y))


def homographies(points: DataFrame, agree_ft: float = AGREE_FT) -> DataFrame:
    """calibration, status, matrix (nine numbers, the last one 1), points, inliers, rms of each calibration.

    points: calibration, u, v (image), x, y (court feet). A pair that is not finite is an error of the input: status
    invalid. Fewer than four pairs, or than four different points on a side, are too_few; pairs on a line or otherwise
    without one solution are degenerate; fewer than four pairs that agree with the best draw within `agree_ft` are
    inconsistent. Repeated pairs count as often as they come, but are drawn once. Draws are the same at every run and for
    every order of rows; ties of draws go to the first. A null calibration is one of its own.
    """
    number = lambda c: F.col(c).cast("double")
    own = points.select("calibration", *[number(c).alias(c) for c in "uvxy"])
    finite = [F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in "uvxy"]
    good = finite[0] & finite[1] & finite[2] & finite[3]
    counts = own.groupBy("calibration").agg(
        F.count("*").alias("points"),
        F.bool_and(good).alias("valid"),
        *[F.avg(c).alias(f"{c}_mean") for c in "uvxy"],
        F.greatest(F.sqrt(F.var_pop("u") + F.var_pop("v")), F.lit(1e-9)).alias("u_size"),
        F.greatest(F.sqrt(F.var_pop("x") + F.var_pop("y")), F.lit(1e-9)).alias("x_size"),
    )
    pool = own.filter(good).distinct().withColumn("__h", F.xxhash64(F.lit(SEED), "u", "v", "x", "y"))
    pool = pool.withColumn("nth", F.row_number().over(W.partitionBy("calibration").orderBy("__h", "u", "v", "x", "y"))).filter(F.col("nth") <= POOL)
    pools = pool.groupBy("calibration").agg(F.array_sort(F.collect_list(F.struct("nth", "u", "v", "x", "y"))).alias("pool"), F.size(F.collect_set(F.struct("u", "v"))).alias("sources"), F.size(F.collect_set(F.struct("x", "y"))).alias("targets"))
    kind = own.schema["calibration"].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidate matrices of each calibration: of draws of four pairs that determine one."""
        for batch in batches:
            out = []
            for pool in batch["pool"]:
                p = np.array([[q["u"], q["v"], q["x"], q["y"]] for q in pool], float)
                found = []
                if len(p) >= LEAST:
                    mean, size = p.mean(axis=0), np.maximum([p[:, :2].std(), p[:, :2].std(), p[:, 2:].std(), p[:, 2:].std()], 1e-9)
                    scaled = (p - mean) / size
                    scales = dict(zip(SCALES, [*mean, size[0], size[2]], strict=True))
                    rng = np.random.default_rng(SEED)
                    for _ in range(DRAWS):
                        four = scaled[rng.choice(len(p), LEAST, replace=False)]
                        _, sizes, vectors = np.linalg.svd(_rows(*four.T))
                        h = _scaled(_denormalised(vectors[8], scales).ravel()) if sizes[7] > SINGULAR * sizes[0] else None
                        if h is not None:
                            found.append(h)
                out.append(found)
            yield batch[["calibration", "sources", "targets"]].assign(draws=out)

    drawn = written(pools.mapInPandas(draw, f"calibration {kind}, sources int, targets int, draws array<array<double>>"), "draws")
    same = lambda other: F.col("calibration").eqNullSafe(F.col(other))
    named = lambda df, name: df.withColumnRenamed("calibration", name)
    tried = own.filter(good).join(named(drawn.filter(F.size("draws") > 0).select("calibration", "draws"), "__d"), same("__d"))
    near = lambda h: F.coalesce(reprojected(h, *[F.col(c) for c in "uvxy"]) <= agree_ft, F.lit(False))
    votes = tried.select("calibration", *"uvxy", F.posexplode("draws").alias("nth", "draw")).filter(near(F.col("draw"))).groupBy("calibration", "nth").agg(F.count("*").alias("n"))
    best = votes.groupBy("calibration").agg(F.max("n").alias("agree"), F.max_by("nth", F.struct("n", -F.col("nth"))).alias("nth"))
    chosen = drawn.join(named(best, "__b"), same("__b"), "left").select("calibration", "sources", "targets", "agree", F.get("draws", F.col("nth")).alias("draw"))
    chosen = written(chosen, "chosen")
    agreed = own.filter(good).join(named(chosen.select("calibration", "draw"), "__c"), same("__c")).filter(near(F.col("draw"))).drop("__c", "draw")
    scales = named(counts.select("calibration", *SCALES), "__s")
    scaled = agreed.join(scales, same("__s")).select("calibration", *[((F.col(c) - F.col(f"{c}_mean")) / F.col("u_size" if c in "uv" else "x_size")).alias(c) for c in "uvxy"])
    sums = scaled.groupBy("calibration").agg(*_shape({c: F.col(c) for c in "uvxy"}))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                normal = np.zeros((9, 9))
                for i in range(9):
                    for j in range(i, 9):
                        normal[i, j] = normal[j, i] = row[f"n{i}_{j}"]
                h = _null(normal)
                out.append(None if h is None else _scaled(_denormalised(h, row).ravel()))
            yield batch[["calibration"]].assign(matrix=out)

    solved = written(sums.join(scales, same("__s")).drop("__s").mapInPandas(solve, f"calibration {kind}, matrix array<double>"), "solved")
    error = own.filter(good).join(named(solved.filter("matrix IS NOT NULL"), "__m"), same("__m")).withColumn("off", reprojected(F.col("matrix"), *[F.col(c) for c in "uvxy"]))
    fit = error.groupBy("calibration").agg(F.count_if(F.col("off") <= agree_ft).alias("inliers"), F.sqrt(F.avg(F.when(F.col("off") <= agree_ft, F.col("off") * F.col("off")))).alias("rms"))
    table = counts.select("calibration", "points", "valid").join(named(chosen, "__c"), same("__c"), "left").join(named(solved, "__m"), same("__m"), "left").join(named(fit, "__f"), same("__f"), "left")
    few = (F.col("points") < LEAST) | (F.coalesce("sources", F.lit(0)) < LEAST) | (F.coalesce("targets", F.lit(0)) < LEAST)
    status = F.when(~F.col("valid"), "invalid").when(few, "too_few").when(F.col("draw").isNull(), "degenerate").when(F.coalesce("agree", F.lit(0)) < LEAST, "inconsistent").when(F.col("matrix").isNull() | F.col("rms").isNull(), "degenerate").otherwise("ok")
    ok = F.col("status") == "ok"
    return table.withColumn("status", status).select("calibration", "status", F.when(ok, F.col("matrix")).alias("matrix"), "points", F.when(ok, F.col("inliers")).otherwise(0).alias("inliers"), F.when(ok, F.col("rms")).alias("rms"))
