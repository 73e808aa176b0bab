"""Record shapes of the tracking domain, derived from the general tables with integer arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Milliseconds since 1970 of a timestamp without a zone.
MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, frame_index, t_ms, x_ft, y_ft: from a bit outside one corner to a bit outside the other."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("frame_index"),
        F.expr(MS).alias("t_ms"),
        ((F.col("event_id") * 37 % 2800) / 100 - 4).alias("x_ft"),
        ((F.col("event_id") * 53 % 6000) / 100 - 8).alias("y_ft"),
        "event_type",
        "value",
    )


TRACK_POINTS_SQL = "track_points AS (SELECT user_id AS track_id, event_id AS frame_index, epoch_us(ts) // 1000 AS t_ms, (event_id * 37 % 2800) / 100 - 4 AS x_ft, (event_id * 53 % 6000) / 100 - 8 AS y_ft, event_type, value FROM events)"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """take, t_ms, id, kind: signups start a rally, purchases end it."""
    kind = F.when(F.col("event_type") == "signup", "rally_start").when(F.col("event_type") == "purchase", "rally_end")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("take"), F.expr(MS).alias("t_ms"), F.col("event_id").alias("id"), kind.alias("kind")).filter("kind IS NOT NULL")


TIMELINE_SQL = "timeline AS (SELECT user_id % 4 AS take, epoch_us(ts) // 1000 AS t_ms, event_id AS id, CASE event_type WHEN 'signup' THEN 'rally_start' ELSE 'rally_end' END AS kind FROM events WHERE event_type IN ('signup', 'purchase'))"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table by SQL that both engines read; tables stand in it as {name}.

    A division by a number with a point gives a double, as in the other engine: Spark alone would divide decimals, and
    places that lie just on a limit would fall on another side of it.
    """
    names = {part.split("}")[0] for part in sql.split("{")[1:]}
    return spark.sql(re.sub(r"/ (\d+\.\d+)\b", r"/ \1D", sql), **{name: read(spark, sf_dir, name) for name in names})


def plain(sql: str) -> str:
    """The same SQL for an engine that knows the tables by name."""
    return sql.replace("{", "").replace("}", "")
