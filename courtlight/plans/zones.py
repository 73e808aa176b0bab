"""Registered query of zone statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtlight.operators import zones
from courtlight.plans.registry import query
from courtlight.sources.adapters import plain, view

#: Users are players of a take, orders its windows; one take has none, windows overlap, some end before they start.
POINTS = """SELECT user_id % 7 AS take, CASE WHEN user_id % 41 <> 0 THEN 'P' || (user_id % 60) END AS player, CASE WHEN event_id % 37 <> 0 THEN CAST(floor(event_id / 2) AS DOUBLE) / 2 END AS t, event_id AS seq,
  CASE WHEN event_id % 43 <> 0 THEN CAST(event_id * 37 % 2800 / 100.0 - 4 AS DOUBLE) END AS x, CAST(user_id % 2 * 12 + event_id * 53 % 4600 / 100.0 - 8 AS DOUBLE) AS y FROM {events}"""
WINDOWS = 'SELECT o_custkey % 6 AS take, CAST(o_orderkey % 2500 AS DOUBLE) AS start, CAST(o_orderkey % 2500 + o_orderkey % 7 * 0.5 - 0.5 AS DOUBLE) AS "end" FROM {orders}'


@query(
    "agg_04_zone_stats",
    f"""WITH p AS (SELECT * FROM ({plain(POINTS)}) WHERE t IS NOT NULL AND x BETWEEN -4 AND 24 AND y BETWEEN -8 AND 52), w AS ({plain(WINDOWS)}),
s AS (SELECT take, sum(greatest(0, "end" - start)) AS seconds FROM w GROUP BY 1),
q AS (SELECT p.*, s.seconds, s.take IS NULL OR EXISTS (SELECT 1 FROM w WHERE w.take = p.take AND p.t >= w.start AND p.t < w."end") AS played FROM p LEFT JOIN s USING (take)),
d AS (SELECT *, CASE WHEN played THEN coalesce(lead(t) OVER (PARTITION BY take, player ORDER BY t, seq) - t, 0) ELSE 0 END AS step FROM q),
m AS (SELECT take, player, list_sort(list(y))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM q WHERE played GROUP BY ALL),
g AS (
  SELECT d.take, d.player, any_value(median) AS median, CASE WHEN any_value(seconds) IS NOT NULL THEN any_value(seconds) ELSE max(t) - min(t) END AS n, sum(step) AS tracked,
    sum(CASE WHEN x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 44 THEN step END) AS weight, sum(CASE WHEN x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 44 THEN step * CASE WHEN median < 22 THEN abs(y - 15) WHEN median > 22 THEN abs(y - 29) ELSE least(abs(y - 15), abs(y - 29)) END END) AS away,
    coalesce(sum(step) FILTER (WHERE x BETWEEN 0 AND 20 AND y BETWEEN 15 AND 29), 0) AS kitchen, coalesce(sum(step) FILTER (WHERE x BETWEEN 0 AND 20 AND ((y >= 7 AND y < 15) OR (y > 29 AND y <= 37))), 0) AS transition,
    coalesce(sum(step) FILTER (WHERE x BETWEEN 0 AND 20 AND ((y >= 0 AND y < 7) OR (y > 37 AND y <= 44))), 0) AS backcourt
  FROM d LEFT JOIN m ON m.take = d.take AND m.player IS NOT DISTINCT FROM d.player GROUP BY d.take, d.player),
h AS (SELECT *, CASE WHEN weight > 0 THEN away / weight * 0.3048 ELSE 0 END AS metres FROM g)
SELECT take, player, round(n, 2) AS played_s, round(tracked, 2) AS tracked_s, CASE WHEN n > 0 AND tracked / n >= 0.3 THEN 'sufficient' ELSE 'insufficient' END AS data,
  CASE WHEN n > 0 THEN round(least(1, kitchen / n), 4) ELSE 0 END AS kitchen_share, round(metres, 1) AS to_line_m, CASE WHEN metres <= 0.9 THEN 'near_line' WHEN metres <= 0.9 * 1.5 THEN 'moderate' ELSE 'deep' END AS feedback,
  CASE WHEN median < 22 THEN 'near' WHEN median > 22 THEN 'far' END AS side, round(kitchen, 2) AS kitchen_s, round(transition, 2) AS transition_s, round(backcourt, 2) AS backcourt_s,
  CASE WHEN n > 0 THEN round(kitchen / n, 4) ELSE 0 END AS kitchen_occupancy, CASE WHEN n > 0 THEN round(transition / n, 4) ELSE 0 END AS transition_occupancy, CASE WHEN n > 0 THEN round(backcourt / n, 4) ELSE 0 END AS backcourt_occupancy FROM h""",
)
def zone_stats(spark: SparkSession, sf: str) -> DataFrame:
    return zones.zone_stats(view(spark, sf, POINTS), view(spark, sf, WINDOWS.replace('"end"', "`end`")))
