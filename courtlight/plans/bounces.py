"""Registered queries of bounces: scores of a ball's track, and what is left when close ones are suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlight.operators import bounces, contacts, tracks
from courtlight.plans.registry import _r, query
from courtlight.sources.adapters import plain, track_points, view

#: A ball that goes up and down over the events of a user, not always seen, with places on the court that are missing at times.
BALL = """SELECT user_id AS track, event_id AS frame, CASE WHEN event_id % 157 <> 0 THEN CAST(event_id / 20.0 + event_id * 29 % 13 AS DOUBLE) END AS x,
  CAST(300 + abs(event_id % 1400 - 700) * 0.4 + event_id * 37 % 11 AS DOUBLE) AS y, CASE WHEN event_id % 201 <> 0 THEN CAST(event_id % 300 / 10.0 - 5 AS DOUBLE) END AS court_x,
  CAST(event_id * 7 % 560 / 10.0 - 6 AS DOUBLE) AS court_y FROM {events}"""


def _turn(x: str, y: str) -> str:
    a, b = (f"({x}_s - {x}_in)", f"({y}_s - {y}_in)"), (f"({x}_out - {x}_s)", f"({y}_out - {y}_s)")
    size = f"sqrt({a[0]} * {a[0]} + {a[1]} * {a[1]}) * sqrt({b[0]} * {b[0]} + {b[1]} * {b[1]})"
    return f"CASE WHEN {size} > 1e-6 THEN degrees(acos(greatest(-1, least(1, ({a[0]} * {b[0]} + {a[1]} * {b[1]}) / ({size}))))) ELSE 0 END"


def _far(x: str, y: str) -> str:
    length = f"sqrt(power({x}_out - {x}_in, 2) + power({y}_out - {y}_in, 2))"
    return f"CASE WHEN {length} > 1e-6 THEN abs(({x}_out - {x}_in) * ({y}_s - {y}_in) - ({y}_out - {y}_in) * ({x}_s - {x}_in)) / {length} ELSE sqrt(power({x}_s - {x}_in, 2) + power({y}_s - {y}_in, 2)) END"


_FIELDS = ("x", "y", "court_x", "court_y")
SCORES_SQL = f"""
WITH p AS ({plain(BALL)}),
s AS (SELECT *, {", ".join(f"(lag({c}) OVER w + 2 * {c} + lead({c}) OVER w) / 4 AS {c}_s" for c in _FIELDS)}, row_number() OVER w AS i, 30 * sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step
  FROM p WINDOW w AS (PARTITION BY track ORDER BY frame)),
v AS (SELECT *, CASE WHEN i = 1 THEN lead(step) OVER (PARTITION BY track ORDER BY frame) ELSE step END AS v FROM s),
f AS (
  SELECT *, {", ".join(f"avg({c}_s) OVER arm_in AS {c}_in, avg({c}_s) OVER arm_out AS {c}_out" for c in _FIELDS)},
    count(*) OVER whole AS n, count(x + y) OVER whole AS places, count(v) OVER whole AS speeds, count(court_x + court_y) OVER whole AS on_court,
    sqrt((var_pop(x) OVER whole + var_pop(y) OVER whole) / 2) AS spread, max(v) OVER near AS v_peak, median(v) OVER near AS v_mid,
    max(y) OVER arms AS y_top, min(y) OVER arms AS y_low, regr_slope(y, i) OVER come AS y_in_slope, regr_slope(y, i) OVER go AS y_out_slope
  FROM v WINDOW arm_in AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), arm_out AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
    whole AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING), near AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING),
    arms AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), come AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    go AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
g AS (
  SELECT *, {_turn("x", "y")} AS turn, {_far("x", "y")} AS deviation, v_peak / greatest(v_mid, 1) AS ratio, y_in_slope / greatest(spread, 1) AS slope_in, y_out_slope / greatest(spread, 1) AS slope_out,
    CASE WHEN on_court = 20 THEN greatest(least(1, ({_turn("court_x", "court_y")}) / 75), least(1, ({_far("court_x", "court_y")}) / 1.8)) ELSE 0 END AS court_score
  FROM f WHERE n = 20 AND places = 20 AND speeds = 20),
h AS (SELECT *, slope_in > 0.05 AND slope_out < -0.05 AS reversal, y >= y_top - 4 OR y <= y_low + 4 AS extreme FROM g),
scores AS (
  SELECT *, CASE WHEN v > 2500 OR ratio > 12 THEN 'unstable_velocity' WHEN NOT reversal AND NOT extreme THEN 'no_local_y_extreme' END AS reason,
    CASE WHEN v > 2500 OR ratio > 12 OR NOT (reversal OR extreme) THEN 0 ELSE 0.28 * least(1, turn / 95) + 0.24 * least(1, deviation / 18) + 0.12 * least(1, greatest(0, ratio - 1) / 2)
      + CASE WHEN reversal THEN 0.16 ELSE 0 END + CASE WHEN extreme THEN 0.1 ELSE 0 END + 0.1 * court_score END AS score
  FROM h)
"""


@query("win_09_bounce_scores", SCORES_SQL + "SELECT track, frame, round(score, 6) AS score, reason, round(turn, 4) AS turn, round(deviation, 6) AS deviation, round(ratio, 6) AS ratio, round(slope_in, 6) AS slope_in, round(slope_out, 6) AS slope_out FROM scores")
def bounce_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = bounces.scored(view(spark, sf, BALL)).withColumns({c: _r(c) for c in ("score", "deviation", "ratio", "slope_in", "slope_out")})
    return found.withColumn("turn", _r("turn", 4)).drop("x", "y", "court_x", "court_y")


def _greedy_sql(source: str, key: str, at: str, value: str, gap: float, tie: str, kind: str = "BIGINT") -> str:
    """Rows of `source` that greedy suppression keeps: the largest value first, none within the gap of a kept one."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value} DESC, {at}, {tie}) AS n FROM {source}),
walk AS (
  SELECT {key}, CAST(0 AS BIGINT) AS n, CAST([] AS {kind}[]) AS held, false AS kept FROM (SELECT DISTINCT {key} FROM ranked)
  UNION ALL SELECT {key}, n, CASE WHEN free THEN list_append(held, spot) ELSE held END, free
  FROM (SELECT w.{key}, r.n, w.held, r.{at} AS spot, len(list_filter(w.held, lambda h: abs(h - r.{at}) < {gap})) = 0 AS free FROM walk w JOIN ranked r ON r.{key} = w.{key} AND r.n = w.n + 1))"""


@query(
    "win_09_bounces",
    SCORES_SQL.replace("WITH p AS", "WITH RECURSIVE p AS")
    + """, candidates AS (SELECT track, frame, round(score, 3) AS confidence FROM scores WHERE score >= 0.34
  AND (court_x IS NULL OR court_y IS NULL OR (court_x BETWEEN -3 AND 23 AND court_y BETWEEN -3 AND 47))),"""
    + _greedy_sql("candidates", "track", "frame", "confidence", 130, "frame")
    + " SELECT track, frame, confidence FROM ranked JOIN walk USING (track, n) WHERE kept",
)
def bounce_events(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by confidence, none within 130 frames of a better one: the track's frames are ten times as far apart as a camera's."""
    found = bounces.candidates(view(spark, sf, BALL))
    named = found.select(F.col("track").alias("track_id"), F.col("frame").alias("frame_index"), F.col("frame").alias("t_ms"), F.round("score", 3).alias("value"))
    kept = tracks.suppressed(named, 130)
    values = named.select(F.col("track_id").alias("track"), F.col("frame_index").alias("frame"), F.col("value").alias("confidence"))
    return kept.select(F.col("track_id").alias("t"), F.col("frame_index").alias("f")).join(values, (F.col("t") == F.col("track")) & (F.col("f") == F.col("frame"))).select("track", "frame", "confidence")


@query(
    "win_10_suppression",
    "WITH RECURSIVE points AS (SELECT user_id AS track_id, event_id AS frame_index, epoch_us(ts) // 1000 AS t_ms, value FROM events),"
    + _greedy_sql("points", "track_id", "t_ms", "value", 21_600_000, "frame_index")
    + " SELECT track_id, frame_index, t_ms FROM ranked JOIN walk USING (track_id, n) WHERE kept",
)
def suppression(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.suppressed(track_points(spark, sf), 21_600_000)


#: The same ball at a camera's pace, with breaks in its path, stretches without a place, and a jump now and then.
SHOTS = """SELECT user_id AS track, event_id AS frame, CAST(event_id / 2000.0 + CASE WHEN event_id % 900 > 860 THEN 0.2 ELSE 0 END AS DOUBLE) AS t,
  CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 307 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(200 + abs(event_id % 1700 - 850) * 0.9 + event_id * 37 % 7 AS DOUBLE) END AS x,
  CAST(300 + abs(event_id % 1100 - 550) * 0.7 + event_id * 53 % 5 + CASE WHEN event_id % 97 = 0 THEN 90 ELSE 0 END AS DOUBLE) AS y FROM {events}"""


def _arm(name: str) -> str:
    return f"avg(vx) OVER {name}_steps AS {name}_vx, avg(vy) OVER {name}_steps AS {name}_vy, count(*) OVER {name}_arm AS {name}_n, list(x) OVER {name}_arm AS {name}_xs, list(y) OVER {name}_arm AS {name}_ys, regr_slope(y, x) OVER {name}_arm AS {name}_a, avg(x) OVER {name}_arm AS {name}_x, avg(y) OVER {name}_arm AS {name}_y"


def _rough(name: str) -> str:
    return f"list_sum(list_transform(range(1, 5), lambda i: abs(({name}_ys[i] - {name}_y) - CASE WHEN isfinite({name}_a) THEN {name}_a ELSE 0 END * ({name}_xs[i] - {name}_x)))) / 4"


@query(
    "win_11_contacts",
    f"""WITH RECURSIVE p AS (SELECT * FROM ({plain(SHOTS)}) WHERE isfinite(x) AND isfinite(y)),
g AS (SELECT *, t - lag(t) OVER w AS gap, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS vx, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS vy, count(*) OVER (PARTITION BY track) AS n FROM p WINDOW w AS (PARTITION BY track ORDER BY frame)),
a AS (SELECT *, min(gap) OVER c AS g0, max(gap) OVER c AS g1, {_arm("i")}, {_arm("o")} FROM g
  WINDOW c AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING), i_arm AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), o_arm AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
    i_steps AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), o_steps AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING)),
b AS (SELECT *, sqrt(i_vx * i_vx + i_vy * i_vy) AS s0, sqrt(o_vx * o_vx + o_vy * o_vy) AS s1 FROM a WHERE n >= 10 AND i_n = 4 AND o_n = 4 AND g0 > 0 AND g1 <= 0.12),
c AS (SELECT *, CASE WHEN s0 * s1 > 1e-6 THEN degrees(acos(greatest(-1, least(1, (i_vx * o_vx + i_vy * o_vy) / (s0 * s1))))) ELSE 0 END AS turn, greatest(s0, s1) / greatest(least(s0, s1), 1e-6) AS ratio, {_rough("i")} AS r0, {_rough("o")} AS r1 FROM b),
found AS (SELECT track, frame, t, r0 > 18 OR r1 > 18 AS rough, CASE WHEN r0 > 18 OR r1 > 18 THEN 0 ELSE round(greatest(0.05, 0.6 * least(1, turn / 90) + 0.4 * least(1, greatest(0, ratio - 1) / 1.5)), 3) END AS confidence, turn, ratio, r0, r1 FROM c WHERE turn >= 35 OR ratio >= 1.8),
candidates AS (SELECT * FROM found WHERE NOT rough),"""
    + _greedy_sql("candidates", "track", "t", "confidence", 10.0 / 30.0, "frame", "DOUBLE")
    + """ SELECT track, frame, confidence, CASE WHEN rough THEN 'rejected_hit' WHEN kept THEN 'confirmed_hit' ELSE 'hit_candidate' END AS status, round(turn, 4) AS turn, round(ratio, 4) AS ratio, round(r0, 6) AS residual_in, round(r1, 6) AS residual_out
FROM found LEFT JOIN (SELECT ranked.track, ranked.frame, walk.kept FROM ranked JOIN walk USING (track, n)) USING (track, frame)""",
)
def contact_events(spark: SparkSession, sf: str) -> DataFrame:
    found = contacts.contacts(view(spark, sf, SHOTS)).drop("t")
    return found.withColumns({"turn": _r("turn", 4), "ratio": _r("ratio", 4), "residual_in": _r("residual_in"), "residual_out": _r("residual_out")})
