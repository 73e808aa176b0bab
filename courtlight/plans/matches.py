"""Registered queries of matches, cameras, editing and reports: name -> (query, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court, vision
from courtlight.operators import intervals, matches
from courtlight.plans.registry import CLICKS, POINTS, _r, _two_views, query
from courtlight.sources.adapters import MS, read, track_points

def _e() -> Column:
    return F.col("event_id")


#: The order of an order's lines; numbers may repeat.
LINES = ["l_linenumber", "l_partkey", "l_suppkey"]
#: A homography from an image of 1920 x 1080 to feet; every place has a third coordinate of its own.
H = [0.012, 0.001, -1.5, 0.0005, 0.045, -2.0, 0.00001, 0.0002, 1.0]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("t_ms", F.expr(MS))


EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS t_ms FROM events)"


@query(
    "prj_02_projection",
    """SELECT event_id, round((0.012 * x + 0.001 * y - 1.5) / w, 6) AS court_x, round((0.0005 * x + 0.045 * y - 2.0) / w, 6) AS court_y
       FROM (SELECT event_id, x, y, 0.00001 * x + 0.0002 * y + 1.0 AS w
             FROM (SELECT event_id, CAST(event_id * 37 % 1920 AS DOUBLE) AS x, CAST(event_id * 53 % 1080 AS DOUBLE) AS y FROM events))""",
)
def projection(spark: SparkSession, sf: str) -> DataFrame:
    p = vision.projected(H, (_e() * 37 % 1920).cast("double"), (_e() * 53 % 1080).cast("double"))
    return read(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", _r("p.x").alias("court_x"), _r("p.y").alias("court_y"))


@query(
    "prj_07_service_zone",
    POINTS
    + """ SELECT frame_index, x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 15 AND 29 AS kitchen,
       CASE WHEN y_ft BETWEEN 0 AND 15 AND x_ft BETWEEN 0 AND 10 THEN 'near_left_service' WHEN y_ft BETWEEN 0 AND 15 AND x_ft BETWEEN 10 AND 20 THEN 'near_right_service'
            WHEN y_ft BETWEEN 29 AND 44 AND x_ft BETWEEN 0 AND 10 THEN 'far_left_service' WHEN y_ft BETWEEN 29 AND 44 AND x_ft BETWEEN 10 AND 20 THEN 'far_right_service' END AS service FROM track_points""",
)
def service_zone(spark: SparkSession, sf: str) -> DataFrame:
    """The first zone that holds a point: shared edges belong to the earlier one."""
    x, y = F.col("x_ft"), F.col("y_ft")
    near, far, left, right = y.between(0, 15), y.between(29, 44), x.between(0, 10), x.between(10, 20)
    service = F.when(near & left, "near_left_service").when(near & right, "near_right_service").when(far & left, "far_left_service").when(far & right, "far_right_service")
    return track_points(spark, sf).select("frame_index", court.in_kitchen(x, y).alias("kitchen"), service.alias("service"))


CANDIDATES = """c AS (SELECT event_id, value / 500 AS confidence, CAST(event_id * 7 % 60 AS DOUBLE) AS width, CAST(event_id * 11 % 40 AS DOUBLE) + 1 AS height,
  event_id % 13 <> 0 AS in_roi, event_id % 17 <> 0 AS projects, (event_id * 37 % 2800) / 100 - 4 AS x, (event_id * 53 % 6000) / 100 - 8 AS y FROM events)"""


@query(
    "prj_11_candidate_gate",
    "WITH "
    + CANDIDATES
    + """, v AS (SELECT CASE WHEN confidence < 0.22 THEN 'low_confidence' WHEN width < 2 OR height < 2 THEN 'box_too_small' WHEN width * height / 400000 > 0.004 THEN 'box_too_large'
    WHEN greatest(width / height, height / width) > 4 THEN 'aspect_ratio' WHEN NOT in_roi THEN 'outside_roi' WHEN NOT projects THEN 'invalid_court_projection'
    WHEN NOT (x BETWEEN -2 AND 22 AND y BETWEEN -2 AND 46) THEN 'outside_court_projection' ELSE 'accepted' END AS reason FROM c)
    SELECT CASE reason WHEN 'accepted' THEN 'accepted' WHEN 'invalid_court_projection' THEN 'diagnostic_only' ELSE 'rejected' END AS status, reason, count(*) AS n FROM v GROUP BY ALL""",
)
def candidate_gate(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda k, m: (_e() * k % m).cast("double")
    x, y = (_e() * 37 % 2800) / 100 - 4, (_e() * 53 % 6000) / 100 - 8
    verdict = vision.candidate_verdict(F.col("value") / 500, size(7, 60), size(11, 40) + 1, 400_000.0, _e() % 13 != 0, x, y, _e() % 17 != 0)
    return read(spark, sf, "events").select(verdict.alias("v")).groupBy("v.status", "v.reason").agg(F.count("*").alias("n"))


@query("prj_14_roi_filter", "SELECT event_id FROM (SELECT event_id, event_id * 37 % 1920 AS x, event_id * 53 % 1080 AS y FROM events) WHERE x BETWEEN 200 AND 1700 AND y BETWEEN 100 AND 900")
def roi_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Detections whose box bottom centre lies in the closed region."""
    return read(spark, sf, "events").filter((_e() * 37 % 1920).between(200, 1700) & (_e() * 53 % 1080).between(100, 900)).select("event_id")


STATUS = "CASE event_id % 5 WHEN 0 THEN 'dual_observed' WHEN 1 THEN 'single_view_fallback' WHEN 2 THEN 'conflict' WHEN 3 THEN 'interpolated' ELSE 'predicted' END"


def _status() -> Column:
    return F.element_at(F.array(*map(F.lit, ["dual_observed", "single_view_fallback", "conflict", "interpolated", "predicted"])), (_e() % 5 + 1).cast("int"))


@query("prj_15_eligibility", f"WITH s AS (SELECT *, {STATUS} AS status FROM events) SELECT status, count(*) AS n, count(*) FILTER (WHERE status IN ('dual_observed', 'single_view_fallback') OR (status IN ('conflict', 'interpolated') AND user_id % 2 = 0)) AS eligible FROM s GROUP BY 1")
def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    ok = s.isin("dual_observed", "single_view_fallback") | (s.isin("conflict", "interpolated") & (F.col("user_id") % 2 == 0))
    return read(spark, sf, "events").withColumn("status", _status()).groupBy("status").agg(F.count("*").alias("n"), F.count_if(ok).alias("eligible"))


@query("prj_16_source_precedence", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'fused' WHEN bool_or(event_type = 'signup') THEN 'single_view' ELSE 'unavailable' END AS source FROM events GROUP BY 1")
def source_precedence(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    return read(spark, sf, "events").groupBy("user_id").agg(F.when(has("purchase"), "fused").when(has("signup"), "single_view").otherwise("unavailable").alias("source"))


@query(
    "prj_20_box_overlap",
    """WITH b AS (SELECT event_id, CAST(event_id * 7 % 50 AS DOUBLE) AS l, CAST(event_id * 11 % 50 AS DOUBLE) AS t, event_id * 7 % 50 + 20.0 + event_id % 9 AS r, event_id * 11 % 50 + 30.0 AS m FROM events),
    p AS (SELECT a.event_id, greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.m, b.m) - greatest(a.t, b.t)) AS i, (a.r - a.l) * (a.m - a.t) + (b.r - b.l) * (b.m - b.t) AS s FROM b a JOIN b b ON b.event_id = a.event_id + 1)
    SELECT event_id, round(i / (s - i), 6) AS iou FROM p""",
)
def box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    left, top = (_e() * 7 % 50).cast("double"), (_e() * 11 % 50).cast("double")
    box = read(spark, sf, "events").select("event_id", F.struct(left.alias("l"), top.alias("t"), (left + 20 + _e() % 9).alias("r"), (top + 30).alias("m")).alias("a"))
    other = box.select((_e() - 1).alias("before"), F.col("a").alias("b"))
    corners = lambda s: [F.col(f"{s}.{c}") for c in "ltrm"]
    return box.join(other, _e() == F.col("before")).select("event_id", _r(vision.iou(corners("a"), corners("b"))).alias("iou"))


QUALITY = """q AS (SELECT event_id, least(1.0, value / 500) AS s0, CASE WHEN event_id % 3 > 0 THEN least(1.0, (event_id % 40) / 25) END AS s1, CASE WHEN event_id % 4 > 0 THEN (event_id % 10) / 10 END AS s2,
  0.7 AS s3, CASE WHEN event_id % 5 = 0 THEN 0.7 ELSE 1.0 END AS s4, event_id % 7 = 0 AS interp, event_id % 11 = 0 AS warned, (event_id % 60) / 1000 AS late FROM events),
  v AS (SELECT *, (0.3 * s0 + coalesce(0.3 * s1, 0) + coalesce(0.2 * s2, 0) + 0.1 * s3 + 0.1 * s4) / (0.5 + CASE WHEN s1 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN s2 IS NULL THEN 0 ELSE 0.2 END)
  * CASE WHEN interp THEN 0.2 ELSE 1 END * CASE WHEN warned THEN 0.85 ELSE 1 END * CASE WHEN late > 1.0 / 30 THEN 0.6 ELSE 1 END AS quality FROM q)"""


def _quality() -> Column:
    scores = [F.col("value") / 500, F.when(_e() % 3 > 0, _e() % 40 / 25), F.when(_e() % 4 > 0, _e() % 10 / 10), F.lit(0.7), F.when(_e() % 5 == 0, 0.7).otherwise(1.0)]
    return vision.view_quality(scores, _e() % 7 == 0, _e() % 11 == 0, _e() % 60 / 1000)


@query("prj_22_view_quality", "WITH " + QUALITY + " SELECT event_id, round(quality, 10) AS quality FROM v")
def view_quality(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", _r(_quality(), 10).alias("quality"))


@query(
    "prj_23_fusion_weights",
    """WITH p AS (SELECT event_id, (event_id * 31 % 100) / 100 AS a, (event_id * 17 % 100) / 100 AS b, (event_id * 13 % 100) / 100 AS c, event_id % 4 = 0 AS d FROM events),
    t AS (SELECT *, CASE WHEN c < 0.5 THEN 0.5 - c ELSE 0 END AS k FROM p),
    x AS (SELECT *, a * (CASE WHEN a > b THEN 1 + k ELSE 1 - k END) AS u0, b * (CASE WHEN a > b THEN 1 - k ELSE 1 + k END) AS v0 FROM t),
    y AS (SELECT *, CASE WHEN NOT d THEN u0 WHEN u0 > v0 THEN greatest(u0, 0.55) ELSE least(u0, 0.45) END AS u, CASE WHEN NOT d THEN v0 WHEN u0 > v0 THEN least(v0, 0.45) ELSE greatest(v0, 0.55) END AS v FROM x)
    SELECT event_id, round(CASE WHEN (a <= 0 AND b <= 0) OR u + v <= 0 THEN 0.5 ELSE u / (u + v) END, 6) AS weight FROM y""",
)
def fusion_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = vision.fusion_weights(_e() * 31 % 100 / 100, _e() * 17 % 100 / 100, _e() * 13 % 100 / 100, _e() % 4 == 0)
    return read(spark, sf, "events").select("event_id", _r(w).alias("weight"))


@query(
    "fus_01_fusion",
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN (event_id * 37 % 2000) / 100 END AS ax, (event_id * 53 % 4400) / 100 AS ay, CASE WHEN event_id % 8 > 0 THEN (event_id * 37 % 2000) / 100 + (event_id % 50) / 10 END AS bx, (event_id * 53 % 4400) / 100 + 0.5 AS by_,
      (event_id * 31 % 100) / 100 AS qa, (event_id * 17 % 100) / 100 AS qb, CASE WHEN event_id % 2 = 0 THEN 10.0 END AS px, 22.0 AS py FROM events),
    d AS (SELECT *, sqrt(power(ax - bx, 2) + power(ay - by_, 2)) AS d FROM p), c AS (SELECT *, greatest(0, 1 - d / 3) AS c FROM d),
    t AS (SELECT *, CASE WHEN c < 0.5 THEN 0.5 - c ELSE 0 END AS k FROM c),
    w AS (SELECT *, qa * (CASE WHEN qa > qb THEN 1 + k ELSE 1 - k END) AS u, qb * (CASE WHEN qa > qb THEN 1 - k ELSE 1 + k END) AS v FROM t),
    f AS (SELECT *, CASE WHEN u + v <= 0 THEN 0.5 ELSE u / (u + v) END AS wa, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL AND d <= 3 THEN 1 WHEN ax IS NOT NULL AND bx IS NOT NULL AND px IS NOT NULL AND qa < 0.2 AND qb < 0.2 THEN 2
      WHEN ax IS NOT NULL AND bx IS NOT NULL AND qa >= qb THEN 3 WHEN ax IS NOT NULL AND bx IS NOT NULL THEN 4 WHEN ax IS NOT NULL THEN 5 WHEN bx IS NOT NULL THEN 6 END AS kind FROM w)
    SELECT event_id, round(CASE kind WHEN 1 THEN wa * ax + (1 - wa) * bx WHEN 2 THEN px WHEN 3 THEN ax WHEN 4 THEN bx WHEN 5 THEN ax ELSE bx END, 9) AS x, round(CASE kind WHEN 1 THEN wa * ay + (1 - wa) * by_ WHEN 2 THEN py WHEN 3 THEN ay WHEN 4 THEN by_ WHEN 5 THEN ay ELSE by_ END, 9) AS y,
      CASE WHEN kind = 1 THEN 'dual_observed' WHEN kind < 5 THEN 'conflict' ELSE 'single_view_fallback' END AS status, round(CASE kind WHEN 1 THEN least(c, greatest(qa, qb)) WHEN 5 THEN qa WHEN 6 THEN qb ELSE greatest(qa, qb) * 0.3 END, 6) AS confidence,
      CASE kind WHEN 2 THEN 'prediction' WHEN 3 THEN 'reference' WHEN 4 THEN 'secondary' WHEN 5 THEN 'reference' WHEN 6 THEN 'secondary' END AS "view", kind <> 2 AS eligible FROM f WHERE kind IS NOT NULL""",
)
def fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks seen by no view give no row."""
    x, y = _e() * 37 % 2000 / 100, _e() * 53 % 4400 / 100
    one = vision.fused(F.when(_e() % 9 > 0, x), y, F.when(_e() % 8 > 0, x + _e() % 50 / 10), y + 0.5, _e() * 31 % 100 / 100, _e() * 17 % 100 / 100, F.when(_e() % 2 == 0, 10.0), F.lit(22.0))
    rows = read(spark, sf, "events").select("event_id", one.alias("f")).filter("f IS NOT NULL")
    return rows.select("event_id", _r("f.x", 9).alias("x"), _r("f.y", 9).alias("y"), "f.status", _r("f.confidence").alias("confidence"), "f.view", "f.eligible")


PLAN = (
    "WITH "
    + CLICKS
    + """, b AS (SELECT c.*, v.t_ms AS bt, v.event_id AS bv FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t_ms >= v.t_ms),
 n AS (SELECT b.*, v.t_ms AS ft, v.event_id AS fv FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t_ms <= v.t_ms),
 m AS (SELECT *, bt IS NOT NULL AND (ft IS NULL OR t_ms - bt <= ft - t_ms) AS back FROM n),
 d AS (SELECT *, CASE WHEN (CASE WHEN back THEN t_ms - bt ELSE ft - t_ms END) <= 43200000 THEN 'ok' ELSE 'unavailable' END AS s, CASE WHEN back THEN bv ELSE fv END AS near FROM m),
 e AS (SELECT *, CASE WHEN s = 'ok' THEN near * 7 % 1000 END AS frame FROM d),
 g AS (SELECT *, max(frame) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e)"""
)


def _plan(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    left, right = _two_views(spark, sf)
    near = intervals.nearest(left, right, "user_id", "t_ms", "event_id", 43_200_000).withColumn("frame", F.col("match") * 7 % 1000)
    return matches.pairing_plan(near, "user_id", ["t_ms", "event_id"], "frame", strict).select("event_id", "status", "frame")


@query("jon_04_pairing_plan", PLAN + " SELECT event_id, CASE WHEN frame < reached THEN 'non_monotonic' ELSE s END AS status, CASE WHEN frame < reached THEN NULL ELSE frame END AS frame FROM g")
def pairing_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf, False)


@query("jon_05_consume_once", PLAN + " SELECT event_id, CASE WHEN frame <= reached THEN 'no_new_frame' ELSE s END AS status, CASE WHEN frame <= reached THEN NULL ELSE frame END AS frame FROM g")
def consume_once(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf, True)


@query("jon_21_unique_reference", "WITH k AS (SELECT o_custkey, o_orderdate, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, o_orderdate, CASE WHEN n = 1 THEN k END AS o_orderkey, CASE WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM k")
def unique_reference(spark: SparkSession, sf: str) -> DataFrame:
    """A reference by customer and day names an order only if there is just one."""
    found = read(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    one = F.col("n") == 1
    return found.select("o_custkey", "o_orderdate", F.when(one, F.col("k")).alias("o_orderkey"), F.when(one, "ok").otherwise("ambiguous").alias("status"))


@query("jon_22_identity_map", "WITH m AS (SELECT c_acctbal % 100 AS alias, min(c_custkey) AS player FROM customer GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey, player FROM customer JOIN m ON c_acctbal % 100 = alias")
def identity_map(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases that name several players are dropped."""
    customers = read(spark, sf, "customer").withColumn("of", F.col("c_acctbal") % 100)
    known = customers.groupBy(F.col("of").alias("alias")).agg(F.min("c_custkey").alias("player"), F.count("*").alias("n")).filter("n = 1")
    return customers.join(known, F.col("of") == F.col("alias")).select("c_custkey", "player")


@query("jon_24_job_plan", "SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def job_plan(spark: SparkSession, sf: str) -> DataFrame:
    jobs = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return read(spark, sf, "lineitem").join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber")


@query(
    "agg_08_metric_snapshot",
    """WITH s AS (SELECT o_custkey AS player, c_nationkey AS team, CAST(round(l_discount * 100) AS INT) AS quality FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linestatus = 'F')
    SELECT CASE WHEN grouping(player) = 0 THEN 'player' WHEN grouping(team) = 0 THEN 'team' ELSE 'match' END AS scope, player, team, count(*) AS shots, CASE WHEN count(*) >= 3 THEN round(avg(quality), 6) END AS quality, CASE WHEN count(*) >= 3 THEN 'available' ELSE 'insufficient_sample' END AS status
    FROM s GROUP BY GROUPING SETS ((), (player), (team))""",
)
def metric_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Shots and their mean quality for the match, each team and each player; no value below three shots."""
    shots = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = shots.select(F.col("o_custkey").alias("player"), F.col("c_nationkey").alias("team"), F.round(F.col("l_discount") * 100).cast("int").alias("quality"))
    sets = own.groupingSets([[], ["player"], ["team"]], "player", "team")
    scope = F.when(F.grouping("player") == 0, "player").when(F.grouping("team") == 0, "team").otherwise("match")
    enough = F.count("*") >= 3
    return sets.agg(scope.alias("scope"), F.count("*").alias("shots"), F.when(enough, _r(F.avg("quality"))).alias("quality"), F.when(enough, "available").otherwise("insufficient_sample").alias("status"))


@query("agg_09_coverage", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS eligible, count(*) FILTER (WHERE l_discount <= 0.05) AS ineligible, list_sort(list(DISTINCT l_linestatus)) AS keys FROM lineitem GROUP BY 1".replace("list_sort(list(DISTINCT l_linestatus))", "array_to_string(list_sort(list(DISTINCT l_linestatus)), ',')"))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("l_discount") > 0.05
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("ineligible"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("keys"))


@query("agg_13_fusion_diagnostics", f"SELECT user_id, count(*) AS samples, {', '.join(f'''count(*) FILTER (WHERE status = '{s}') AS {s}''' for s in ('dual_observed', 'single_view_fallback', 'conflict'))}, round(count(*) FILTER (WHERE status <> 'predicted') / count(*), 6) AS coverage FROM (SELECT *, {STATUS} AS status FROM events) GROUP BY 1")
def fusion_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = read(spark, sf, "events").withColumn("status", _status())
    return rows.groupBy("user_id").agg(F.count("*").alias("samples"), of("dual_observed"), of("single_view_fallback"), of("conflict"), _r(F.count_if(F.col("status") != "predicted") / F.count("*")).alias("coverage"))


@query("agg_22_shot_distance", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_discount * 100 AS y FROM lineitem), d AS (SELECT l_orderkey, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, round(sum(d), 3) AS distance FROM d GROUP BY 1")
def shot_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Null below two points."""
    w = W.partitionBy("l_orderkey").orderBy(*LINES)
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    d = F.hypot(x - F.lag("l_quantity").over(w), y - F.lag(F.col("l_discount") * 100).over(w))
    return read(spark, sf, "lineitem").select("l_orderkey", d.alias("d")).groupBy("l_orderkey").agg(_r(F.sum("d"), 3).alias("distance"))


@query(
    "agg_24_hit_attribution",
    """WITH s AS (SELECT event_id // 4 AS hit, event_id % 4 AS player, max((event_id * 31 % 100) / 100) AS a, max(CASE WHEN event_id % 3 > 0 THEN (event_id * 17 % 100) / 100 END) AS b FROM events GROUP BY ALL),
    t AS (SELECT hit, player, (0.35 * a + coalesce(0.25 * b, 0)) / (0.35 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END) AS score FROM s),
    r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS next FROM t WINDOW w AS (PARTITION BY hit ORDER BY score DESC, player))
    SELECT hit, player, round(score, 6) AS score, CASE WHEN score >= 0.6 AND score - next >= 0.2 THEN 'confirmed' WHEN score >= 0.6 THEN 'ambiguous' ELSE 'unassigned' END AS status FROM r WHERE k = 1""",
)
def hit_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The best player of a hit by the weighted mean of the evidence there is, and how far ahead of the next."""
    a, b = _e() * 31 % 100 / 100, F.when(_e() % 3 > 0, _e() * 17 % 100 / 100)
    seen = read(spark, sf, "events").groupBy(F.floor(_e() / 4).alias("hit"), (_e() % 4).alias("player")).agg(F.max(a).alias("a"), F.max(b).alias("b"))
    score = (0.35 * F.col("a") + F.coalesce(0.25 * F.col("b"), F.lit(0.0))) / (0.35 + F.when(F.col("b").isNull(), 0.0).otherwise(0.25))
    w = W.partitionBy("hit").orderBy(F.desc("score"), "player")
    ranked = seen.withColumn("score", score).withColumns({"k": F.row_number().over(w), "margin": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    status = F.when((F.col("score") >= 0.6) & (F.col("margin") >= 0.2), "confirmed").when(F.col("score") >= 0.6, "ambiguous").otherwise("unassigned")
    return ranked.filter("k = 1").select("hit", "player", _r("score").alias("score"), status.alias("status"))


@query("agg_31_ablation_report", "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS f, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1")
def ablation_report(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return table.select("l_returnflag", _r("F").alias("f"), _r("O").alias("o"))


NO_PLAY = "WITH t AS (SELECT user_id AS take, epoch_us(ts) // 1000 AS t_ms, event_id AS id, event_type = 'signup' AS opens FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"


@query(
    "win_04_effective_windows",
    NO_PLAY
    + """, n AS (SELECT *, coalesce(sum(CASE WHEN opens THEN 0 ELSE 1 END) OVER (PARTITION BY take ORDER BY t_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM t),
    s AS (SELECT take, min(t_ms) FILTER (WHERE opens) AS s, coalesce(max(t_ms) FILTER (WHERE NOT opens), 1706745600000) AS e FROM n GROUP BY take, turn),
    k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY take ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s WHERE s < e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY take ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM k)
    SELECT take, min(s) AS start, max(e) AS "end" FROM g GROUP BY take, island""",
)
def effective_windows(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "rally_start").when(F.col("event_type") == "purchase", "rally_end").when(F.col("event_type") == "error", "non_play_start")
    takes = _events(spark, sf).select(F.col("user_id").alias("take"), "t_ms", _e().alias("id"), kind.alias("kind")).filter("kind IS NOT NULL")
    return matches.effective_windows(takes, 1_706_745_600_000)


GAPS = "WITH p AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events)"


@query(
    "win_07_interpolation",
    GAPS
    + """, k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt, first_value(v IGNORE NULLS) OVER a AS nv FROM p
      WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN nt - pt > 0 AND nt - pt <= 86400000 THEN pv + (nv - pv) * (t - pt) / (nt - pt) END AS filled FROM k)
    SELECT event_id, round(filled, 6) AS filled, v IS NULL AND filled IS NOT NULL AS interpolated FROM f""",
)
def interpolation(spark: SparkSession, sf: str) -> DataFrame:
    points = _events(spark, sf).select("user_id", F.col("t_ms").alias("t"), "event_id", F.when(_e() % 3 > 0, F.col("value")).alias("value"))
    return matches.interpolated(points, "user_id", "t", 86_400_000).select("event_id", _r("filled").alias("filled"), "interpolated")


@query(
    "win_12_suppressed_hits",
    "WITH " + EV + """, h AS (SELECT * FROM ev WHERE event_type = 'click'), b AS (SELECT * FROM ev WHERE event_type = 'view' AND value / 500 >= 0.6)
    SELECT h.event_id AS id, min_by(b.event_id, (b.t_ms, b.event_id)) AS bounce_id FROM h LEFT JOIN b ON h.user_id = b.user_id AND h.t_ms - b.t_ms BETWEEN -25200000 AND 36000000 GROUP BY 1""",
)
def suppressed_hits(spark: SparkSession, sf: str) -> DataFrame:
    own = _events(spark, sf).select("user_id", "t_ms", _e().alias("id"), (F.col("value") / 500).alias("confidence"), "event_type")
    hits, bounces = own.filter("event_type = 'click'").drop("event_type"), own.filter("event_type = 'view'").drop("event_type")
    return matches.suppressed_hits(hits, bounces, "user_id", 25_200_000, 36_000_000, 0.6).select("id", "bounce_id")


STATES = "WITH w AS (SELECT user_id AS key, event_id * 10 AS c, (event_id * 31 % 1000) / 1000 AS p, (event_id * 13 % 1000) / 1000 AS q, (event_id * 17 % 1000) / 1000 >= 0.25 AS covered FROM events)"


@query(
    "win_15_play_states",
    STATES
    + """, l AS (SELECT *, coalesce(last_value(CASE WHEN NOT covered OR p < 0.55 THEN false WHEN p >= 0.75 THEN true END IGNORE NULLS) OVER (PARTITION BY key ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS latched, c - lag(c) OVER (PARTITION BY key ORDER BY c) AS step FROM w),
    b AS (SELECT *, coalesce(lag(latched) OVER (PARTITION BY key ORDER BY c), false) AS before, coalesce(min(step) FILTER (WHERE step > 0) OVER (PARTITION BY key), 500) AS least FROM l),
    s AS (SELECT *, CASE WHEN NOT covered THEN 'unknown' WHEN latched THEN 'rally_active' WHEN before OR greatest(p, q) >= 0.65 THEN 'non_play' ELSE 'unknown' END AS state FROM b),
    r AS (SELECT *, sum(CASE WHEN state = 'rally_active' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY c ROWS UNBOUNDED PRECEDING) AS run FROM s),
    z AS (SELECT key, run, max(c) - min(c) AS span FROM r WHERE state = 'rally_active' GROUP BY ALL)
    SELECT r.key, c AS center_ms, CASE WHEN state = 'rally_active' AND span + least < 500 THEN 'non_play' ELSE state END AS state FROM r LEFT JOIN z ON r.key = z.key AND r.run = z.run""",
)
def play_states(spark: SparkSession, sf: str) -> DataFrame:
    windows = read(spark, sf, "events").select(F.col("user_id").alias("key"), (_e() * 10).alias("center_ms"), (_e() * 31 % 1000 / 1000).alias("p"), (_e() * 13 % 1000 / 1000).alias("q"), (_e() * 17 % 1000 / 1000).alias("coverage"))
    return matches.play_states(windows, coverage=0.25)


@query("win_19_sequence_windows", "WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, i AS start, i + 3 AS \"end\" FROM n WHERE i % 2 = 0 AND i + 3 <= n")
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three rows, every two rows, that fit."""
    w = W.partitionBy("l_orderkey")
    i = (F.row_number().over(w.orderBy(*LINES)) - 1).cast("long")
    rows = read(spark, sf, "lineitem").select("l_orderkey", i.alias("start"), F.count("*").over(w).alias("n"))
    return rows.filter("start % 2 = 0 AND start + 3 <= n").select("l_orderkey", "start", (F.col("start") + 3).alias("end"))


@query("win_20_smoothing", "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM lineitem")
def smoothing(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy(*LINES).rowsBetween(-1, 1)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(F.avg("l_quantity").over(w)).alias("smooth"))


@query(
    "win_21_side_alternation",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 AS side, l_discount >= 0.06 AS strong, lag(l_suppkey % 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem WHERE l_linestatus = 'F')
    SELECT l_orderkey, l_linenumber, CASE WHEN side IS DISTINCT FROM before THEN 'confirmed' WHEN strong THEN 'violation' ELSE 'ambiguous' END AS status FROM c""",
)
def side_alternation(spark: SparkSession, sf: str) -> DataFrame:
    """Two confirmed shots in a row from one side: kept with a note if the evidence is strong, or else ambiguous."""
    confirmed = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").withColumn("side", F.col("l_suppkey") % 2)
    before = F.lag("side").over(W.partitionBy("l_orderkey").orderBy(*LINES))
    same = confirmed.withColumn("same", F.coalesce(F.col("side") == before, F.lit(False)))
    return same.select("l_orderkey", "l_linenumber", F.when(~F.col("same"), "confirmed").when(F.col("l_discount") >= 0.06, "violation").otherwise("ambiguous").alias("status"))


@query(
    "win_22_shot_owners",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey AS id, l_partkey % 3 = 0 AS opens, coalesce(lag(l_suppkey % 4 = 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), false) AS closed FROM lineitem),
    m AS (SELECT *, last_value(CASE WHEN opens THEN id WHEN closed THEN -1 END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shot FROM s)
    SELECT id AS segment_id, CASE WHEN shot >= 0 THEN shot END AS shot_id FROM m""",
)
def shot_owners(spark: SparkSession, sf: str) -> DataFrame:
    segments = read(spark, sf, "lineitem").select("l_orderkey", *LINES, (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("segment_id"), F.when(F.col("l_partkey") % 3 == 0, "hit").otherwise("bounce").alias("start_event"), F.when(F.col("l_suppkey") % 4 == 0, "loss").otherwise("hit").alias("end_event"))
    return matches.shot_owners(segments, "l_orderkey", LINES).select("segment_id", "shot_id")


@query("win_27_trace_windows", "WITH " + EV + ", w AS (SELECT user_id, greatest(t_ms - 60000, 1704067200000) AS start, t_ms + 90000 AS \"end\", t_ms FROM ev WHERE event_type = 'error') SELECT user_id, start, \"end\", row_number() OVER (PARTITION BY user_id ORDER BY abs(t_ms - 1705300000000), t_ms) AS place FROM w")
def trace_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows around errors, clipped at the beginning, numbered from the middle outwards."""
    w = W.partitionBy("user_id").orderBy(F.abs(F.col("t_ms") - 1_705_300_000_000), "t_ms")
    errors = _events(spark, sf).filter("event_type = 'error'")
    return errors.select("user_id", F.greatest(F.col("t_ms") - 60_000, F.lit(1_704_067_200_000)).alias("start"), (F.col("t_ms") + 90_000).alias("end"), F.row_number().over(w).cast("long").alias("place"))
