"""Registered queries of the tracking domain: name -> (query, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court, vision
from courtlight.operators import intervals, metrics, tracks
from courtlight.sources import adapters
from courtlight.sources.adapters import TIMELINE_SQL, TRACK_POINTS_SQL, read, track_points
from courtlight.streaming.counts import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

POINTS = "WITH " + TRACK_POINTS_SQL
STEPS = POINTS + """, steps AS (SELECT *, sqrt(power(x_ft - lag(x_ft) OVER w, 2) + power(y_ft - lag(y_ft) OVER w, 2)) AS step_ft,
  t_ms - lag(t_ms) OVER w AS step_ms FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY t_ms, frame_index))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _xy() -> tuple[Column, Column]:
    return F.col("x_ft"), F.col("y_ft")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@query("agg_01_path_length", STEPS + " SELECT track_id, count(*) AS n_points, round(coalesce(sum(step_ft), 0), 6) AS distance_ft FROM steps GROUP BY track_id")
def _(spark, sf):
    return tracks.path_length(track_points(spark, sf)).select("track_id", "n_points", _r("distance_ft").alias("distance_ft"))


@query("agg_02_speed_summary", STEPS + " SELECT track_id, count(v) AS segments, round(coalesce(avg(v), 0), 6) AS avg_fps, round(coalesce(max(v), 0), 6) AS max_fps FROM (SELECT *, CASE WHEN step_ms > 0 THEN step_ft / (step_ms / 1000) END AS v FROM steps) GROUP BY track_id")
def _(spark, sf):
    return tracks.speeds(track_points(spark, sf)).select("track_id", "segments", _r("avg_fps").alias("avg_fps"), _r("max_fps").alias("max_fps"))


@query("agg_03_kitchen_dwell", POINTS + " SELECT track_id, count(*) FILTER (WHERE k) AS frames, CAST(coalesce(sum(s) FILTER (WHERE k), 0) AS BIGINT) AS dwell_ms FROM (SELECT track_id, x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 15 AND 29 AS k, greatest(0, coalesce(lead(t_ms) OVER (PARTITION BY track_id ORDER BY t_ms, frame_index) - t_ms, 0)) AS s FROM track_points) GROUP BY track_id")
def _(spark, sf):
    return tracks.kitchen_dwell(track_points(spark, sf))


@query("agg_05_own_side", POINTS + " SELECT track_id, m AS median_y, CASE WHEN m < 22 THEN 'near' WHEN m > 22 THEN 'far' END AS side FROM (SELECT track_id, list_sort(list(y_ft))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS m FROM track_points GROUP BY track_id)")
def _(spark, sf):
    return tracks.own_side(track_points(spark, sf))


@query("agg_07_heatmap", POINTS + " SELECT CAST(least(10, floor(y_ft / 44 * 11)) AS INT) AS row, CAST(least(4, floor(x_ft / 20 * 5)) AS INT) AS \"column\", count(*) AS n FROM track_points WHERE x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 0 AND 44 GROUP BY ALL")
def _(spark, sf):
    return tracks.heatmap(track_points(spark, sf))


@query("jon_01_agg_06_spacing", POINTS + """, p AS (SELECT user_id % 4 AS player, e.event_id // 4 AS frame, x_ft, y_ft, e.event_id AS id FROM track_points t JOIN events e ON t.frame_index = e.event_id),
 l AS (SELECT player, frame, max_by(x_ft, id) AS x, max_by(y_ft, id) AS y FROM p GROUP BY ALL)
 SELECT a.player AS left_player, b.player AS right_player, count(*) AS samples, round(avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 6) AS avg_ft, round(min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 6) AS min_ft, round(max(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 6) AS max_ft
 FROM l a JOIN l b ON a.frame = b.frame AND a.player < b.player GROUP BY ALL""")
def _(spark, sf):
    """Four players; a frame is four events, so pairs of a frame are at most six."""
    frames = track_points(spark, sf).withColumns({"player": F.col("track_id") % 4, "frame": F.floor(F.col("frame_index") / 4)})
    last = frames.groupBy("player", "frame").agg(F.max_by("x_ft", "frame_index").alias("x"), F.max_by("y_ft", "frame_index").alias("y"))
    other = last.select(F.col("player").alias("right_player"), F.col("frame").alias("f2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = last.join(other, (F.col("frame") == F.col("f2")) & (F.col("player") < F.col("right_player")))
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    return pairs.groupBy(F.col("player").alias("left_player"), "right_player").agg(F.count("*").alias("samples"), _r(F.avg(d)).alias("avg_ft"), _r(F.min(d)).alias("min_ft"), _r(F.max(d)).alias("max_ft"))


@query("agg_10_landing_summary", POINTS + """, c AS (SELECT CASE WHEN x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 0 AND 44 THEN least(x_ft, 20 - x_ft, y_ft, 44 - y_ft) ELSE -sqrt(power(greatest(-x_ft, x_ft - 20, 0), 2) + power(greatest(-y_ft, y_ft - 44, 0), 2)) END AS d FROM track_points)
 SELECT CASE WHEN abs(d) <= 0.1 THEN 'unknown' WHEN d > 0 THEN 'in' ELSE 'out' END AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS ratio FROM c GROUP BY 1""")
def _(spark, sf):
    found = track_points(spark, sf).groupBy(court.landing_call(*_xy()).alias("status")).agg(F.count("*").alias("n"))
    # three rows at most
    return found.withColumn("ratio", _r(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 4))


@query("agg_14_confusion_f1", """WITH s AS (SELECT CASE WHEN event_id * 31 % 1000 >= 500 THEN 'active' WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'non_play' END AS t, CASE WHEN event_id * 17 % 1000 >= 450 THEN 'active' ELSE 'non_play' END AS p FROM events),
 c AS (SELECT class, count(*) FILTER (WHERE t = class AND p = class) AS tp, count(*) FILTER (WHERE t <> class AND p = class) AS fp, count(*) FILTER (WHERE t = class AND p <> class) AS fn FROM (VALUES ('active'), ('non_play'), ('unknown')) AS k(class) CROSS JOIN s GROUP BY class)
 SELECT class, tp, fp, fn, round(2 * tp / greatest(2 * tp + fp + fn, 1e-9), 6) AS f1, round(avg(2 * tp / greatest(2 * tp + fp + fn, 1e-9)) OVER (), 6) AS macro_f1 FROM c""")
def _(spark, sf):
    e = F.col("event_id")
    states = read(spark, sf, "events").select(F.when(e * 31 % 1000 >= 500, "active").when(e % 7 == 0, "unknown").otherwise("non_play").alias("truth"), F.when(e * 17 % 1000 >= 450, "active").otherwise("non_play").alias("predicted"))
    return metrics.macro_f1(states, "truth", "predicted", ["active", "non_play", "unknown"]).withColumns({"f1": _r("f1"), "macro_f1": _r("macro_f1")})


@query("agg_16_clock_fit", "WITH p AS (SELECT user_id, event_id AS a, event_id * 1.0005 + 20 + event_id % 3 AS b FROM events), s AS (SELECT user_id, count(*) AS n, sum(CAST(a AS DOUBLE)) AS sa, sum(CAST(b AS DOUBLE)) AS sb, sum(CAST(a AS DOUBLE) * a) AS saa, sum(CAST(a AS DOUBLE) * b) AS sab FROM p GROUP BY 1), r AS (SELECT *, CASE WHEN n * saa - sa * sa = 0 THEN 1.0 ELSE (n * sab - sa * sb) / (n * saa - sa * sa) END AS rate FROM s) SELECT user_id, n, round(rate, 6) AS rate, round((sb - rate * sa) / n, 3) AS \"offset\", round((rate - 1) * 1e6, 1) AS drift_ppm FROM r")
def _(spark, sf):
    e = F.col("event_id").cast("double")
    pairs = read(spark, sf, "events").select("user_id", e.alias("a"), (e * 1.0005 + 20 + F.col("event_id") % 3).alias("b"))
    return metrics.clock_fit(pairs, "user_id").select("user_id", "n", _r("rate").alias("rate"), _r("offset", 3).alias("offset"), _r("drift_ppm", 1).alias("drift_ppm"))


@query("agg_17_nearest_rank", "SELECT event_type, list_sort(list(value))[greatest(1, CAST(ceil(count(*) * 0.95) AS BIGINT))] AS percentile FROM events GROUP BY 1")
def _(spark, sf):
    return metrics.nearest_rank(read(spark, sf, "events"), "event_type", "value", 0.95)


@query("agg_18_robust_threshold", "SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad, round(greatest(25.0, median(value) + 6 * greatest(mad(value), 1)), 6) AS threshold FROM events GROUP BY 1")
def _(spark, sf):
    return metrics.robust_threshold(read(spark, sf, "events"), "event_type", "value", 25.0).select("event_type", _r("median").alias("median"), _r("mad").alias("mad"), _r("threshold").alias("threshold"))


SPANS = "i AS (SELECT o_custkey AS key, epoch_ms(o_orderdate) // 86400000 AS s, epoch_ms(o_orderdate) // 86400000 + o_orderkey % 90 AS e FROM orders)"
ISLANDS = "WITH " + SPANS + ", n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i WHERE e > s), g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n), m AS (SELECT key, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    day = F.expr("CAST(floor(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) / 86400000) AS BIGINT)")
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), day.alias("start"), (day + F.col("o_orderkey") % 90).alias("end"))


@query("win_06_interval_merge", ISLANDS + ' SELECT key, s AS start, e AS "end" FROM m')
def _(spark, sf):
    return intervals.merged(_spans(spark, sf), "key")


@query("agg_19_interval_union", ISLANDS + " SELECT key, CAST(sum(e - s) AS BIGINT) AS covered, count(*) AS islands FROM m GROUP BY key")
def _(spark, sf):
    return intervals.union_length(_spans(spark, sf), "key")


@query("win_01_consecutive_difference", STEPS + " SELECT track_id, frame_index, step_ms, round(step_ft, 6) AS step_ft FROM steps WHERE step_ms IS NOT NULL")
def _(spark, sf):
    return tracks.steps(track_points(spark, sf)).filter("step_ms IS NOT NULL").select("track_id", "frame_index", "step_ms", _r("step_ft").alias("step_ft"))


@query("win_02_shot_ordinal", "SELECT l_orderkey, l_linenumber, CASE o WHEN 1 THEN 'serve' WHEN 2 THEN 'return' WHEN 3 THEN 'third' ELSE 'rally_shot' END AS stage FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS o FROM lineitem)")
def _(spark, sf):
    o = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return read(spark, sf, "lineitem").withColumn("o", o).select("l_orderkey", "l_linenumber", F.when(F.col("o") == 1, "serve").when(F.col("o") == 2, "return").when(F.col("o") == 3, "third").otherwise("rally_shot").alias("stage"))


@query("win_03_latest_revision", "SELECT o_custkey, max(o_orderkey) AS revision, max_by(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(spark, sf):
    effective = read(spark, sf, "orders").filter("o_orderstatus <> 'F'")
    return effective.groupBy("o_custkey").agg(F.max("o_orderkey").alias("revision"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


PAIRED = "WITH " + TIMELINE_SQL + ", n AS (SELECT *, coalesce(sum(CASE kind WHEN 'rally_end' THEN 1 ELSE 0 END) OVER (PARTITION BY take ORDER BY t_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM timeline), pairs AS (SELECT take, min(t_ms) FILTER (WHERE kind = 'rally_start') AS start_ms, max(t_ms) FILTER (WHERE kind = 'rally_end') AS end_ms FROM n GROUP BY take, turn)"


@query("win_04_rally_pairing", PAIRED + " SELECT * FROM pairs WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL")
def _(spark, sf):
    return intervals.paired(adapters.timeline(spark, sf))


@query("win_05_gaps_islands", STEPS + ", g AS (SELECT *, sum(CASE WHEN step_ms > 43200000 OR step_ft > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_ms, frame_index) AS segment FROM steps) SELECT track_id, CAST(segment AS BIGINT) AS segment, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS n_points FROM g GROUP BY ALL")
def _(spark, sf):
    return tracks.segments(track_points(spark, sf), 43_200_000, 40.0)


@query("win_08_spike_removal", POINTS + ", n AS (SELECT *, lag(x_ft) OVER w AS px, lag(y_ft) OVER w AS py, lead(x_ft) OVER w AS nx, lead(y_ft) OVER w AS ny FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY t_ms, frame_index)) SELECT track_id, frame_index FROM n WHERE sqrt((x_ft-px)*(x_ft-px)+(y_ft-py)*(y_ft-py)) > 15.005 AND sqrt((x_ft-nx)*(x_ft-nx)+(y_ft-ny)*(y_ft-ny)) > 15.005 AND sqrt((px-nx)*(px-nx)+(py-ny)*(py-ny)) < 15.005")
def _(spark, sf):
    return tracks.spikes(track_points(spark, sf), 15.005)


@query("win_13_ewma", POINTS + """, o AS (SELECT track_id, t_ms, x_ft, y_ft, row_number() OVER w AS i, lag(x_ft) OVER w AS px, lag(y_ft) OVER w AS py, lag(t_ms) OVER w AS pt FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY t_ms, frame_index)),
 h AS (SELECT *, coalesce(sqrt((x_ft-px)*(x_ft-px)+(y_ft-py)*(y_ft-py)) > greatest(t_ms - pt, 0) / 1000 * 0.0005, false) AS held FROM o),
 r AS (SELECT track_id, list(struct_pack(x := x_ft, y := y_ft, h := held) ORDER BY i) AS l FROM h GROUP BY 1),
 f AS (SELECT track_id, len(l) AS n, list_reduce(l, lambda a, b: struct_pack(x := CASE WHEN b.h THEN a.x ELSE 0.45 * b.x + (1 - 0.45) * a.x END, y := CASE WHEN b.h THEN a.y ELSE 0.45 * b.y + (1 - 0.45) * a.y END, h := b.h)) AS s, len(list_filter(l, lambda q: q.h)) AS held FROM r)
 SELECT track_id, CAST(n AS INT) AS n, round(s.x, 6) AS x_smooth, round(s.y, 6) AS y_smooth, CAST(held AS INT) AS held FROM f""")
def _(spark, sf):
    return tracks.ewma(track_points(spark, sf), 0.45, 0.0005).select("track_id", "n", _r("x_smooth").alias("x_smooth"), _r("y_smooth").alias("y_smooth"), "held")


@query("win_17_side_flip", "SELECT take, id, CASE WHEN sum(CASE kind WHEN 'rally_end' THEN 1 ELSE 0 END) OVER (PARTITION BY take ORDER BY t_ms, id) % 2 = 0 THEN 'near' ELSE 'far' END AS side FROM (WITH " + TIMELINE_SQL + " SELECT * FROM timeline)")
def _(spark, sf):
    flips = F.sum(F.when(F.col("kind") == "rally_end", 1).otherwise(0)).over(W.partitionBy("take").orderBy("t_ms", "id"))
    return adapters.timeline(spark, sf).select("take", "id", F.when(flips % 2 == 0, "near").otherwise("far").alias("side"))


CLICKS = "c AS (SELECT user_id, epoch_us(ts) // 1000 AS t_ms, event_id FROM events WHERE event_type = 'click'), v AS (SELECT user_id, epoch_us(ts) // 1000 AS t_ms, event_id FROM events WHERE event_type = 'view')"


def _two_views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = track_points(spark, sf).select(F.col("track_id").alias("user_id"), "t_ms", F.col("frame_index").alias("event_id"), "event_type")
    return own.filter("event_type = 'click'").drop("event_type"), own.filter("event_type = 'view'").drop("event_type")


@query("jon_02_nearest_asof", "WITH " + CLICKS + """, b AS (SELECT c.*, v.t_ms AS bt, v.event_id AS bv FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t_ms >= v.t_ms),
 n AS (SELECT b.*, v.t_ms AS ft, v.event_id AS fv FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t_ms <= v.t_ms),
 m AS (SELECT *, bt IS NOT NULL AND (ft IS NULL OR t_ms - bt <= ft - t_ms) AS back FROM n),
 d AS (SELECT *, CASE WHEN back THEN t_ms - bt ELSE ft - t_ms END AS delta, CASE WHEN back THEN bv ELSE fv END AS near FROM m)
 SELECT user_id, t_ms, event_id, CASE WHEN delta <= 14400000 THEN near END AS match, CASE WHEN delta <= 14400000 THEN delta END AS delta_ms, CASE WHEN delta <= 14400000 THEN 'ok' ELSE 'unavailable' END AS status FROM d""")
def _(spark, sf):
    left, right = _two_views(spark, sf)
    return intervals.nearest(left, right, "user_id", "t_ms", "event_id", 14_400_000)


@query("jon_03_at_or_after", "WITH " + CLICKS + " SELECT c.*, v.t_ms AS right_t, v.event_id AS right_v FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t_ms <= v.t_ms")
def _(spark, sf):
    return intervals.asof(*_two_views(spark, sf), "user_id", "t_ms", "event_id", forward=True)


@query("jon_10_asof_backward", "WITH " + CLICKS + " SELECT c.*, v.t_ms AS right_t, v.event_id AS right_v FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t_ms >= v.t_ms")
def _(spark, sf):
    return intervals.asof(*_two_views(spark, sf), "user_id", "t_ms", "event_id")


@query("jon_07_point_in_interval", PAIRED + ", p AS (SELECT user_id % 4 AS take, event_id, epoch_us(ts) // 1000 AS t_ms FROM events) SELECT p.take, event_id, t_ms, start_ms AS start, end_ms AS \"end\" FROM p JOIN pairs ON p.take = pairs.take AND t_ms >= start_ms AND t_ms < end_ms")
def _(spark, sf):
    rallies = intervals.paired(adapters.timeline(spark, sf)).withColumnsRenamed({"start_ms": "start", "end_ms": "end"})
    points = track_points(spark, sf).select((F.col("track_id") % 4).alias("take"), F.col("frame_index").alias("event_id"), "t_ms")
    return intervals.containing(points, rallies, "take", 3_600_000)


@query("jon_19_missing_keys", "SELECT DISTINCT o_custkey FROM (SELECT o_custkey * 2 AS o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    referenced = read(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("o_custkey")).distinct()
    return referenced.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("prj_03_orientation", POINTS + ", o AS (SELECT *, CASE track_id % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'rotate_180' WHEN 2 THEN 'mirror_x' ELSE 'mirror_y' END AS how FROM track_points) SELECT frame_index, how, round(CASE WHEN how IN ('rotate_180', 'mirror_x') THEN 20 - x_ft ELSE x_ft END, 6) AS x, round(CASE WHEN how IN ('rotate_180', 'mirror_y') THEN 44 - y_ft ELSE y_ft END, 6) AS y FROM o")
def _(spark, sf):
    m = F.col("track_id") % 4
    how = F.when(m == 0, "identity").when(m == 1, "rotate_180").when(m == 2, "mirror_x").otherwise("mirror_y")
    seen = track_points(spark, sf).withColumn("how", how).withColumn("p", court.oriented(*_xy(), F.col("how")))
    return seen.select("frame_index", "how", _r("p.x").alias("x"), _r("p.y").alias("y"))


@query("prj_04_units", POINTS + " SELECT frame_index, round(x_ft * 0.3048, 6) AS x_m, round(y_ft * 0.3048, 6) AS y_m FROM track_points")
def _(spark, sf):
    return track_points(spark, sf).select("frame_index", _r(F.col("x_ft") * court.METRES).alias("x_m"), _r(F.col("y_ft") * court.METRES).alias("y_m"))


@query("prj_05_bounds", POINTS + " SELECT track_id, frame_index FROM track_points WHERE x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 0 AND 44")
def _(spark, sf):
    return track_points(spark, sf).filter(court.in_bounds(*_xy())).select("track_id", "frame_index")


@query("prj_06_visibility", POINTS + " SELECT CASE WHEN x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 0 AND 44 THEN 'inside' WHEN x_ft BETWEEN -4 AND 24 AND y_ft BETWEEN -8 AND 52 THEN 'visible_outside' ELSE 'dropped' END AS seen, count(*) AS n FROM track_points GROUP BY 1")
def _(spark, sf):
    return track_points(spark, sf).groupBy(court.visibility(*_xy()).alias("seen")).agg(F.count("*").alias("n"))


@query("prj_08_bands", POINTS + " SELECT CASE WHEN y_ft BETWEEN 15 AND 29 THEN 'kitchen' WHEN y_ft BETWEEN 7 AND 37 THEN 'transition' WHEN y_ft BETWEEN 0 AND 44 THEN 'backcourt' END AS band, count(*) AS n FROM track_points GROUP BY 1")
def _(spark, sf):
    return track_points(spark, sf).groupBy(court.band(F.col("y_ft")).alias("band")).agg(F.count("*").alias("n"))


@query("prj_09_zones", POINTS + " SELECT frame_index, CASE WHEN x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 0 AND 44 THEN CAST((CASE WHEN abs(y_ft - 22) < 7 THEN 0 WHEN abs(y_ft - 22) < 12 THEN 1 WHEN abs(y_ft - 22) < 17 THEN 2 ELSE 3 END) * 3 + least(2, floor(x_ft / (20.0 / 3))) + 1 AS INT) END AS zone FROM track_points")
def _(spark, sf):
    return track_points(spark, sf).select("frame_index", court.zone_12(*_xy()).alias("zone"))


@query("prj_18_identity", "SELECT c_name, CASE WHEN c_custkey % 3 = 0 THEN 'P' || c_custkey ELSE c_name END AS player FROM customer")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Player_"), k)).otherwise(F.col("c_name"))
    return read(spark, sf, "customer").select("c_name", court.player_key(said).alias("player"))


@query("prj_21_chi_square", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1) AS h FROM embeddings), p AS (SELECT a.vec_id, a.h AS a, b.h AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(least(1.0, list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i]) / (a[i] + b[i] + 1e-6))) / 2 / len(a) * 8), 6) AS distance FROM p")
def chi_square_of_neighbours(spark, sf):
    own = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 1).alias("h"))
    other = own.select((F.col("vec_id") - 1).alias("before"), F.col("h").alias("h2"))
    return own.join(other, F.col("vec_id") == F.col("before")).select("vec_id", _r(vision.chi_square(F.col("h"), F.col("h2"))).alias("distance"))


@query("prj_24_mid_rank", "WITH t AS (SELECT l_returnflag, l_quantity, count(*) AS equal FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_quantity, equal, round((coalesce(sum(equal) OVER (PARTITION BY l_returnflag ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + equal / 2) / sum(equal) OVER (PARTITION BY l_returnflag), 6) AS utility FROM t")
def _(spark, sf):
    return metrics.mid_rank(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity").withColumn("utility", _r("utility"))


@query("prj_26_stable_hash", "SELECT event_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS digest FROM events")
def _(spark, sf):
    row = F.to_json(F.struct("event_id", "event_type", "user_id"))
    return read(spark, sf, "events").select("event_id", F.sha2(row.cast("binary"), 256).alias("digest"))


@query("prj_27_redaction", "SELECT page_id, left(regexp_replace(url, '[0-9]+', '#', 'g'), 40) AS url FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.left(F.regexp_replace("url", "[0-9]+", "#"), F.lit(40)).alias("url"))


@query("src_03_timing_check", "SELECT count(*) AS n, count(*) FILTER (WHERE d <= 0) AS violations, min(t) AS first_ms, max(t) AS last_ms, round((count(*) - 1) / ((max(t) - min(t)) / 1000), 9) AS fps FROM (SELECT epoch_us(ts) // 1000 AS t, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)")
def _(spark, sf):
    """Times must rise with the frame numbers of each camera."""
    d = F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("track_id").orderBy("frame_index"))
    t = track_points(spark, sf).withColumn("d", d)
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("d") <= 0).alias("violations"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), _r((F.count("*") - 1) / ((F.max("t_ms") - F.min("t_ms")) / 1000), 9).alias("fps"))


@query("src_04_filtered_scan", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id BETWEEN 10 AND 60 AND value >= 100")
def _(spark, sf):
    return read(spark, sf, "events").filter(F.col("event_type").isin("click", "error") & F.col("user_id").between(10, 60) & (F.col("value") >= 100)).select("event_id", "user_id", "event_type")


@query("src_05_offset_limit", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(spark, sf):
    """A page of the session list: the limit is the feature."""
    return read(spark, sf, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus").offset(40).limit(20)


@query("src_06_queue_head", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("str_13_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    found = windowed_counts(read(spark, sf, "events"))
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": _r("total", 4)})


from courtlight.plans import matches as _matches  # noqa: E402, F401  registers its queries here
from courtlight.plans import records as _records  # noqa: E402, F401
from courtlight.plans import evidence as _evidence  # noqa: E402, F401
from courtlight.plans import cameras as _cameras  # noqa: E402, F401
from courtlight.plans import ledgers as _ledgers  # noqa: E402, F401
from courtlight.plans import segments as _segments  # noqa: E402, F401
from courtlight.plans import bounces as _bounces  # noqa: E402, F401
from courtlight.plans import observability as _observability  # noqa: E402, F401
from courtlight.plans import insights as _insights  # noqa: E402, F401
from courtlight.plans import snapshots as _snapshots  # noqa: E402, F401
from courtlight.plans import zones as _zones  # noqa: E402, F401
