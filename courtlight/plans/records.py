"""Registered queries of records: sorts, sets, values, editing, reports, state over time, files: name -> (query, DuckDB SQL)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlight.functions import court
from courtlight.operators.evidence import finite
from courtlight.plans.registry import CLICKS, POINTS, _r, _two_views, query
from courtlight.sources.adapters import MS, read, track_points, view
from courtlight.sources.folders import new_folder


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("t_ms", F.expr(MS))


EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS t_ms FROM events)"
RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


@query("srt_01_deterministic_sort", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END, o_totalprice DESC, o_orderkey) AS place FROM orders")
def deterministic_sort(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.lit(5)
    for name, at in RANK.items():
        rank = F.when(F.col("o_orderpriority") == name, at).otherwise(rank)
    w = W.partitionBy("o_custkey").orderBy(rank, F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("srt_02_best_with_margin", "WITH r AS (SELECT l_orderkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS k FROM lineitem) SELECT l_orderkey, max(p) AS best, round(max(p) - max(p) FILTER (WHERE k = 2), 2) AS margin FROM r WHERE k <= 2 GROUP BY 1")
def best_with_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The best and how far it is ahead of the second; null where there is none."""
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice")))
    top = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("p"), k.alias("k")).filter("k <= 2")
    return top.groupBy("l_orderkey").agg(F.max("p").alias("best"), _r(F.max("p") - F.max(F.when(F.col("k") == 2, F.col("p"))), 2).alias("margin"))


@query("srt_04_primary_players", "WITH s AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS score FROM events GROUP BY ALL) SELECT event_type, user_id, score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) AS k FROM s) WHERE k <= 4")
def primary_players(spark: SparkSession, sf: str) -> DataFrame:
    """The four players of the highest score of each kind: the limit is the feature."""
    s = read(spark, sf, "events").groupBy("user_id", "event_type").agg(_r(F.sum("value"), 2).alias("score"))
    k = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("score"), "user_id"))
    return s.withColumn("k", k).filter("k <= 4").select("event_type", "user_id", "score")


@query("set_01_union_of_evidence", "SELECT event_id, 'bounce' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT h.event_id, 'hit' FROM events h WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = h.user_id AND b.event_id // 100 = h.event_id // 100)")
def union_of_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Base events, and those of a second source that no base event of the same player and time slot covers."""
    keyed = read(spark, sf, "events").withColumn("slot", F.floor(F.col("event_id") / 100))
    base = keyed.filter("event_type = 'view'")
    more = keyed.filter("event_type = 'click'").join(base, ["user_id", "slot"], "left_anti")
    return base.select("event_id", F.lit("bounce").alias("kind")).unionByName(more.select("event_id", F.lit("hit").alias("kind")))


@query("set_02_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def difference(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order."""
    return read(spark, sf, "customer").select("c_custkey").subtract(read(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey"))


@query("set_03_distinct_sorted_ids", "SELECT c_custkey, coalesce(string_agg(DISTINCT CAST(o_orderkey % 7 AS VARCHAR), ',' ORDER BY CAST(o_orderkey % 7 AS VARCHAR)), 'none') AS ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def distinct_sorted_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set((F.col("o_orderkey") % 7).cast("string"))).alias("ids"))
    joined = read(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.array_join("ids", ","), F.lit("none")).alias("ids"))


@query(
    "set_04_precedence_merge",
    """WITH o AS (SELECT event_id // 2 AS k, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_id // 2 AS k, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.k, r.k) AS k, CASE WHEN o.v >= 200 OR r.v IS NULL THEN o.v ELSE r.v END AS v, CASE WHEN o.v IS NULL THEN 'recovered' WHEN o.v >= 200 THEN 'original' WHEN r.v IS NULL THEN 'weak_original' ELSE 'replaced' END AS reason FROM o FULL JOIN r ON o.k = r.k""",
)
def precedence_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A strong original stays, a weak one gives way to what was recovered."""
    own = read(spark, sf, "events").withColumn("k", F.floor(F.col("event_id") / 2))
    best = lambda side, name: own.filter(F.col("event_id") % 2 == side).groupBy("k").agg(F.max("value").alias(name))
    both = best(0, "o").join(best(1, "r"), "k", "full")
    o, r = F.col("o"), F.col("r")
    reason = F.when(o.isNull(), "recovered").when(o >= 200, "original").when(r.isNull(), "weak_original").otherwise("replaced")
    return both.select("k", F.when((o >= 200) | r.isNull(), o).otherwise(r).alias("v"), reason.alias("reason"))


@query("set_05_upsert", "SELECT coalesce(n.k, c_custkey) AS k, CASE WHEN n.k IS NULL THEN c_acctbal ELSE n.total END AS balance FROM customer FULL JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON n.k = c_custkey")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the update replace those of their key; keys on either side only stay or are inserted."""
    new = read(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(_r(F.sum("o_totalprice"), 2).alias("total"))
    joined = read(spark, sf, "customer").join(new, F.col("c_custkey") == F.col("k"), "full")
    return joined.select(F.coalesce("k", "c_custkey").alias("k"), F.when(F.col("k").isNull(), F.col("c_acctbal")).otherwise(F.col("total")).alias("balance"))


@query("fun_01_geometry", POINTS + " SELECT frame_index, round(sqrt(x_ft * x_ft + y_ft * y_ft), 6) AS far, round(degrees(atan2(y_ft, x_ft + 5)), 6) AS angle, round(greatest(0, least(1, x_ft / 20)), 6) AS share FROM track_points")
def geometry(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x_ft"), F.col("y_ft")
    return track_points(spark, sf).select("frame_index", _r(F.hypot(x, y)).alias("far"), _r(F.degrees(F.atan2(y, x + 5))).alias("angle"), _r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 20))).alias("share"))


SAID = """CASE event_id % 8 WHEN 0 THEN 'nan' WHEN 1 THEN 'x' WHEN 2 THEN 'Infinity' WHEN 3 THEN '1e30' WHEN 4 THEN '' WHEN 5 THEN CAST(-event_id AS VARCHAR(20)) WHEN 6 THEN CAST(event_id AS VARCHAR(20)) END"""


@query(
    "fun_03_finite_values",
    f"""WITH t AS (SELECT event_id, try_cast({SAID} AS DOUBLE) AS v FROM events)
SELECT event_id, CASE WHEN isfinite(v) AND v >= 0 AND v < 9e15 THEN CAST(round(v * 1000) AS BIGINT) END AS ms FROM t""",
)
def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds as text to milliseconds: no number, not finite, negative or beyond a long gives null."""
    said = view(spark, sf, f"SELECT event_id, {SAID.replace('VARCHAR(20)', 'STRING')} AS s FROM {{events}}")
    v = finite(F.col("s"))
    return said.select("event_id", F.when((v >= 0) & (v < 9e15), F.round(v * 1000).cast("long")).alias("ms"))


@query("fun_04_time_deltas", "SELECT o_orderkey, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS days, epoch_ms(o_orderdate + INTERVAL 90 MINUTE) AS until_ms FROM orders")
def time_deltas(spark: SparkSession, sf: str) -> DataFrame:
    ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate + INTERVAL 90 MINUTES)"
    return read(spark, sf, "orders").select("o_orderkey", F.expr("datediff(o_orderdate, DATE'1990-01-01')").cast("long").alias("days"), F.expr(ms).alias("until_ms"))


@query("fun_05_json_payload", "SELECT event_id, CAST(try_cast(json_extract_string(CASE WHEN event_id % 5 = 0 THEN '{\"broken\"' ELSE props END, '$.k') AS BIGINT) AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def json_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A field of a payload; broken JSON counts as an empty object."""
    said = F.when(F.col("event_id") % 5 == 0, '{"broken"').otherwise(F.col("props"))
    return read(spark, sf, "events").select("event_id", F.get_json_object(said, "$.k").try_cast("long").alias("k"))


@query("fun_06_array_ops", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10) AS INT)) AS a FROM embeddings) SELECT vec_id, len(list_distinct(a)) AS kinds, list_max(a) AS most, CAST(list_sum(list_filter(a, lambda x: x > 0)) AS BIGINT) AS up FROM v")
def array_ops(spark: SparkSession, sf: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.round(x.cast("double") * 10).cast("int"))
    v = read(spark, sf, "embeddings").select("vec_id", a.alias("a"))
    up = F.aggregate(F.filter("a", lambda x: x > 0), F.lit(0).cast("long"), lambda s, x: s + x)
    return v.select("vec_id", F.size(F.array_distinct("a")).cast("long").alias("kinds"), F.array_max("a").alias("most"), F.when(F.exists("a", lambda x: x > 0), up).alias("up"))


@query("fun_07_map_ops", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS counts, coalesce(max(n) FILTER (WHERE event_type = 'click'), 0) AS clicks FROM c GROUP BY 1")
def map_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by kind as a map, sorted on output."""
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ";")
    return m.select("user_id", shown.alias("counts"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"))


@query("fun_08_frame_conversion", "WITH f AS (SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 25.0 END, CASE WHEN event_id % 2 = 0 THEN 60.0 END, 30.0) AS fps, (event_id % 100) / 8 AS s FROM events) SELECT event_id, fps, CAST(greatest(1, round(s * fps)) AS BIGINT) AS frames, greatest(0, CAST(s * 1000 AS BIGINT) - 1500) AS from_ms FROM f")
def frame_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """The user's rate, or the file's, or 30; at least one frame; a clip's start widened and clamped."""
    e = F.col("event_id")
    f = read(spark, sf, "events").select("event_id", F.coalesce(F.when(e % 3 == 0, 25.0), F.when(e % 2 == 0, 60.0), F.lit(30.0)).alias("fps"), (e % 100 / 8).alias("s"))
    return f.select("event_id", "fps", F.greatest(F.lit(1), F.round(F.col("s") * F.col("fps")).cast("long")).alias("frames"), F.greatest(F.lit(0), (F.col("s") * 1000).cast("long") - 1500).alias("from_ms"))


@query("fus_06_net_profile", "WITH c AS (SELECT p_partkey, p_size / 10 + 3 AS a, (p_size % 7) / 10 + 2.8 AS b, (p_size % 5) / 10 + 3 AS c FROM part) SELECT p_partkey, i, round(a * (i / 10 - 0.5) * (i / 10 - 1) / 0.5 + b * (i / 10) * (i / 10 - 1) / -0.25 + c * (i / 10) * (i / 10 - 0.5) / 0.5, 6) AS height FROM c, range(0, 11) AS r(i)")
def net_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven samples of the parabola through three controls at 0, 1/2 and 1."""
    size, t = F.col("p_size"), F.col("i") / 10
    part = read(spark, sf, "part").select("p_partkey", (size / 10 + 3).alias("a"), (size % 7 / 10 + 2.8).alias("b"), (size % 5 / 10 + 3).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("i"))
    height = F.col("a") * (t - 0.5) * (t - 1) / 0.5 + F.col("b") * t * (t - 1) / -0.25 + F.col("c") * t * (t - 0.5) / 0.5
    return part.select("p_partkey", "i", _r(height).alias("height"))


SEGMENTS = "s AS (SELECT o_orderkey AS id, o_custkey AS parent, epoch_ms(o_orderdate) // 1000 AS a, epoch_ms(o_orderdate) // 1000 + 1000 + o_orderkey % 500 AS b FROM orders)"


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("CAST(floor(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) / 1000) AS BIGINT)")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"), at.alias("a"), (at + 1000 + F.col("o_orderkey") % 500).alias("b"))


@query("dml_01_split", "WITH " + SEGMENTS + " SELECT id, 0 AS part, a, CASE WHEN id % 3 = 0 THEN a + 500 ELSE b END AS b, false AS archived FROM s WHERE id % 5 <> 0 UNION ALL SELECT id, 1, a + 500, b, false FROM s WHERE id % 3 = 0 AND id % 5 <> 0 UNION ALL SELECT id, 0, a, b, true FROM s WHERE id % 5 = 0")
def split(spark: SparkSession, sf: str) -> DataFrame:
    """Segments cut in two where a cut lies inside, or archived; each part keeps its origin."""
    archived, cut = F.col("id") % 5 == 0, F.col("id") % 3 == 0
    part = lambda n, a, b: F.struct(F.lit(n).alias("part"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    parts = F.when(cut & ~archived, F.array(part(0, a, a + 500), part(1, a + 500, b))).otherwise(F.array(part(0, a, b)))
    return _segments(spark, sf).select("id", F.inline(parts), archived.alias("archived"))


@query("dml_02_boundary_patch", "WITH " + SEGMENTS + " SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN a + 7 END, a) AS a, coalesce(CASE WHEN id % 6 = 0 THEN b - 9 END, b) AS b, CASE WHEN id % 4 = 0 OR id % 6 = 0 THEN 'corrected' ELSE 'original' END AS source FROM s")
def boundary_patch(spark: SparkSession, sf: str) -> DataFrame:
    """The corrected boundary where there is one."""
    first, second = F.col("id") % 4 == 0, F.col("id") % 6 == 0
    return _segments(spark, sf).select("id", F.coalesce(F.when(first, F.col("a") + 7), "a").alias("a"), F.coalesce(F.when(second, F.col("b") - 9), "b").alias("b"), F.when(first | second, "corrected").otherwise("original").alias("source"))


@query("dml_03_containment", "WITH " + SEGMENTS + ", p AS (SELECT parent, min(a) + 100 AS pa, max(b) - 100 AS pb FROM s GROUP BY 1) SELECT id, CASE WHEN a < pa THEN 'starts_before_parent' ELSE 'ends_after_parent' END AS violation FROM s JOIN p USING (parent) WHERE a < pa OR b > pb")
def containment(spark: SparkSession, sf: str) -> DataFrame:
    """Children that stick out of their parent."""
    s = _segments(spark, sf)
    p = s.groupBy("parent").agg((F.min("a") + 100).alias("pa"), (F.max("b") - 100).alias("pb"))
    early = F.col("a") < F.col("pa")
    return s.join(p, "parent").filter(early | (F.col("b") > F.col("pb"))).select("id", F.when(early, "starts_before_parent").otherwise("ends_after_parent").alias("violation"))


@query("dml_04_latest_decision", "SELECT c_custkey, max_by(o_orderstatus, o_orderkey) AS decision, coalesce(max(o_orderkey), 0) AS revision FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    latest = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("decision"), F.max("o_orderkey").alias("revision"))
    joined = read(spark, sf, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "decision", F.coalesce("revision", F.lit(0)).alias("revision"))


@query("dml_06_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the lines when a segment's customers and their orders go."""
    gone = read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = read(spark, sf, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("ts_01_rally_shots", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS shots, count(*) AS n FROM lineitem GROUP BY 1")
def rally_shots(spark: SparkSession, sf: str) -> DataFrame:
    """A rally's shots in order; a rally has a few of them."""
    shots = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(shots, ",").alias("shots"), F.count("*").alias("n"))


@query("ts_02_down_sampling", "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM n WHERE i % CAST(ceil(n / 20) AS BIGINT) = 0")
def down_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Evenly spaced points of each track, about twenty: the number is the feature."""
    w = W.partitionBy("user_id")
    n = read(spark, sf, "events").select("user_id", "event_id", (F.row_number().over(w.orderBy("event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return n.filter(F.col("i") % F.ceil(F.col("n") / 20) == 0).select("user_id", "event_id")


@query("ts_03_landing_zones", POINTS + ", z AS (SELECT CAST((CASE WHEN abs(y_ft - 22) < 7 THEN 0 WHEN abs(y_ft - 22) < 12 THEN 1 WHEN abs(y_ft - 22) < 17 THEN 2 ELSE 3 END) * 3 + least(2, floor(x_ft / (20.0 / 3))) + 1 AS INT) AS zone FROM track_points WHERE x_ft BETWEEN 0 AND 20 AND y_ft BETWEEN 0 AND 44 AND event_type = 'click') SELECT zone, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM z GROUP BY 1")
def landing_zones(spark: SparkSession, sf: str) -> DataFrame:
    zone = court.zone_12(F.col("x_ft"), F.col("y_ft"))
    n = track_points(spark, sf).filter("event_type = 'click'").groupBy(zone.alias("zone")).agg(F.count("*").alias("n")).filter("zone IS NOT NULL")
    # twelve rows at most
    return n.withColumn("share", _r(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))))


@query("ts_07_recording_groups", "SELECT user_id // 2 AS pair, min(user_id) AS left_camera, CASE WHEN count(DISTINCT user_id) = 2 THEN max(user_id) END AS right_camera, count(*) AS recordings FROM events GROUP BY 1")
def recording_groups(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy(F.floor(F.col("user_id") / 2).alias("pair")).agg(F.min("user_id").alias("left_camera"), F.when(F.min("user_id") != F.max("user_id"), F.max("user_id")).alias("right_camera"), F.count("*").alias("recordings"))


@query("ts_08_job_filter", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000")
def job_filter(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return read(spark, sf, "orders").filter("o_orderstatus <> 'P' AND o_totalprice > 1000").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("ts_09_anchor_coverage", "WITH " + CLICKS + " SELECT c.user_id, min(c.t_ms) AS first_ms, max(c.t_ms) AS last_ms, count(v.t_ms) AS matched, count(*) AS anchors FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t_ms >= v.t_ms GROUP BY 1")
def anchor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from courtlight.operators import intervals

    found = intervals.asof(*_two_views(spark, sf), "user_id", "t_ms", "event_id")
    return found.groupBy("user_id").agg(F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count("right_t").alias("matched"), F.count("*").alias("anchors"))


@query("ts_11_outbox", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', event_id) AS sequence FROM events")
def outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Pending actions first, then in the order in which they came."""
    w = W.partitionBy("user_id").orderBy(F.col("event_type") != "error", "event_id")
    return read(spark, sf, "events").select("event_id", F.row_number().over(w).cast("long").alias("sequence"))


@query("str_02_late_events", "WITH " + EV + ", e AS (SELECT user_id, max(t_ms) FILTER (WHERE event_type = 'purchase') AS ended FROM ev GROUP BY 1) SELECT event_id, CASE WHEN ended IS NULL OR t_ms <= ended + 300000 THEN 'accepted' ELSE 'late' END AS status FROM ev JOIN e USING (user_id)")
def late_events(spark: SparkSession, sf: str) -> DataFrame:
    """Actions are accepted until five minutes after the end of their take; later ones are told apart."""
    own = _events(spark, sf)
    ends = own.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("t_ms"))).alias("ended"))
    late = F.coalesce(F.col("t_ms") > F.col("ended") + 300_000, F.lit(False))
    return own.join(ends, "user_id").select("event_id", F.when(late, "late").otherwise("accepted").alias("status"))


@query(
    "str_06_view_states",
    """WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 7 > 0 THEN value >= 200 END AS up FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, up ORDER BY event_id) AS run FROM s WHERE up IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, up, run ORDER BY event_id) AS i FROM k),
    m AS (SELECT s.user_id, s.event_id, last_value(CASE WHEN r.up AND i >= 2 THEN true WHEN NOT r.up AND i >= 3 THEN false END IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM s LEFT JOIN r ON s.event_id = r.event_id)
    SELECT event_id, coalesce(active, false) AS active FROM m""",
)
def view_states(spark: SparkSession, sf: str) -> DataFrame:
    """Active after two scores in a row at or above the threshold, until three in a row below; nulls neither count nor reset."""
    order = W.partitionBy("user_id").orderBy("event_id")
    own = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 > 0, F.col("value") >= 200).alias("up"))
    known = own.filter("up IS NOT NULL").withColumn("new", F.when(F.coalesce(F.col("up") != F.lag("up").over(order), F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    long = known.withColumn("i", F.row_number().over(W.partitionBy("user_id", "run").orderBy("event_id"))).select("event_id", F.when(F.col("up") & (F.col("i") >= 2), True).when(~F.col("up") & (F.col("i") >= 3), False).alias("mark"))
    marked = own.select("user_id", "event_id").join(long, "event_id", "left")
    return marked.select("event_id", F.coalesce(F.last("mark", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)).alias("active"))


@query("str_10_inactive_takes", "WITH " + EV + ", l AS (SELECT user_id, max(t_ms) AS last_ms FROM ev GROUP BY 1) SELECT user_id, CASE WHEN last_ms >= (SELECT max(t_ms) FROM ev) - 21600000 THEN 'active' ELSE 'interrupted' END AS status FROM l")
def inactive_takes(spark: SparkSession, sf: str) -> DataFrame:
    last = _events(spark, sf).groupBy("user_id").agg(F.max("t_ms").alias("last_ms"))
    now = last.agg(F.max("last_ms").alias("now"))
    # one row
    return last.join(F.broadcast(now)).select("user_id", F.when(F.col("last_ms") >= F.col("now") - 21_600_000, "active").otherwise("interrupted").alias("status"))


@query("str_13_sliding_windows", "WITH w AS (SELECT ts, event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of two days, a new one each day."""
    stamped = read(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = stamped.groupBy(F.window("at", "2 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("str_13_session_windows", "WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions end after six hours without an event."""
    stamped = read(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = stamped.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("snk_01_json_write", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_write(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON with Spark's commit, and read back with its schema; broken lines would be null."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows.write.mode("overwrite").json(path := new_folder(spark, "json"))
    return spark.read.schema(rows.schema).option("mode", "PERMISSIVE").json(path)


@query("snk_03_trajectory_csv", POINTS + " SELECT track_id, frame_index, round(x_ft, 3) AS x_ft, round(y_ft, 3) AS y_ft FROM track_points")
def trajectory_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed columns with a header, sorted by player within files."""
    rows = track_points(spark, sf).select("track_id", "frame_index", _r("x_ft", 3).alias("x_ft"), _r("y_ft", 3).alias("y_ft"))
    rows.repartition("track_id").sortWithinPartitions("track_id", "frame_index").write.mode("overwrite").option("header", True).csv(path := new_folder(spark, "csv"))
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("snk_06_playback_chunks", "WITH " + EV + " SELECT event_type, t_ms // 86400000 AS chunk, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY ALL")
def playback_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a day by view as folders; a reader of one view opens its folders only."""
    rows = _events(spark, sf).select("event_id", "event_type", F.floor(F.col("t_ms") / 86_400_000).alias("chunk"))
    rows.repartition("event_type", "chunk").write.mode("overwrite").partitionBy("event_type", "chunk").parquet(path := new_folder(spark, "chunks"))
    back = spark.read.schema("event_id long, event_type string, chunk long").parquet(path)
    return back.filter("event_type = 'view'").groupBy("event_type", "chunk").agg(F.count("*").alias("n"))
