"""Registered queries of the action ledger: ingestion, live state, scoring, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlight.operators import ledger
from courtlight.plans.registry import query
from courtlight.sources.adapters import plain, view

#: A user's events as the actions of a take: client ids come again with the same and with other requests, some actions
#: name a revision, some takes end before their last actions.
ACTIONS = """SELECT user_id AS take, event_id AS action_id, CASE WHEN event_id % 11 = 0 THEN 'c' || (event_id % 33) WHEN event_id % 17 <> 0 THEN 'c' || event_id END AS client_id,
  event_id * 2000 AS arrived_ms, CASE WHEN event_id % 50 = 1 THEN -5 ELSE event_id * 2000 - 100 END AS t_ms,
  CASE WHEN event_id % 400 = 7 THEN 'take_completed' WHEN event_type = 'signup' THEN 'rally_result_a' WHEN event_type = 'purchase' THEN 'rally_result_b'
    WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'start_next_rally' ELSE 'rally_result_a' END
    WHEN event_type = 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'correct_score' ELSE 'start_next_rally' END
    ELSE CASE event_id % 6 WHEN 0 THEN 'start_game' WHEN 1 THEN 'rally_replay' WHEN 2 THEN 'end_game' WHEN 3 THEN 'end_rally' WHEN 4 THEN 'end_set' END END AS kind,
  CASE event_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS server,
  CASE WHEN event_id % 4 <> 0 THEN CAST(21 - event_id % 6 AS INT) END AS a, CASE WHEN event_id % 8 <> 1 THEN CAST(21 - event_id * 3 % 7 AS INT) END AS b,
  CASE WHEN user_id % 3 <> 0 THEN 'hybrid_21_best_of_5_v1' WHEN user_id % 2 = 0 THEN 'side_out_singles_v1' END AS ruleset,
  CASE WHEN event_id % 13 = 0 THEN CAST(event_id % 40 AS INT) END AS expected_revision FROM {events}"""

_START = "CAST(NULL AS VARCHAR) AS server, 0 AS a, 0 AS b, 0 AS games_a, 0 AS games_b, 'rally' AS phase, CAST(NULL AS VARCHAR) AS side, 'not_started' AS status, CAST(NULL AS VARCHAR) AS winner, false AS game_over, CAST(NULL AS VARCHAR) AS game_winner"


def _next_play(source: str, kept: str) -> str:
    """The play behind an action, as a select over `source`, which has the play before it, the action (k_ names) and `kept`.

    how: same, blank (no match), fresh (a server and a score alone), open (a new hybrid game), calm (a replay), score.
    """
    return f"""
    SELECT {kept}, CASE WHEN how IN ('fresh', 'open', 'score') THEN n_server WHEN how = 'blank' THEN NULL ELSE server END AS server,
      CASE how WHEN 'blank' THEN 0 WHEN 'open' THEN 0 WHEN 'same' THEN a WHEN 'calm' THEN a ELSE n_a END AS a, CASE how WHEN 'blank' THEN 0 WHEN 'open' THEN 0 WHEN 'same' THEN b WHEN 'calm' THEN b ELSE n_b END AS b,
      CASE WHEN how IN ('blank', 'fresh') THEN 0 ELSE games_a + CASE WHEN how = 'score' AND won = 'A' THEN 1 ELSE 0 END END AS games_a,
      CASE WHEN how IN ('blank', 'fresh') THEN 0 ELSE games_b + CASE WHEN how = 'score' AND won = 'B' THEN 1 ELSE 0 END END AS games_b,
      CASE WHEN how IN ('blank', 'fresh', 'open') THEN 'rally' WHEN how = 'score' THEN CASE WHEN n_a = 20 AND n_b = 20 THEN 'serve_only' ELSE 'rally' END ELSE phase END AS phase,
      CASE WHEN how IN ('blank', 'fresh') THEN NULL WHEN how = 'open' THEN 'right'
        WHEN how = 'score' THEN CASE n_server WHEN 'A' THEN CASE WHEN n_a % 2 = 1 THEN 'left' ELSE 'right' END WHEN 'B' THEN CASE WHEN n_b % 2 = 1 THEN 'left' ELSE 'right' END END ELSE side END AS side,
      CASE WHEN how IN ('blank', 'fresh') THEN 'not_started' WHEN how = 'open' THEN 'in_progress' WHEN how = 'score' THEN CASE WHEN match IS NULL THEN 'in_progress' ELSE 'completed' END ELSE status END AS status,
      CASE WHEN how IN ('blank', 'fresh', 'open') THEN NULL WHEN how = 'score' THEN match ELSE winner END AS winner,
      CASE WHEN how = 'score' THEN won IS NOT NULL WHEN how = 'same' THEN game_over ELSE false END AS game_over,
      CASE WHEN how = 'score' THEN won WHEN how = 'same' THEN game_winner END AS game_winner
    FROM (SELECT *, CASE WHEN games_a + CASE WHEN won = 'A' THEN 1 ELSE 0 END = 3 THEN 'A' WHEN games_b + CASE WHEN won = 'B' THEN 1 ELSE 0 END = 3 THEN 'B' END AS match
    FROM (SELECT *, CASE WHEN n_a = 21 THEN 'A' WHEN n_b = 21 THEN 'B' END AS won
    FROM (SELECT *,
        CASE WHEN k_kind = 'start_game' THEN CASE WHEN hybrid AND asked IN ('A', 'B') THEN 'open' ELSE 'fresh' END
          WHEN k_kind IN ('end_game', 'end_set') THEN CASE WHEN hybrid THEN 'same' ELSE 'blank' END
          WHEN k_kind = 'rally_replay' THEN CASE WHEN hybrid THEN 'calm' ELSE 'same' END
          WHEN took IS NOT NULL THEN CASE WHEN NOT hybrid THEN 'fresh' WHEN status = 'completed' THEN 'same' ELSE 'score' END
          WHEN k_kind = 'correct_score' THEN CASE WHEN hybrid THEN 'score' ELSE 'fresh' END ELSE 'same' END AS how,
        coalesce(took, asked) AS n_server,
        CASE WHEN k_kind = 'start_game' THEN 0 WHEN took IS NULL THEN coalesce(k_a, a) WHEN hybrid THEN least(21, a + CASE WHEN took = 'A' AND (phase <> 'serve_only' OR server = 'A') THEN 1 ELSE 0 END)
          WHEN server IS NULL THEN CASE WHEN took = 'A' THEN 1 ELSE 0 END ELSE a + CASE WHEN took = 'A' AND server = 'A' THEN 1 ELSE 0 END END AS n_a,
        CASE WHEN k_kind = 'start_game' THEN 0 WHEN took IS NULL THEN coalesce(k_b, b) WHEN hybrid THEN least(21, b + CASE WHEN took = 'B' AND (phase <> 'serve_only' OR server = 'B') THEN 1 ELSE 0 END)
          WHEN server IS NULL THEN CASE WHEN took = 'B' THEN 1 ELSE 0 END ELSE b + CASE WHEN took = 'B' AND server = 'B' THEN 1 ELSE 0 END END AS n_b
    FROM (SELECT *, CASE k_kind WHEN 'rally_result_a' THEN 'A' WHEN 'rally_result_b' THEN 'B' END AS took, coalesce(k_server, server) AS asked, coalesce(k_ruleset, '') = 'hybrid_21_best_of_5_v1' AS hybrid FROM ({source})))))"""


PLAY_COLUMNS = "server, a, b, games_a, games_b, phase, side, status, winner, game_over, game_winner"
INGESTED_SQL = f"""
WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY arrived_ms, action_id) AS n,
    concat(coalesce(kind, '-'), '|', coalesce(server, '-'), '|', coalesce(CAST(a AS VARCHAR), '-'), '|', coalesce(CAST(b AS VARCHAR), '-')) AS asks FROM ({plain(ACTIONS)})),
r AS (
  SELECT take, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS action_id, '' AS verdict, 0 AS revision, CAST(NULL AS BIGINT) AS ended, CAST(0 AS BIGINT) AS duration, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS hashes, {_START}
  FROM (SELECT DISTINCT take FROM x)
  UNION ALL {_next_play(f'''
    SELECT take, n, action_id, verdict, revision + CASE WHEN verdict = 'accepted' THEN 1 ELSE 0 END AS revision, CASE WHEN verdict = 'completed' THEN arrived_ms ELSE ended END AS ended,
      CASE WHEN verdict = 'completed' THEN t_ms ELSE duration END AS duration, CASE WHEN verdict = 'accepted' AND client_id IS NOT NULL THEN list_append(ids, client_id) ELSE ids END AS ids,
      CASE WHEN verdict = 'accepted' AND client_id IS NOT NULL THEN list_append(hashes, asks) ELSE hashes END AS hashes, {PLAY_COLUMNS},
      CASE WHEN verdict = 'accepted' THEN kind END AS k_kind, x_server AS k_server, x_a AS k_a, x_b AS k_b, ruleset AS k_ruleset
    FROM (SELECT r.take, x.n, x.action_id, x.kind, x.server AS x_server, x.a AS x_a, x.b AS x_b, x.ruleset, x.client_id, x.asks, x.arrived_ms, x.t_ms, r.revision, r.ended, r.duration, r.ids, r.hashes,
        {", ".join("r." + c.strip() for c in PLAY_COLUMNS.split(","))},
        CASE WHEN x.kind = 'take_completed' THEN 'completed' WHEN x.arrived_ms > r.ended + 300000 THEN 'closed' WHEN r.ended IS NOT NULL AND NOT x.t_ms BETWEEN 0 AND r.duration THEN 'out_of_range'
          WHEN list_contains(r.ids, x.client_id) THEN CASE WHEN r.hashes[list_position(r.ids, x.client_id)] = x.asks THEN 'duplicate' ELSE 'mismatched_payload' END
          WHEN x.expected_revision <> r.revision THEN 'revision_conflict' WHEN x.t_ms < 0 THEN 'negative_time' ELSE 'accepted' END AS verdict
      FROM r JOIN x ON x.take = r.take AND x.n = r.n + 1)''', "take, n, action_id, verdict, revision, ended, duration, ids, hashes")}),
results AS (SELECT take, action_id, verdict, revision, {PLAY_COLUMNS} FROM r WHERE n > 0)
"""


@query("str_01_ledger", INGESTED_SQL + "SELECT * FROM results")
def ingested(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ingested(view(spark, sf, ACTIONS))


@query("str_04_live_state", INGESTED_SQL + f"SELECT take, revision, {PLAY_COLUMNS} FROM results WHERE verdict = 'accepted' QUALIFY row_number() OVER (PARTITION BY take ORDER BY revision DESC, action_id DESC) = 1")
def live(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.live(ledger.ingested(view(spark, sf, ACTIONS)))


#: The ledger as it was, and as it is after some actions were undone; snapshots were taken before.
LEDGER = ACTIONS.replace("event_id AS action_id", "event_id AS action_id, CAST(floor(event_id / 3) AS BIGINT) AS revision, event_id % 5 AS created_ms, event_id % 19 = 3 AS undone")
STORED = "action_id % 6 <> 1"


def _facts_sql(name: str, where: str) -> str:
    """Facts before each rally: the play behind the last correction before the rally is decided, or behind its begin."""
    return f"""
{name}_x AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY revision, created_ms, action_id) AS n FROM ({plain(LEDGER)}) WHERE {where}),
{name}_r AS (
  SELECT take, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS action_id, CAST(NULL AS VARCHAR) AS k_kind, {_START} FROM (SELECT DISTINCT take FROM {name}_x)
  UNION ALL {_next_play(f'''SELECT r.take, x.n, x.action_id, {", ".join("r." + c.strip() for c in PLAY_COLUMNS.split(","))}, x.kind AS k_kind, x.server AS k_server, x.a AS k_a, x.b AS k_b, x.ruleset AS k_ruleset
    FROM {name}_r r JOIN {name}_x x ON x.take = r.take AND x.n = r.n + 1''', "take, n, action_id, k_kind")}),
{name}_rally AS (
  SELECT *, sum(CASE WHEN k_kind IN ('start_next_rally', 'start_game', 'end_game', 'end_set', 'rally_result_a', 'rally_result_b', 'rally_replay', 'end_rally', 'start_timeout', 'change_side') THEN 1 ELSE 0 END)
    OVER (PARTITION BY take ORDER BY n) AS part FROM {name}_r WHERE n > 0),
{name} AS (
  SELECT take, min(action_id) FILTER (WHERE k_kind = 'start_next_rally') AS action_id, arg_max({{'server': server, 'a': a, 'b': b, 'games_a': games_a, 'games_b': games_b, 'phase': phase}}, n) AS facts
  FROM {name}_rally WHERE k_kind IN ('start_next_rally', 'correct_score') GROUP BY take, part HAVING count(*) FILTER (WHERE k_kind = 'start_next_rally') > 0)"""


@query(
    "win_16_scoring",
    f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY revision, created_ms, action_id) AS n FROM ({plain(LEDGER)}) WHERE NOT undone),
r AS (SELECT take, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS action_id, CAST(NULL AS VARCHAR) AS k_kind, {_START} FROM (SELECT DISTINCT take FROM x)
  UNION ALL {_next_play(f'''SELECT r.take, x.n, x.action_id, {", ".join("r." + c.strip() for c in PLAY_COLUMNS.split(","))}, x.kind AS k_kind, x.server AS k_server, x.a AS k_a, x.b AS k_b, x.ruleset AS k_ruleset
    FROM r JOIN x ON x.take = r.take AND x.n = r.n + 1''', "take, n, action_id, k_kind")})
SELECT take, action_id, k_kind AS kind, {PLAY_COLUMNS} FROM r WHERE n > 0""",
)
def scoring(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.played(view(spark, sf, LEDGER))


@query("str_03_replay", "WITH RECURSIVE " + _facts_sql("derived", "NOT undone") + " SELECT take, action_id, facts.* FROM derived")
def replayed(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.replayed(view(spark, sf, LEDGER))


@query(
    "str_03_reprojection",
    "WITH RECURSIVE " + _facts_sql("before", "true") + "," + _facts_sql("derived", "NOT undone") + f""",
stored AS (
  SELECT take, action_id, 0 AS revision, 'superseded' AS status, facts FROM before WHERE {STORED} AND action_id % 9 = 0
  UNION ALL SELECT take, action_id, CASE WHEN action_id % 9 = 0 THEN 1 ELSE 0 END, CASE WHEN action_id % 10 = 4 THEN 'undone' ELSE 'effective' END, facts FROM before WHERE {STORED}),
newest AS (SELECT *, revision = max(revision) OVER (PARTITION BY take, action_id) AS last FROM stored),
told AS (
  SELECT s.*, d.facts AS derived, CASE WHEN s.status = 'effective' AND s.action_id NOT IN (SELECT action_id FROM derived_x) THEN 'undone'
    WHEN d.facts IS NOT NULL AND last AND s.status <> 'undone' AND s.facts IS DISTINCT FROM d.facts THEN 'superseded' ELSE 'unchanged' END AS change
  FROM newest s LEFT JOIN derived d USING (take, action_id))
SELECT take, action_id, revision, CASE change WHEN 'unchanged' THEN status ELSE change END AS status, change, facts.* FROM told
UNION ALL SELECT take, action_id, revision + 1, 'effective', 'new', derived.* FROM told WHERE change = 'superseded'""",
)
def reprojected(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the whole ledger against the ledger without what was undone."""
    actions = view(spark, sf, LEDGER)
    before = ledger.replayed(actions.withColumn("undone", F.lit(False))).filter(STORED)
    twice = F.col("action_id") % 9 == 0
    last = before.withColumns({"revision": F.when(twice, 1).otherwise(0), "status": F.when(F.col("action_id") % 10 == 4, "undone").otherwise("effective")})
    first = before.filter(twice).withColumns({"revision": F.lit(0), "status": F.lit("superseded")})
    return ledger.reprojected(first.unionByName(last), actions)
