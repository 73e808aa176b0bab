"""SQL of op12: a recursion row by row over the cheapest edits that lead to each of the four role states."""

from __future__ import annotations

#: A state no edits lead to.
_NEVER = "{'c': 1000000000, 'a': '', 't': ''}"


def _step(state: str, cost: str, letter: str, line: str = "") -> str:
    """A state's cost, audit and text after one more edit; `line` is the line that it adds."""
    said = f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}" if line else f"{state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {said}}}"


def _least(*ways: str) -> str:
    return "list_min([" + ",\n    ".join(ways) + "])"


def _if(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {_NEVER} END"


_USER, _ASSISTANT, _OWN = "'user:'", "'assistant:'", "x.role || ':' || x.text"
_BOTH = "'user:' || chr(10) || 'assistant:'"
_LEFT = "x.fault IN (0, 3)"
_CHARGE = "CASE x.fault WHEN 3 THEN 5 ELSE 0 END"

OP12_SQL = rf"""
WITH RECURSIVE
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
harmed AS (
  SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda y: ord(y)::BIGINT)), lambda h, b:
    list_reduce(list_prepend(xor(h, b), range(8)), lambda k, i: xor(k // 2, 3988292384 * (k % 2))))) % 20 AS harm
  FROM named),
rows_after AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_after),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM ordered),
judged AS (
  SELECT conv_id, turn, role, text, n, left(role, 1) AS r, before,
    CASE WHEN said = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM seen),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 't': ''}} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, n,
    {_step('s0', '2', 'D')},
    {_least(_step('s1', '2', 'D'), _if(f"{_LEFT} AND x.r = 's'", _step('s0', _CHARGE, 'K', _OWN)))},
    {_least(_step('u', '2', 'D'), *[_if(f"{_LEFT} AND x.r = 'u'", _step(q, _CHARGE, 'K', _OWN)) for q in ('s0', 's1', 'a')], *[_if(_LEFT, _step(q, f'1 + {_CHARGE}', 'R', "'user:' || x.text")) for q in ('s0', 's1', 'a')])},
    {_least(_step('a', '2', 'D'), _if(f"{_LEFT} AND x.r = 'a'", _step('u', _CHARGE, 'K', _OWN)), _if(_LEFT, _step('u', f'1 + {_CHARGE}', 'R', "'assistant:' || x.text")))}
  FROM (
    SELECT w.conv_id, x.n, x, s0, s1,
      {_least('s2', *[_step(q, '5', 'I', _USER) for q in ('s0', 's1', 's3')])} AS u,
      {_least('s3', _step('s2', '5', 'I', _ASSISTANT), *[_step(q, '10', 'II', _BOTH) for q in ('s0', 's1')])} AS a
    FROM walk w JOIN judged x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.n = w.n + 1)),
ends AS (
  SELECT conv_id, {_least('s0', 's3', _step('s2', '5', 'I', _ASSISTANT), _step('s1', '10', 'II', _BOTH))} AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE n > 1 AND before || '>' || r NOT IN ('s>u', 'u>a', 'a>u')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM ends e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
