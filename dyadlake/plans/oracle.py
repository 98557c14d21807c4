"""SQL for DuckDB, written apart from the operators: every query starts from the driver's raw tables."""

from __future__ import annotations

from dyadlake.schema import EVENT_TYPES, HISTORY_TYPES, POSITIVE_WEIGHTS, RISK_WEIGHTS, SCORE_WEIGHTS, TARGETS

LOG = """
ev AS (SELECT event_id AS n, user_id + 1 AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS b, event_type AS e, ts FROM events),
it AS (SELECT ev.*, p_partkey % 100 + 1 AS owner FROM ev JOIN part ON p_partkey = (b - 1) + 100 * (n % 2)),
msgs AS (SELECT n AS id, least(a, b) * 10000 + greatest(a, b) AS conv, CASE WHEN n % 37 = 0 THEN NULL ELSE a END AS sender, ts, n % 23 = 0 AS deleted, a, b FROM ev WHERE e = 'purchase' AND n % 3 = 0),
members AS (SELECT DISTINCT conv, u FROM (SELECT conv, a AS u FROM msgs UNION ALL SELECT conv, b FROM msgs)),
senders AS (SELECT DISTINCT sender FROM msgs WHERE sender IS NOT NULL),
log AS (
  SELECT a AS actor_id, b AS target_id, 'profile_view' AS event_type, ts FROM ev WHERE e = 'view' AND n % 3 < 2
  UNION ALL SELECT a, b, 'favorite', ts FROM ev WHERE e = 'click' AND n % 3 = 0
  UNION ALL SELECT a, b, 'poke', ts FROM ev WHERE e = 'click' AND n % 3 = 1
  UNION ALL SELECT a, owner, 'image_reaction', ts FROM it WHERE e = 'click' AND n % 3 = 2
  UNION ALL SELECT a, owner, 'story_view', ts FROM it WHERE e = 'view' AND n % 3 = 2
  UNION ALL SELECT a, owner, 'story_reaction', ts FROM it WHERE e = 'signup' AND n % 3 = 2
  UNION ALL SELECT a, owner, 'story_reply', ts FROM it WHERE e = 'error' AND n % 3 = 0
  UNION ALL SELECT sender, u, 'message', ts FROM msgs JOIN members USING (conv) WHERE conv % 11 <> 0 AND sender IS NOT NULL AND NOT deleted AND u <> sender
  UNION ALL SELECT a, b, 'message_reaction', ts FROM ev JOIN senders ON sender = b WHERE e = 'purchase' AND n % 3 = 1 AND a <> b
  UNION ALL SELECT a, b, 'private_album_grant', ts FROM ev WHERE e = 'purchase' AND n % 3 = 2
  UNION ALL SELECT a, b, 'partner_request', ts FROM ev WHERE e = 'signup' AND n % 3 < 2
  UNION ALL SELECT a, b, 'partner_accepted', ts + INTERVAL 1 DAY FROM ev WHERE e = 'signup' AND n % 3 = 1
  UNION ALL SELECT b, a, 'partner_accepted', ts + INTERVAL 1 DAY FROM ev WHERE e = 'signup' AND n % 3 = 1
  UNION ALL SELECT a, b, 'block', ts FROM ev WHERE e = 'error' AND n % 3 = 1
  UNION ALL SELECT a, b, 'report', ts FROM ev WHERE e = 'error' AND n % 3 = 2 AND n % 10 <> 0
), valid AS (SELECT * FROM log WHERE actor_id IS NOT NULL AND target_id IS NOT NULL AND actor_id <> target_id)"""

_LIST = "['Alpha', 'bravo', 'Charlie', 'delta', 'Echo', 'foxtrot', 'Golf', 'hotel']"


def _array(m: int) -> str:
    some = f"list_transform(range(0, c % 3 + 1), lambda i: CASE WHEN (c + i) % 2 = 0 THEN upper({_LIST}[(c * {m} + i * 3) % 8 + 1]) ELSE {_LIST}[(c * {m} + i * 3) % 8 + 1] END)"
    return f"CASE WHEN c % 9 = 0 THEN NULL WHEN c % 8 = 0 THEN CAST([] AS VARCHAR[]) WHEN c % 7 = 0 THEN list_append({some}, ' ') ELSE {some} END"


_RELATION = "[ 'single', 'Partnered', NULL, 'Open']"
USERS = f"""
cu AS (SELECT c_custkey AS c, c_nationkey AS k, c_mktsegment AS seg FROM customer),
users AS (SELECT c + 1 AS id, c % 50 = 7 AS is_bot, c % 60 = 11 AS is_banned,
  CASE WHEN c % 17 <> 0 THEN DATE '1955-01-01' + CAST(c * 37 % 18000 AS INT) END AS born,
  CASE c % 5 WHEN 0 THEN (5 + c % 2) || '''' || (c % 12) || '"' WHEN 1 THEN CAST(60 + c % 30 AS VARCHAR) WHEN 2 THEN 'tall' WHEN 3 THEN '5''' || (c % 14) END AS height,
  CASE c % 5 WHEN 0 THEN (5 + c % 2) * 12.0 + c % 12 WHEN 1 THEN 60.0 + c % 30 WHEN 3 THEN CASE WHEN c % 14 <= 11 THEN 60.0 + c % 14 END END AS inches,
  CASE WHEN c % 19 <> 0 THEN CAST(110 + c * 13 % 200 AS DOUBLE) END AS weight,
  {_RELATION}[c % 4 + 1] AS relationship_status, CASE WHEN c % 2 = 0 THEN upper(seg) ELSE lower(seg) || ' ' END AS position,
  ['Slim', 'athletic', NULL, 'Average', 'stocky', 'Large'][c % 6 + 1] AS body_type,
  {_array(1)} AS body_hair, {_array(3)} AS my_types, {_array(5)} AS my_fetishes, {_array(6)} AS into_body_types, {_array(9)} AS into_body_hair, {_array(11)} AS into_types, {_array(13)} AS into_fetishes,
  CASE WHEN c % 10 <> 0 THEN CASE WHEN c % 3 = 0 THEN 'BUILDING' ELSE 'machinery' END END AS into_position, {_RELATION}[(c + 1) % 4 + 1] AS into_relationship_status,
  ['Any', '', 'Same city', 'Same neighborhood', 'Within 25 miles', 'within 300 mile', 'On request'][c % 7 + 1] AS into_proximity,
  CASE WHEN c % 15 = 0 THEN NULL WHEN c % 2 = 1 THEN upper('City ' || k) ELSE 'City ' || k END AS city,
  CASE WHEN c % 13 <> 0 THEN -60 + 5 * k + (c % 100) * CAST(0.01 AS DOUBLE) END AS lat, CASE WHEN c % 13 <> 0 THEN -150 + 12 * k + (c % 90) * CAST(0.01 AS DOUBLE) END AS lon,
  CASE WHEN c % 26 = 0 THEN -60 + 5 * k + (c % 100) * CAST(0.01 AS DOUBLE) END AS hlat, CASE WHEN c % 26 = 0 THEN -150 + 12 * k + (c % 90) * CAST(0.01 AS DOUBLE) END AS hlon,
  TIMESTAMP '2022-01-01' + to_days(CAST(c * 101 % 800 AS INT)) AS created_at,
  CASE WHEN c % 29 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(c * 7919 % 43200) END AS last_seen_at FROM cu),
settings AS (SELECT c + 1 AS user_id, CAST(50 + c * 7 % 500 AS DOUBLE) AS max_distance_km, CAST(18 + c % 20 AS INT) AS min_age, CAST(28 + c % 20 + c % 30 AS INT) AS max_age, CASE WHEN c % 41 <> 0 THEN c % 40 <> 3 END AS visible FROM cu WHERE c % 6 <> 5),
people AS (SELECT * FROM users WHERE NOT is_bot AND NOT is_banned)"""


def windows(*pairs: tuple[str, str], history: int = 90) -> str:
    rows = ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in pairs)
    return f"win AS (SELECT c AS cutoff_at, o AS outcome_end_at, c - INTERVAL {history} DAY AS h0, c - INTERVAL 7 DAY AS d7, c - INTERVAL 30 DAY AS d30, c - INTERVAL 90 DAY AS d90 FROM (VALUES {rows}) t(c, o)), wev AS (SELECT * FROM valid JOIN win ON ts >= least(h0, d90) AND ts < outcome_end_at)"


ONE = windows(("2024-01-23", "2024-01-30"))
THREE = windows(("2024-01-23", "2024-01-30"), ("2024-01-16", "2024-01-23"), ("2024-01-09", "2024-01-16"))
_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}_count" for t in EVENT_TYPES)
_RECENT = ", ".join([f"count(*) FILTER (WHERE ts >= d{n}) AS all_events_{n}d" for n in (7, 30, 90)] + [f"count(*) FILTER (WHERE event_type = '{t}' AND ts >= d{n}) AS {t}s_{n}d" for t in ("profile_view", "favorite", "message") for n in (7, 30)])
STATS = f"""
hist AS (SELECT cutoff_at, actor_id, target_id, min(ts) AS first_at, max(ts) AS last_at, {_COUNTS}, {_RECENT} FROM wev WHERE ts < cutoff_at AND ts >= h0 GROUP BY 1, 2, 3),
outc AS (SELECT cutoff_at, actor_id, target_id, min(ts) AS first_at, max(ts) AS last_at, {_COUNTS} FROM wev WHERE ts >= cutoff_at GROUP BY 1, 2, 3),
keys AS (SELECT DISTINCT cutoff_at, actor_id AS viewer_id, target_id AS candidate_id FROM wev WHERE event_type = 'profile_view' AND ts >= cutoff_at)"""
_KINDS = ["profile_view", "favorite", "poke", "image_reaction", "message"]


def _side(by: str, other: str, events: str, others: str, stem: str) -> str:
    """Straight from events, with distinct counts."""
    cols = [f"count(*) AS {events}", f"count(DISTINCT {other}) AS {others}"] + [f"count(*) FILTER (WHERE event_type = '{k}') AS {stem}{k}s" for k in _KINDS] + [f"count(*) FILTER (WHERE event_type = '{k}' AND ts >= d30) AS {stem}{k}s_30d" for k in ("profile_view", "favorite", "message")] + [f"count(DISTINCT {other}) FILTER (WHERE ts >= d30) AS {others}_30d"]
    return f"SELECT cutoff_at, {by}, {', '.join(cols)} FROM wev WHERE ts < cutoff_at AND ts >= h0 GROUP BY 1, 2"


ACTOR, RECEIVED = _side("actor_id", "target_id", "event_count", "unique_targets", ""), _side("target_id", "actor_id", "received_events", "unique_actors", "received_")
ITEMS = """SELECT cutoff_at, p_partkey % 100 + 1 AS user_id, count(*) AS image_count, count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 2 = 0) AS public_image_count, count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 2 = 1) AS private_image_count, count(*) FILTER (WHERE p_size % 5 = 0) AS avatar_image_count,
  count(*) FILTER (WHERE p_partkey % 3 <> 0 AND TIMESTAMP '2023-12-03' + to_days(p_size) < cutoff_at) AS descriptor_processed_count, max(TIMESTAMP '2023-12-01' + to_days(p_size)) AS latest_image_at FROM part, win WHERE TIMESTAMP '2023-12-01' + to_days(p_size) < cutoff_at GROUP BY 1, 2"""
AGE = "CASE WHEN {b} IS NOT NULL THEN CAST(date_diff('year', {b}, CAST({a} AS DATE)) - CASE WHEN strftime({a}, '%m%d') < strftime({b}, '%m%d') THEN 1 ELSE 0 END AS INT) END"


def km(a: str, b: str) -> str:
    la, lo, ma, mo = f"coalesce({a}.lat, {a}.hlat)", f"coalesce({a}.lon, {a}.hlon)", f"coalesce({b}.lat, {b}.hlat)", f"coalesce({b}.lon, {b}.hlon)"
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({ma} - {la}) / 2), 2) + cos(radians({la})) * cos(radians({ma})) * power(sin(radians({mo} - {lo}) / 2), 2))))"


def _zero(alias: str, prefix: str, cols: list[str]) -> str:
    return ", ".join(f"coalesce({alias}.{c}, 0) AS {prefix}{c}" for c in cols)


_N = [f"{t}_count" for t in EVENT_TYPES]
LABELS = {t: f"outcome_{t}_count > 0" for t in ("favorite", "poke", "image_reaction", "private_album_grant", "partner_accepted", "block", "report")} | {
    "story_engagement": "outcome_story_reaction_count + outcome_story_reply_count > 0", "message_started": "outcome_message_count > 0", "reciprocal_message": "outcome_message_count > 0 AND reverse_outcome_message_count > 0",
    "any_positive": " + ".join(f"outcome_{t}_count" for t in ("favorite", "poke", "image_reaction", "story_reaction", "story_reply", "message", "private_album_grant", "partner_accepted")) + " > 0",
}
PAIRS = f"""
ah AS ({ACTOR}), rh AS ({RECEIVED}), im AS ({ITEMS}),
base AS (SELECT k.cutoff_at, k.viewer_id, k.candidate_id, {_zero('h', 'history_', _N + ['all_events_7d', 'all_events_30d', 'all_events_90d'])}, {_zero('rv', 'reverse_history_', _N)}, {_zero('o', 'outcome_', _N)}, {_zero('ro', 'reverse_outcome_', _N)},
  coalesce(ah.event_count, 0) AS viewer_history_event_count, coalesce(ah.unique_targets_30d, 0) AS viewer_history_unique_targets_30d, coalesce(rh.received_events, 0) AS candidate_history_received_events, coalesce(rh.unique_actors, 0) AS candidate_history_unique_actors, coalesce(iv.image_count, 0) AS viewer_image_count, coalesce(ic.public_image_count, 0) AS candidate_public_image_count,
  sv.min_age AS viewer_min_age, sv.max_age AS viewer_max_age, sv.max_distance_km AS viewer_max_distance_km, sc.min_age AS candidate_min_age, sc.max_age AS candidate_max_age, sc.max_distance_km AS candidate_max_distance_km,
  {AGE.format(a='k.cutoff_at', b='v.born')} AS viewer_age, {AGE.format(a='k.cutoff_at', b='c.born')} AS candidate_age, v.inches AS viewer_height_inches, c.inches AS candidate_height_inches,
  {km('v', 'c')} AS distance_km, greatest(0.0, date_diff('microsecond', v.created_at, k.cutoff_at) / 86400e6) AS viewer_account_age_days, v AS v, c AS c
  FROM keys k JOIN people v ON v.id = k.viewer_id JOIN people c ON c.id = k.candidate_id
  LEFT JOIN hist h ON h.cutoff_at = k.cutoff_at AND h.actor_id = k.viewer_id AND h.target_id = k.candidate_id LEFT JOIN hist rv ON rv.cutoff_at = k.cutoff_at AND rv.target_id = k.viewer_id AND rv.actor_id = k.candidate_id
  LEFT JOIN outc o ON o.cutoff_at = k.cutoff_at AND o.actor_id = k.viewer_id AND o.target_id = k.candidate_id LEFT JOIN outc ro ON ro.cutoff_at = k.cutoff_at AND ro.target_id = k.viewer_id AND ro.actor_id = k.candidate_id
  LEFT JOIN ah ON ah.cutoff_at = k.cutoff_at AND ah.actor_id = k.viewer_id LEFT JOIN rh ON rh.cutoff_at = k.cutoff_at AND rh.target_id = k.candidate_id
  LEFT JOIN im iv ON iv.cutoff_at = k.cutoff_at AND iv.user_id = k.viewer_id LEFT JOIN im ic ON ic.cutoff_at = k.cutoff_at AND ic.user_id = k.candidate_id
  LEFT JOIN settings sv ON sv.user_id = k.viewer_id LEFT JOIN settings sc ON sc.user_id = k.candidate_id),
pairs AS (SELECT *, {', '.join(f'{e} AS outcome_{t}' for t, e in LABELS.items())} FROM base)"""
PAIR_COLUMNS = [f"{p}{n}" for p in ("history_", "reverse_history_", "outcome_", "reverse_outcome_") for n in _N] + ["history_all_events_7d", "history_all_events_30d", "history_all_events_90d", "viewer_history_event_count", "viewer_history_unique_targets_30d", "candidate_history_received_events", "candidate_history_unique_actors", "viewer_image_count", "candidate_public_image_count", "viewer_min_age", "viewer_max_age", "viewer_age", "candidate_age", "viewer_height_inches", "candidate_height_inches"] + [f"outcome_{t}" for t in LABELS]


def tok(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), '')"


def toks(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({x}, CAST([] AS VARCHAR[])), lambda t: {tok('t')}), lambda t: t IS NOT NULL)))"


def band(x: str, bands: list) -> str:
    return "CASE WHEN " + x + " IS NULL THEN NULL " + " ".join(f"WHEN {x} < {top} THEN '{label}'" for top, label in bands[:-1]) + f" ELSE '{bands[-1][1]}' END"


def span(x: str, ranges: list) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {lo} AND {hi} THEN '{lo}-{hi}'" for lo, hi in ranges) + " END"


_RAW = " + ".join(f"{round(w * 100)} * count(*) FILTER (WHERE event_type = '{t}' AND ts >= {{since}})" for t, w in POSITIVE_WEIGHTS.items())
SIGNAL = f"""
raws AS (SELECT cutoff_at, actor_id, target_id, 'long' AS horizon, ({_RAW.format(since='d90')}) / 100.0 AS raw FROM wev WHERE ts < cutoff_at GROUP BY 1, 2, 3
  UNION ALL SELECT cutoff_at, actor_id, target_id, 'recent', ({_RAW.format(since='d30')}) / 100.0 FROM wev WHERE ts < cutoff_at GROUP BY 1, 2, 3),
signal AS (SELECT cutoff_at, actor_id, target_id, horizon, CAST(raw AS DOUBLE) AS raw, 0.5 + 0.5 * tanh(CAST(raw AS DOUBLE) / 2) AS score, least(4.0, 1.5 * ln(1 + CAST(raw AS DOUBLE))) AS evidence FROM raws WHERE raw > 0)"""


def traits(c: str, age: str, distance: str, keep: str, source: str) -> str:
    from dyadlake.schema import AGE_BANDS, DISTANCE_BANDS, HEIGHT_BANDS, WEIGHT_BANDS

    one = {"age": band(age, AGE_BANDS), "height": band(f"{c}.inches", HEIGHT_BANDS), "weight": band(f"{c}.weight", WEIGHT_BANDS), "distance": band(distance, DISTANCE_BANDS), "position": tok(f"{c}.position"), "body_type": tok(f"{c}.body_type"), "relationship_status": tok(f"{c}.relationship_status")}
    parts = [f"SELECT {keep}, '{k}' AS kind, {e} AS key FROM {source} WHERE {e} IS NOT NULL" for k, e in one.items()]
    parts += [f"SELECT {keep}, '{k}' AS kind, unnest({toks(f'{c}.{col}')}) AS key FROM {source}" for k, col in (("body_hair", "body_hair"), ("type", "my_types"), ("fetish", "my_fetishes"))]
    return " UNION ALL ".join(parts)


SEEN = f"seen AS (SELECT s.*, {AGE.format(a='s.cutoff_at', b='c.born')} AS age, {km('v', 'c')} AS distance, c AS c FROM signal s JOIN people v ON v.id = actor_id JOIN people c ON c.id = target_id)"
STATE = f"""{SEEN}, tr AS ({traits('c', 'age', 'distance', 'cutoff_at, actor_id, horizon, score, evidence', 'seen')}),
state AS (SELECT cutoff_at, actor_id AS user_id, horizon, kind, key, greatest(0.0, least(1.0, (1.0 + sum(score * evidence)) / (2.0 + sum(evidence)))) AS score, count(*) AS evidence_count, sum(evidence) AS evidence_weight FROM tr GROUP BY 1, 2, 3, 4, 5),
strength AS (SELECT cutoff_at, actor_id AS user_id, horizon, count(*) AS observation_count, sum(evidence) AS evidence_weight, 1 - exp(-sum(evidence) / 12) AS strength FROM seen GROUP BY 1, 2, 3)"""


def hashed(parts: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256({parts}), 1, 13) AS BIGINT) AS DOUBLE)"


def prob(t: str, v: str = "viewer_id", c: str = "candidate_id") -> str:
    return f"{hashed(f'''concat('{t}:', {v}, ':', {c})''')} / 4503599627370496.0"


def _mean(w: dict) -> str:
    return "(" + " + ".join(f"p_{t} * {x}" for t, x in w.items()) + f") / {sum(w.values())}"


SCORE = f"greatest(0.0, least(1.0, {_mean(SCORE_WEIGHTS)} * (1 - {_mean(RISK_WEIGHTS)})))"
PROBS = ", ".join(f"{prob(t)} AS p_{t}" for t in TARGETS)
MARKS = f"marks AS (SELECT cutoff_at, viewer_id, candidate_id, {', '.join(f'outcome_{t}' for t in TARGETS)}, {PROBS} FROM pairs), um AS (" + " UNION ALL ".join(f"SELECT cutoff_at, viewer_id, candidate_id, '{t}' AS target, CAST(outcome_{t} AS INT) AS label, p_{t} AS score FROM marks" for t in TARGETS) + ")"
HISTORY_SUM = " + ".join(f"history_{t}_count" for t in HISTORY_TYPES)


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + " " + body


E1, E3 = (LOG, ONE, STATS), (LOG, THREE, STATS)
P1, P3 = (LOG, USERS, ONE, STATS, PAIRS), (LOG, USERS, THREE, STATS, PAIRS)
A1 = (LOG, USERS, ONE, SIGNAL, STATE)
