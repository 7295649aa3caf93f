"""The same fixture as SQL, for checking results in another engine."""
from __future__ import annotations

from beatwise.params import CHANNEL_MINUTES, CHANNEL_PATTERNS
from beatwise.sources.testdata import CHANNELS, NAMES


def listing(items) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items) + "]"


def channel_case(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({col}), '{p}') THEN '{k}'" for k, p in CHANNEL_PATTERNS)
    return f"CASE WHEN trim(coalesce({col}, '')) = '' THEN NULL {whens} ELSE 'other' END"


def minutes_case(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CHANNEL_MINUTES.items()) + " END"


def buckets(vf: str, runs: str) -> str:
    t = f"least(greatest(1, {vf}), {runs})"
    return f"CASE WHEN {runs} % {t} = 0 THEN {runs} // {t} ELSE {runs} END"


def hav(a1, o1, a2, o2) -> str:
    a = (f"(power(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * "
         f"cos(radians({a2})) * power(sin(radians({o2} - {o1}) / 2), 2))")
    return f"12742.0 * asin(CASE WHEN {a} > 1 THEN 1 ELSE sqrt({a}) END)"


OUTLETS = f"""
keyed AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS own_ns, c_acctbal AS value FROM customer),
based AS (SELECT a.k, a.value, CASE WHEN a.k % 50 = 1 AND t.k IS NOT NULL THEN a.k - 1 ELSE a.k END AS s,
                 coalesce(t.own_ns, a.own_ns) AS ns
          FROM keyed a LEFT JOIN keyed t ON a.k % 50 = 1 AND t.k = a.k - 1),
raw_outlets AS (
  SELECT k AS outlet_id, ns // 5 AS market_id, ns + 25 * (s // 1500) AS rep_id,
    CASE WHEN k % 100 = 51 THEN 'دكان ' || k ELSE ({listing(NAMES)})[s % 6 + 1] || ' ' || (s // 6) END AS name,
    CASE WHEN k % 7 = 3 THEN NULL ELSE 'C' || k END AS code,
    CASE WHEN k % 97 = 96 THEN 41844300 ELSE 33500000 + ((ns % 5 + CASE WHEN k % 61 = 60 THEN 1 ELSE 0 END) % 5) * 60000
      + ((s // 1500) % 40) * 300000 + ((s * 7919) % 9973 - 4986) * 5 END AS lat_e6,
    CASE WHEN k % 97 = 96 THEN 12463500 ELSE 35500000 + (ns // 5) * 900000 + (((s // 1500) // 40) % 20) * 4500000
      + ((s * 104729) % 9967 - 4983) * 5 END AS lng_e6,
    CAST(CASE WHEN k % 29 = 0 THEN 3 ELSE ([1, 2, 2, 4])[k % 4 + 1] END AS INTEGER) AS vf,
    ({listing(CHANNELS)})[k % 8 + 1] AS channel,
    CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE 8 + k % 30 END AS INTEGER) AS time_per_visit, value,
    k % 101 = 0 AS excluded, k % 97 = 96 AS "offset", CAST(k % 5 AS INTEGER) AS day_group
  FROM based),
outlets AS (
  SELECT *, lat_e6 / 1e6 AS latitude, lng_e6 / 1e6 AS longitude,
    CAST((outlet_id // 5) % ({buckets('vf', '4')}) AS INTEGER) AS bucket,
    CAST(CASE WHEN time_per_visit > 0 THEN time_per_visit
         ELSE coalesce({minutes_case('(' + channel_case('channel') + ')')}, 15) END AS INTEGER) AS call_minutes
  FROM raw_outlets)"""

STOPS = f"""{OUTLETS},
members AS (SELECT * FROM outlets WHERE NOT excluded AND NOT "offset" AND outlet_id % 89 <> 5),
visits AS (
  SELECT m.*, r.run, r.run AS week, m.day_group + 1 AS day_of_week
  FROM members m, (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS run) r
  WHERE list_contains(list_transform(range(0, vf), lambda j: (bucket + (j * 4) // vf) % 4 + 1), r.run)),
stops AS (
  SELECT market_id, rep_id, week, day_of_week, run, day_group,
    CAST(row_number() OVER (PARTITION BY rep_id, week, day_of_week ORDER BY lat_e6, lng_e6, outlet_id) AS INTEGER) AS seq,
    outlet_id, latitude, longitude, vf, call_minutes
  FROM visits)"""

LEGS = f"""{STOPS},
legs AS (
  SELECT *, coalesce({hav('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')}, 0.0) AS leg_km
  FROM stops WINDOW w AS (PARTITION BY rep_id, week, day_of_week ORDER BY seq)),
days AS (
  SELECT market_id, rep_id, week, day_of_week, run, day_group, count(*) AS visits, sum(leg_km) AS km,
    sum(call_minutes) AS call_min, sum(leg_km) * 1.3 / 25 * 60 AS drive_min,
    sum(call_minutes) + sum(leg_km) * 1.3 / 25 * 60 + 70 AS total_min
  FROM legs GROUP BY ALL)"""

REPS = """
reps AS (SELECT rep_id, min(market_id) AS market_id, 'Rep ' || rep_id AS rep_name, 4 AS min_daily_visits,
                6 AS max_daily_visits, 5 AS working_days, rep_id % 11 <> 10 AS is_active
         FROM outlets GROUP BY rep_id)"""

EDITS = """
edits AS (SELECT event_id AS edit_id, ts, user_id AS outlet_id,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'move' WHEN 'signup' THEN 'pin'
       WHEN 'purchase' THEN 'exclude' ELSE 'restore' END AS kind, (user_id * 7 + event_id) % 25 AS to_rep_id FROM events)"""

HISTORY = """
history AS (SELECT o_custkey AS outlet_id, o_orderkey AS visit_id, CAST(o_orderdate AS DATE) AS day,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 + 1 AS INTEGER) AS n_visits FROM orders)"""
