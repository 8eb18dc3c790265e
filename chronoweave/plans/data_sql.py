"""DuckDB SQL for the queries of data_queries."""

from __future__ import annotations

_READS = r"""
reads AS (
  SELECT DISTINCT reading_id, name, kind, time, value FROM traffic
  WHERE value IS NOT NULL AND NOT isnan(value)
    AND coalesce(nullif(regexp_replace(lower(status), '^\s+|\s+$', '', 'g'), '') IN ('ok', 'fail', 'offline', 'degraded'), true))
"""

P1 = r"""
WITH t AS (
  SELECT DISTINCT reading_id AS id, name, epoch_us(time) // 86400000000 AS day,
    value IS NULL OR isnan(value) OR coalesce(nullif(regexp_replace(lower(status), '^\s+|\s+$', '', 'g'), '') NOT IN ('ok', 'fail', 'offline', 'degraded'), false) AS gone
  FROM traffic),
speeds AS (
  SELECT m.name, k.speed * 37500000.0 AS most FROM series_meta m
  LEFT JOIN interface_kinds k ON lower(trim(k.kind)) = lower(trim(m.kind))),
f AS (
  SELECT DISTINCT flow_id AS id, flow.name, epoch_us(time) // 86400000000 AS day,
    "in" IS NULL OR "in" < 0 OR coalesce("in" > most, false) AS gone_in,
    "out" IS NULL OR "out" < 0 OR coalesce("out" > most, false) AS gone_out
  FROM flow LEFT JOIN speeds ON speeds.name = flow.name),
a AS (
  SELECT DISTINCT avail_id AS id, name,
    NOT coalesce(regexp_replace(lower(value), '^\s+|\s+$', '', 'g') IN ('up', 'degraded', 'down', 'maint'), false) AS gone
  FROM availability),
cells AS (
  SELECT 'traffic' AS tab, id, 'value' AS field, name, day, gone FROM t
  UNION ALL SELECT 'flow', id, 'in', name, day, gone_in FROM f
  UNION ALL SELECT 'flow', id, 'out', name, day, gone_out FROM f
  UNION ALL SELECT 'availability', id, 'value', name, 0, gone FROM a)
SELECT tab, id AS row_id, field FROM (
  SELECT *, bool_or(NOT gone) OVER (PARTITION BY tab, field, name, day) AS helped FROM cells)
WHERE gone AND helped
"""

_PERIODS = """
once AS (
  SELECT outage_id, any_value(name) AS name, any_value(epoch_us(timerange['begin']) // 1000) AS b, any_value(epoch_us(timerange['end']) // 1000) AS e
  FROM outages WHERE timerange['begin'] IS NOT NULL AND timerange['end'] IS NOT NULL AND timerange['begin'] < timerange['end']
  GROUP BY outage_id),
marked AS (
  SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY name ORDER BY b, e, outage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM once),
grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY b, e, outage_id ROWS UNBOUNDED PRECEDING) AS g FROM marked),
periods AS (
  SELECT name, g, min(b) AS begin_ms, max(e) AS end_ms, count(*) AS n_records FROM grouped GROUP BY name, g)
"""

P2 = f"""
WITH {_PERIODS}
SELECT name, 'merged' AS kind, begin_ms, end_ms FROM periods WHERE n_records > 1
UNION ALL
SELECT * FROM (SELECT name, 'gap' AS kind, end_ms AS begin_ms, lead(begin_ms) OVER (PARTITION BY name ORDER BY begin_ms) AS end_ms FROM periods) WHERE end_ms IS NOT NULL
"""

P2_PERIODS = f"WITH {_PERIODS} SELECT name, begin_ms, end_ms, n_records FROM periods"

P3 = """
WITH p AS (
  SELECT name, CASE step WHEN '30s' THEN 30000 WHEN '1m' THEN 60000 WHEN '5m' THEN 300000 WHEN '15m' THEN 900000 END AS step_ms, unnest(points) AS p FROM series_points),
s AS (
  SELECT DISTINCT name, step_ms, (epoch_us(p['time']) // 1000) // step_ms AS k FROM p
  WHERE p['time'] IS NOT NULL AND p['value'] IS NOT NULL AND NOT isnan(p['value'])),
g AS (
  SELECT name, step_ms, unnest(generate_series(min(k), max(k))) AS k FROM s GROUP BY name, step_ms)
SELECT name, k * step_ms AS slot_ms FROM g ANTI JOIN s USING (name, step_ms, k)
"""

# The local line with radius 3 and the tricube kernel, per grid time, from the readings in reach.
P3_REGULAR = """
WITH p AS (
  SELECT name, CASE step WHEN '30s' THEN 30000 WHEN '1m' THEN 60000 WHEN '5m' THEN 300000 WHEN '15m' THEN 900000 END AS step_ms, unnest(points) AS p FROM series_points),
r AS (
  SELECT DISTINCT name, step_ms, epoch_us(p['time']) // 1000 AS ms, (epoch_us(p['time']) // 1000) // step_ms AS k, p['value'] AS y FROM p
  WHERE p['time'] IS NOT NULL AND p['value'] IS NOT NULL AND NOT isnan(p['value'])),
g AS (
  SELECT name, step_ms, unnest(generate_series(min(k), max(k))) AS j FROM r GROUP BY name, step_ms),
x AS (SELECT name, step_ms, unnest(generate_series(k - 2, k + 3)) AS j, k, ms, y FROM r),
d AS (SELECT *, (ms - j * step_ms) / (step_ms * 3.0) AS d FROM x),
w AS (SELECT *, pow(1 - pow(abs(d), 3), 3) AS w FROM d WHERE abs(d) < 1),
m AS (
  SELECT name, step_ms, j, sum(CASE WHEN j = k THEN 1 ELSE 0 END) AS n, sum(w) AS s0, sum(w * w) AS q, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1
  FROM w GROUP BY name, step_ms, j),
f AS (
  SELECT name, step_ms, j, coalesce(n, 0)::BIGINT AS n, coalesce(s0 * s0 / q, 0) AS support,
    CASE WHEN s0 * s2 - s1 * s1 > 0.01 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS fit
  FROM g LEFT JOIN m USING (name, step_ms, j)),
o AS (SELECT *, CASE WHEN n > 0 THEN 'observed' WHEN support >= 1.5 THEN 'filled' ELSE 'missing' END AS mark FROM f)
SELECT name AS source, step_ms, j * step_ms AS slot_ms, n, CASE WHEN mark <> 'missing' THEN round(fit, 6) END AS value, round(support, 6) AS support, mark FROM o
"""

P5 = f"""
WITH {_READS},
r AS (
  SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS i, count(*) OVER (PARTITION BY name) AS n FROM reads)
SELECT name, max(n) AS n,
  max(CASE WHEN i = (n * 50 + 99) // 100 THEN value END) AS p50,
  max(CASE WHEN i = (n * 90 + 99) // 100 THEN value END) AS p90,
  max(CASE WHEN i = (n * 95 + 99) // 100 THEN value END) AS p95,
  max(CASE WHEN i = (n * 99 + 99) // 100 THEN value END) AS p99
FROM r GROUP BY name
"""


def data_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p2_periods": P2_PERIODS, "p3_found": P3, "p3_regular": P3_REGULAR, "p5_percentiles": P5, "p5_merged_days": P5}
