"""DuckDB SQL for the queries of series_queries."""

from __future__ import annotations

E = """e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, user_id, event_type, value,
  CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS g FROM events)"""
F = """f AS (SELECT flow_id, name, epoch_us(time) // 1000 AS t, "in", "out" FROM flow)"""
O = """o AS (SELECT DISTINCT outage_id, name, epoch_us(timerange['begin']) // 1000 AS b, epoch_us(timerange['end']) // 1000 AS e
  FROM outages WHERE timerange['begin'] IS NOT NULL AND timerange['end'] IS NOT NULL)"""
W = "OVER (PARTITION BY event_type ORDER BY t, event_id)"

_STATS = "round(avg(value), 9) AS avg_value, max(value) AS max_value, min(value) AS min_value, count(*) AS n"

# Calendar keys by text, begin and end of their windows.
_CAL = {"daily": ("%Y-%m-%d", "day"), "monthly": ("%Y-%m", "month"), "yearly": ("%Y", "year")}


def _fixed(duration: str, ms: int) -> str:
    return f"""WITH {E}, x AS (SELECT *, t // {ms} AS p FROM e)
SELECT p * {ms} AS t, (p + 1) * {ms} AS e, '{duration}-' || p AS k, {_STATS} FROM x GROUP BY p"""


def _calendar(kind: str, hours: int = 0, shift_end: int | None = None) -> str:
    """`hours`: what the zone's clock is ahead of UTC (in January, for months in its summer `shift_end`)."""
    form, part = _CAL[kind]
    end = hours if shift_end is None else shift_end
    return f"""WITH {E}, x AS (SELECT *, date_trunc('{part}', make_timestamp((t + {hours} * 3600000) * 1000)) AS w FROM e)
SELECT epoch_us(w) // 1000 - {hours} * 3600000 AS t, epoch_us(w + INTERVAL 1 {part}) // 1000 - 1000 - {end} * 3600000 AS e,
  strftime(w, '{form}') AS k, {_STATS} FROM x GROUP BY w"""


_POLICY = {
    "keep": ("g", "count(*)", "", ""),
    "ignore": ("g", "count(g)", "", ""),
    "zero": ("coalesce(g, 0)", "count(*)", "", ""),
    "propagate": ("g", "count(*)", "CASE WHEN count(*) = count(g) THEN ", " END"),
    "none_if_empty": ("g", "count(*)", "", ""),
}


def _policies() -> str:
    cols = []
    for p, (v, n, a, z) in _POLICY.items():
        where = " FILTER (WHERE g IS NOT NULL)" if p == "ignore" else ""
        first = f"list({v} ORDER BY event_id){where}"
        cols += [
            f"round({a}coalesce(sum({v}), 0){z}, 6) AS sum_{p}",
            f"round({a}coalesce(avg({v}), 0){z}, 9) AS avg_{p}",
            f"{a}{n}{z} AS count_{p}",
            f"{a}min({v}){z} AS min_{p}",
            f"{a}max({v}){z} AS max_{p}",
            f"{a}({first})[1]{z} AS first_{p}",
            f"{a}({first})[-1]{z} AS last_{p}",
        ]
    return f"WITH {E} SELECT strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS k, event_type AS grp, {', '.join(cols)} FROM e GROUP BY 1, 2"


def _methods() -> str:
    cols = []
    for name, q in (("p5", 5), ("p50", 50), ("p95", 95)):
        lo, rest = f"((n - 1) * {q} // 100)", f"((n - 1) * {q} % 100)"
        a, b = f"v[{lo} + 1]", f"v[least({lo} + 2, n)]"
        cols.append(f"""round(CASE WHEN {rest} = 0 OR method = 'lower' THEN {a} WHEN method = 'higher' THEN {b}
  WHEN method = 'nearest' THEN CASE WHEN {rest} < 50 THEN {a} ELSE {b} END
  WHEN method = 'midpoint' THEN ({a} + {b}) / 2 ELSE {a} + ({b} - {a}) * ({rest} / 100.0) END, 9) AS {name}""")
    return f"""WITH l AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY event_type),
m AS (SELECT unnest(['linear', 'lower', 'higher', 'nearest', 'midpoint']) AS method)
SELECT event_type, method, {', '.join(cols)} FROM l, m"""


def _fill(method: str, limit: int | None) -> str:
    """Runs are numbered by the count of values before; a run's place counts the gaps in it."""
    near = "true" if limit is None else f"i <= {limit}"
    short = "true" if limit is None else f"gap < {limit}"
    value = {
        "zero": f"CASE WHEN g IS NOT NULL THEN g WHEN {near} THEN 0 END",
        "pad": f"CASE WHEN g IS NOT NULL THEN g WHEN {near} THEN pv END",
        "linear": f"round(CASE WHEN g IS NOT NULL THEN g WHEN {short} AND nv IS NOT NULL THEN pv + (nv - pv) * ((t - pt) / nullif(nt - pt, 0)) END, 9)",
    }[method]
    return f"""WITH {E},
a AS (SELECT *, count(g) {W} AS c,
  last_value(g IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS pv,
  last_value(CASE WHEN g IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS pt,
  first_value(g IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN g IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
  FROM e),
b AS (SELECT *, sum(CASE WHEN g IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, c ORDER BY t, event_id) AS i,
  sum(CASE WHEN g IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, c) AS gap FROM a)
SELECT event_id, t, {value} AS g FROM b"""


def _aligned(method: str, limit: int | None, ms: int, value: str = "value", source: str = "e") -> str:
    many = "true" if limit is None else f"hi - lo + 1 <= {limit}"
    new = "pv" if method == "hold" else f"pv + ({value} - pv) * ((j * {ms} - pt) / nullif(t - pt, 0))"
    return f"""p AS (SELECT *, lag(t) {W} AS pt, lag({value}) {W} AS pv FROM {source}),
r AS (SELECT *, CASE WHEN pt IS NULL AND t % {ms} = 0 THEN t // {ms} ELSE pt // {ms} + 1 END AS lo, t // {ms} AS hi FROM p),
al AS (SELECT event_type, event_id, j * {ms} AS t, CASE WHEN pt IS NULL THEN {value} WHEN {many} THEN {new} END AS {value}
  FROM (SELECT *, unnest(generate_series(lo, hi)) AS j FROM r WHERE lo <= hi))"""


def _rated(source: str, value: str, sign: str = "") -> str:
    r = f"({value} - pv) / nullif((t - pt) / 1000.0, 0)"
    return f"""SELECT pt AS t, t AS e, event_type, round({sign.format(r=r) if sign else r}, 9) AS {value}_rate
FROM (SELECT *, lag(t) {W} AS pt, lag({value}) {W} AS pv FROM {source}) WHERE pt IS NOT NULL"""


_HOURS = """h AS (SELECT event_type, '1h-' || (t // 3600000) AS k, t // 3600000 * 3600000 AS t, (t // 3600000 + 1) * 3600000 AS e, count(*) AS n, max(value) AS value
  FROM e GROUP BY ALL)"""

_SPAN = "1704672000000", "1705276800000"
_PROBE = 1_705_000_000_123

_POS = f"p AS (SELECT *, row_number() {W} - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM e)"


def _bisect(t: str, where: str = "true") -> str:
    """The position of a time per type, by the rules of the lookup."""
    return f"""(SELECT event_type, coalesce(min(CASE WHEN t = {t} THEN pos END), CASE WHEN max(t) > {t} THEN greatest(min(CASE WHEN t > {t} THEN pos END) - 1, 0) END, max(pos)) AS found
  FROM p WHERE {where} GROUP BY event_type)"""


def series_sql() -> dict[str, str]:
    sql = {
        "rollup_fixed_1d": _fixed("1d", 86_400_000),
        "rollup_fixed_30s": _fixed("30s", 30_000),
        "rollup_hourly": _fixed("1h", 3_600_000),
        "rollup_daily_utc": _calendar("daily"),
        "rollup_daily_tokyo": _calendar("daily", 9),
        "rollup_monthly": _calendar("monthly"),
        "rollup_monthly_angeles": _calendar("monthly", -8),
        "rollup_yearly": _calendar("yearly"),
        "rollup_to_events": f"WITH {E}, x AS (SELECT *, t // 3600000 AS p FROM e) SELECT p * 3600000 + 1800000 AS t, round(avg(value), 9) AS avg_value, count(*) AS n FROM x GROUP BY p",
        "group_window_agg": f"""WITH {E}, x AS (SELECT *, t // 3600000 AS p FROM e)
SELECT p * 3600000 AS t, (p + 1) * 3600000 AS e, '1h-' || p AS k, event_type, round(avg(value), 9) AS mean_value, count(*) AS n, round(median(value), 9) AS median_value,
  round(stddev_pop(value), 9) AS sd, round(max(value) - min(value), 9) AS spread, round(quantile_cont(value, 0.95), 9) AS p95 FROM x GROUP BY p, event_type""",
        "global_agg": f"WITH {E} SELECT min(t) AS t, max(t) AS e, event_type AS grp, round(sum(value), 6) AS total, count(*) AS n FROM e GROUP BY event_type",
        "agg_reducers": f"""WITH {E} SELECT round(sum(value), 6) AS total, round(avg(value), 9) AS mean_value, max(value) AS hi, min(value) AS lo, count(*) AS n,
  arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, round(max(value) - min(value), 9) AS spread, round(median(value), 9) AS median_value,
  round(stddev_pop(value), 9) AS sd, round(quantile_cont(value, 0.9), 9) AS p90, event_type AS kept,
  CASE WHEN count(DISTINCT user_id) <= 1 THEN arg_min(user_id, event_id) END AS unkept FROM e GROUP BY event_type""",
        "agg_policies": _policies(),
        "percentile_methods": _methods(),
        "quantile_4": "SELECT event_type, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS q2, round(quantile_cont(value, 0.75), 9) AS q3 FROM events GROUP BY event_type",
        "select_cols": f'WITH {F} SELECT t, name, "in", flow_id FROM f',
        "select_nested": f'WITH {F} SELECT t, name, "in" AS "direction.in", "out" AS "direction.out", flow_id FROM f',
        "rename_columns": f'WITH {F} SELECT t, flow_id, "in" AS incoming, "out" AS outgoing FROM f',
        "collapse_sum": f'WITH {F} SELECT t, flow_id, coalesce("in", 0) + coalesce("out", 0) AS both FROM f',
        "collapse_avg_zero": f'WITH {F} SELECT t, flow_id, (coalesce("in", 0) + coalesce("out", 0)) / 2.0 AS both FROM f',
        "collapse_max": f'WITH {F} SELECT t, flow_id, greatest("in", "out") AS both FROM f',
        "collapse_propagate": f'WITH {F} SELECT t, flow_id, CASE WHEN "in" IS NOT NULL AND "out" IS NOT NULL THEN greatest("in", "out") - least("in", "out") END AS both FROM f',
        "offset_by": f"WITH {E} SELECT t, event_type, value + 10.5 AS value FROM e",
        "filter_gt": f"WITH {E} SELECT t, event_id, value FROM e WHERE value > 65",
        "clean_valid": "SELECT DISTINCT epoch_us(time) // 1000 AS t, reading_id, value FROM traffic WHERE value IS NOT NULL AND NOT isnan(value)",
        "size_valid": """SELECT name, count(*) FILTER (WHERE value <> '' AND lower(trim(value)) NOT IN ('nan', '+nan', '-nan')) AS value,
  count(*) FILTER (WHERE uptime <> '' AND lower(trim(uptime)) NOT IN ('nan', '+nan', '-nan')) AS uptime,
  count(*) FILTER (WHERE notes <> '' AND lower(trim(notes)) NOT IN ('nan', '+nan', '-nan')) AS notes, count(outages) AS outages FROM availability GROUP BY name""",
        "map_columns": f"WITH {E} SELECT t, event_id, value * 2 AS double FROM e",
        "map_rows": f"WITH {E} SELECT t, event_id, event_type || ':' || user_id AS label FROM e",
        "filter_rows": f"WITH {E} SELECT t, event_id FROM e WHERE event_type LIKE 'p%' AND user_id % 2 = 0",
        "take_global": f"WITH {E} SELECT t, event_id FROM e ORDER BY event_id LIMIT 10",
        "take_per_group": f"WITH {E} SELECT t, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 10",
        "take_per_window_group": f"WITH {E} SELECT t, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY event_type, t // 86400000 ORDER BY event_id) <= 2",
        "filter_take_count": f"""WITH {E}, x AS (SELECT * FROM e WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3)
SELECT event_type AS "group", count(*) AS size FROM x GROUP BY 1""",
        "window_counts": f"""WITH {E} SELECT '1h-' || (t // 3600000) AS "window", event_type AS "group", count(*) AS size FROM e GROUP BY 1, 2""",
        "keyed_sizes": f"WITH {E} SELECT '1d-' || (t // 86400000) || '--' || event_type AS key, count(*) AS size FROM e GROUP BY 1",
        "collect_windows": f"WITH {E} SELECT '1d-' || (t // 86400000) AS key, count(*) AS size FROM e GROUP BY 1",
        "align_linear": f"WITH {E}, {_aligned('linear', None, 3_600_000)} SELECT t, event_type, round(value, 9) AS value FROM al",
        "align_hold": f"WITH {E}, {_aligned('hold', None, 3_600_000)} SELECT t, event_type, round(value, 9) AS value FROM al",
        "align_limit": f"WITH {E}, {_aligned('linear', 2, 600_000)} SELECT t, event_type, round(value, 9) AS value FROM al",
        "rate": f"WITH {E} {_rated('e', 'value')}",
        "rate_non_negative": f"WITH {E} {_rated('e', 'value', 'CASE WHEN {r} >= 0 THEN {r} END')}",
        "align_then_rate": f"WITH {E}, {_aligned('linear', None, 3_600_000)} {_rated('al', 'value')}",
        "fill_align_rate": f"""WITH {E}, pd AS (SELECT event_id, event_type, t, last_value(g IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
c AS (SELECT * FROM pd WHERE g IS NOT NULL), {_aligned('linear', None, 21_600_000, 'g', 'c')} {_rated('al', 'g')}""",
        "as_indexed": f"WITH {E} SELECT t // 300000 * 300000 AS t, (t // 300000 + 1) * 300000 AS e, '5m-' || (t // 300000) AS k, event_id FROM e",
        "index_ranges": """WITH a AS (SELECT DISTINCT avail_id, index AS k, split_part(index, '-', 2)::BIGINT AS p FROM availability)
SELECT p * 86400000 AS t, (p + 1) * 86400000 AS e, k, avail_id FROM a""",
        "calendar_keys": f"""WITH {E}, x AS (SELECT *, make_timestamp(t * 1000) AS s FROM e)
SELECT event_id, strftime(s, '%Y-%m-%d') AS day, strftime(s, '%Y-%m') AS month, strftime(s, '%Y') AS year, strftime(s + INTERVAL 9 hour, '%Y-%m-%d') AS tokyo_day, '30s-' || (t // 30000) AS half_minute FROM x""",
        "index_lists": f"""WITH {E}, x AS (SELECT event_type, unnest(generate_series(min(t) // 86400000, max(t) // 86400000)) AS p FROM e GROUP BY event_type)
SELECT event_type, '1d-' || p AS k FROM x""",
        "range_extents": f"WITH {E} SELECT event_type, min(t) AS begin_ms, max(t) AS end_ms FROM e GROUP BY event_type",
        "range_algebra": f"""WITH {O}, x AS (SELECT outage_id, b, e, lag(b) OVER w AS pb, lag(e) OVER w AS pe FROM o WHERE b <= e WINDOW w AS (PARTITION BY name ORDER BY b, e, outage_id)),
y AS (SELECT *, pe < b OR pb > e AS disjoint FROM x WHERE pb IS NOT NULL)
SELECT outage_id, pb <= b AND pe >= e AS contains, b <= pb AND e >= pe AS within, (pb <= b AND pe >= b) <> (pb <= e AND pe >= e) AS overlaps, disjoint, pb = b AND pe = e AS equal,
  CASE WHEN NOT disjoint THEN greatest(b, pb) END AS cb, CASE WHEN NOT disjoint THEN least(e, pe) END AS ce, greatest(e, pe) AS xe, e - b AS ms FROM y""",
        "merge_series": f"""WITH {F} SELECT t, name, arg_max("in", flow_id) FILTER (WHERE "in" IS NOT NULL) AS "in", arg_max("out", flow_id) FILTER (WHERE "out" IS NOT NULL) AS "out"
FROM f WHERE "in" IS NOT NULL OR "out" IS NOT NULL GROUP BY t, name""",
        "sum_series": f"WITH {E}, {_HOURS} SELECT t, e, k, sum(n)::BIGINT AS n FROM h GROUP BY t, e, k",
        "combine_avg": f"WITH {E}, {_HOURS} SELECT t, e, k, round(avg(n), 9) AS n, round(avg(value), 9) AS value FROM h GROUP BY t, e, k",
        "combine_last": f"WITH {E}, {_HOURS} SELECT t, e, k, arg_max(value, event_type) AS value FROM h GROUP BY t, e, k",
        "reduce_list": f"WITH {E}, {_HOURS} SELECT t, e, k, arg_max(n, event_type) AS n, arg_max(value, event_type) AS value FROM h GROUP BY t, e, k",
        "dedup_last": f"""WITH {F} SELECT t, name, max(flow_id) AS flow_id, arg_max("in", flow_id) FILTER (WHERE "in" IS NOT NULL) AS "in", arg_max("out", flow_id) FILTER (WHERE "out" IS NOT NULL) AS "out" FROM f GROUP BY t, name""",
        "duplicate_keys": f"WITH {F} SELECT name, t, count(*) AS n FROM f GROUP BY name, t HAVING count(*) > 1",
        "rows_by_key": """WITH a AS (SELECT DISTINCT avail_id, name, index, uptime, value, outages FROM availability) SELECT index AS key, count(*) AS n, min(avail_id) AS first_id FROM a GROUP BY index""",
        "columns_as_lists": """WITH a AS (SELECT DISTINCT avail_id, name, index, outages FROM availability)
SELECT name, string_agg(avail_id::VARCHAR, ',' ORDER BY avail_id) AS ids, string_agg(coalesce(outages::VARCHAR, '-'), ',' ORDER BY avail_id) AS outs FROM a GROUP BY name""",
        "crop": f"""WITH {E}, {_POS}, lo AS {_bisect(_SPAN[0])}, q AS (SELECT p.*, lo.found AS lo FROM p JOIN lo USING (event_type) WHERE pos >= lo.found),
hi AS {_bisect(_SPAN[1]).replace("FROM p ", "FROM q ")} SELECT t, event_id FROM q JOIN hi USING (event_type) WHERE pos < hi.found""",
        "between": f"WITH {E} SELECT t, event_id FROM e WHERE t BETWEEN {_SPAN[0]} AND {_SPAN[1]}",
        "span_scan": f"WITH {E} SELECT t, event_id FROM e WHERE t BETWEEN {_SPAN[0]} AND {_SPAN[1]}",
        "slice_positions": f"WITH {E}, {_POS} SELECT t, event_id FROM p WHERE pos >= 5 AND pos < 105",
        "slice_from_end": f"WITH {E}, {_POS} SELECT t, event_id FROM p WHERE pos >= n - 20 AND pos < n - 10",
        "at_time": f"WITH {E}, {_POS}, b AS {_bisect(str(_PROBE))} SELECT t, event_id FROM p JOIN b USING (event_type) WHERE pos = found",
        "as_of": f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type = 'click'),
m AS (SELECT p.user_id, p.event_id, coalesce(
    max(CASE WHEN c.t <= p.t THEN (c.t, c.event_id) END), min((c.t, c.event_id))) AS hit FROM p LEFT JOIN c ON c.user_id = p.user_id GROUP BY p.user_id, p.event_id)
SELECT user_id, event_id, (hit)[2] AS click_id, (hit)[1] AS click_t FROM m""",
        "bisect_pos": f"WITH {E}, {_POS} SELECT event_type, found AS pos FROM {_bisect(str(_PROBE))}",
        "at_position": f"WITH {E}, {_POS} SELECT t, event_id FROM p WHERE pos = 7 UNION ALL SELECT t, event_id FROM p WHERE pos = n - 3",
        "first_last": f"WITH {E}, {_POS} SELECT t, event_id FROM p WHERE pos = 0 UNION ALL SELECT t, event_id FROM p WHERE pos = n - 1",
        "at_key": "SELECT DISTINCT 14641 * 86400000::BIGINT AS t, 14642 * 86400000::BIGINT AS e, index AS k, avail_id FROM availability WHERE index = '1d-14641'",
        "sort_by_value": f"WITH {E} SELECT t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS pos FROM e",
        "nice_index": f"""WITH {E}, x AS (SELECT *, make_timestamp(t * 1000) AS s FROM e)
SELECT event_id, strftime(s, '%Y-%m-%d') AS k, strftime(s, '%B %-d %Y') AS nice FROM x UNION ALL SELECT event_id, strftime(s, '%Y-%m'), strftime(s, '%B') FROM x
UNION ALL SELECT event_id, strftime(s, '%Y'), strftime(s, '%Y') FROM x UNION ALL SELECT event_id, '1h-' || (t // 3600000), '1h-' || (t // 3600000) FROM x""",
        "time_text": f"WITH {E} SELECT event_id, strftime(make_timestamp(t * 1000), '%a, %d %b %Y %H:%M:%S UTC') AS said FROM e",
        "month_shift": f"""WITH {E} SELECT event_id, epoch_us(make_timestamp(t * 1000) + INTERVAL 1 month) // 1000 AS later, epoch_us(make_timestamp(t * 1000) - INTERVAL 11 month) // 1000 AS sooner FROM e""",
        "wire_points": """WITH a AS (SELECT DISTINCT avail_id, index, value, outages FROM availability)
SELECT '["' || index || '",' || avail_id || ',' || coalesce(to_json(value)::VARCHAR, 'null') || ',' || coalesce(outages::VARCHAR, 'null') || ']' AS point FROM a""",
        "series_points_wire": """WITH x AS (SELECT batch_id, unnest(points) AS p FROM series_points)
SELECT '[' || (epoch_us(p['time']) // 1000) || ',' || batch_id || ',' || p['value'] || ']' AS point FROM x WHERE p['time'] IS NOT NULL AND p['value'] IS NOT NULL AND NOT isnan(p['value'])""",
        "wire_round_trip": f"WITH {E} SELECT user_id::VARCHAR AS name, t, event_id, value, event_type FROM e",
        "stream_update": f"WITH {E} SELECT '1d-' || (t // 86400000) AS k, event_type AS grp, {_STATS} FROM e GROUP BY 1, 2",
        "stream_discard": f"""WITH {E}, x AS (SELECT t // 86400000 AS p, value FROM e)
SELECT '1d-' || p AS k, round(avg(value), 9) AS avg_value, count(*) AS n FROM x WHERE (p + 1) * 86400000 <= (SELECT max(t) FROM e) GROUP BY p""",
        "stream_flush": f"WITH {E} SELECT strftime(make_timestamp(t * 1000), '%Y-%m') AS k, event_type AS grp, round(avg(value), 9) AS avg_value, count(*) AS n FROM e GROUP BY 1, 2",
        "stream_rate": f"WITH {E} {_rated('e', 'value')}",
        "stream_align": f"WITH {E}, {_aligned('linear', None, 3_600_000)} SELECT t, event_type, round(value, 9) AS value FROM al",
        "stream_take": f"WITH {E} SELECT t, event_id, event_type FROM e QUALIFY row_number() {W} <= 10",
        "stream_fill_pad": _fill("pad", None),
    }
    for m in ("zero", "pad", "linear"):
        sql[f"fill_{m}"] = _fill(m, None)
        sql[f"fill_{m}_limit"] = _fill(m, 2 if m == "linear" else 1)
    for name, at in (("lag", "b"), ("center", "(b + e) // 2"), ("lead", "e")):
        sql[f"as_events_{name}"] = f"WITH {O} SELECT DISTINCT {at} AS t, outage_id FROM o"
    for name, back in (("front", 0), ("center", 1_800_000), ("behind", 3_600_000)):
        sql[f"as_time_ranges_{name}"] = f"WITH {E} SELECT t - {back} AS t, t - {back} + 3600000 AS e, event_id FROM e"
    return sql
