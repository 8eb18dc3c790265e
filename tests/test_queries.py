"""Queries against their DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = ["rollup_fixed_1d", "rollup_monthly_angeles", "group_window_agg", "agg_reducers", "agg_policies", "percentile_methods", "take_per_window_group", "fill_pad_limit", "fill_linear_limit", "align_limit", "rate_non_negative", "fill_align_rate", "merge_series", "combine_avg", "dedup_last", "crop", "slice_from_end", "as_of", "range_algebra", "index_ranges", "nice_index", "wire_points", "wire_round_trip", "stream_update", "event_bag", "appended", "pipeline_builder", "map_pairs", "user_reducer", "event_keys", "iterated", "encoded", "range_values", "fill_linear_many", "duplicates", "refused", "push_fill_linear", "stream_fill_linear", "push_counts", "stream_late", "p1_found", "p2_found", "p2_periods", "p3_found", "p3_regular", "p5_percentiles", "p5_merged_days"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(FOLDER).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
