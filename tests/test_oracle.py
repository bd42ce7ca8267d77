"""Queries against their SQL in DuckDB over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from pitchlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = """rank_by_record unpivot_long perspective_results window_365 inactive_180 team_stats_e2 recency_weights off_def_raw adjusted_goals
shrink_e1 robust_scale minmax logistic_norm percent_rank_average history_enriched sos_relax_3 rank_state power_e2 components degree
set_except semi_join_master match_type_report top3_opponents conflicts running_win_pct calibration_bins metric_lag config_compare
quality_bronze numeric_coercion events_hourly norm_canonical norm_aggressive club_norm extract_fields token_jaccard alias_cache
anti_join_new mapping_audit team_id containment_search master_from_games division_registry
norm_light norm_prefixed norm_club elo_batched_3 elo_schedule_batched power_e1 power_e1_iterative prediction_auc calibration_fit national_columns
national_format connectivity_report tail_split perf_adjust sos_baseline rank_six_keys slice_rankings slice_index selector_params overlap_analysis
sos_relax_converged club_heuristic unmatched_categories alias_replace""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (decimal.Decimal, float, int)):
        return None if v != v else round(float(v), 5)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19].removesuffix(" 00:00:00")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names, data = [c[0] for c in want.description], want.fetchall()
    a_names, a = rows(df.columns, [tuple(r) for r in df.collect()])
    b_names, b = rows(names, data)
    assert a_names == b_names
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=2e-5)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
