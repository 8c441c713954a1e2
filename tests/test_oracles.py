"""Registered queries against their SQL on the smallest tables (tools/check.py runs all of them)."""

import pytest

from barloom import catalog

from .conftest import SF_DIR

catalog.load()
FAST = [
    "src_klines_json", "src_tape_strict", "src_snapshot_log", "clean_bars", "fill_small_gaps", "feed_sanity", "pit_eligibility", "universe_topn",
    "join_asof_backward", "ind_ema_macd", "wt_ensemble", "wt_decision", "acct_transition", "acct_band_hold", "vol_overlay", "pf_cap_waterfill",
    "pf_weight_turnover", "dd_throttle", "agg_summary", "agg_regime_perf", "agg_trim_grid", "bs_stationary_idx", "bs_shuffle", "rg_stress",
    "st_calendar", "agg_forward_performance", "au_lifecycle", "au_classify_evidence", "au_hash_chain", "au_running_balance", "grade_overall",
    "set_union_append", "st_tumbling", "st_sleeve_state",
]


def _cells(rows):
    return sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [[row[names.index(c)] for c in cols] for row in cur.fetchall()]
    got = [[row[c] for c in cols] for row in df.collect()]
    assert _cells(got) == _cells(want)


def test_registry_is_complete():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert rows_only == {"wf_select_nested", "mt_bayes_sharpe"}
