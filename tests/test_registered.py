"""Registered queries against their SQL. AREAWEEK_FULL=1 runs all of them."""

import os
import sys

import pytest

import __spark_entry__ as entry_module
from areaweek import verification
from areaweek.verification.harness import compare, connect

SF = os.environ.get("AREAWEEK_SF", "/root/testdata/sf0.001")
SAMPLE = (
    "panel_slice", "panel_full", "a6_degree", "w7_true_distinct_actors", "d3_holidays", "h6_log_likelihood", "h8_intensity_features", "m12_evaluate",
    "a14_calibration_table", "w10_ranks", "b3_alert_audit", "b5_brief_lines", "k3_top_actors", "x9_fact_bundle", "x4_shared_names", "s6_page_text",
    "j6_assign_units", "j8_fill_isolated", "s3_feed_scan", "s13_upsert", "r1_topic_drain", "n12_contract_quarantine",
)
NAMES = sorted(entry_module.oracle_sql()) if os.environ.get("AREAWEEK_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(entry_module.queries()[name](spark, SF), con, entry_module.oracle_sql()[name])
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flagship(spark, con):
    assert entry_module.entry(spark).columns == ["lga_code", "week_start", "own_events_4w", "nb_events_12w", "hist_rate", "weeks_since_event", "label"]


def test_model_queries_use_the_full_settings(monkeypatch):
    """No model query narrows the defaults: settings, grid and rounds are the operators' own."""
    from areaweek.operators import model, pointprocess
    from areaweek.plans import runs
    from areaweek.verification import model_checks, process_checks

    class Reached(Exception):
        pass

    def stop(*args, **kwargs):
        raise Reached(len(args), kwargs)

    for owner, name in ((model, "fit_booster"), (model, "train"), (model, "sweep"), (runs, "train_run"), (pointprocess, "fit")):
        monkeypatch.setattr(owner, name, stop)
    for module, name, value in ((model_checks, "panel", None), (model_checks, "folded", (None, None, None)), (process_checks, "Domain", type("D", (), {"__init__": lambda *_: None, "incidents": 0, "registry": 0, "adjacency": 0}))):
        monkeypatch.setattr(module, name, lambda *_, v=value: v() if isinstance(v, type) else v)
    fits = {"m4_boosted_classifier": 2, "m5_calibration": 2, "m14_grid_sweep": 2, "s10_model_roundtrip": 2, "h7_parameter_fit": 5, "m12_model_comparison": 4, "m15_score_week": 4, "m16_tree_attributions": 4, "m19_stored_run": 4}
    for name, n in fits.items():
        with pytest.raises(Reached) as reached:
            entry_module.queries()[name](None, "")
        assert reached.value.args == (n, {}), name


def test_a_missing_dependency_leaves_the_other_queries(monkeypatch, capsys):
    for name in ("areaweek.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry_module.queries()) == set(verification.registered())
    assert set(entry_module.oracle_sql()) == set(verification.checking_sql())
    assert "areaweek.llm.queries is left out" in capsys.readouterr().err
