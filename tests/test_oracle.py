"""Registered queries against their SQL on the smallest tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
# stages whose SQL or model fit takes long are compared by tools/check_oracle.py only
SLOW = {"q14_grid_suite", "g10_village_profile", "g11_cells_per_village", "g25_assignment_modes", "m10_permutation_importance", "m12_batch_scoring", "m13_grid_scoring", "m11_ablation",
        "e28_logistic_diagnostic", "k09_model_store", "j08_prediction_attach", "g09_village_rainfall_hot_groups", "m05_quantile_forest", "m05_quantile_forest_humidity", "m05_interval_invariants", "m06_logistic_rain", "m07_boosted_rain", "m04_residual_model",
        "m10_feature_importance", "m10_shapley_attribution", "m10_shapley_sums", "m04_residual_model_humidity", "q23_prediction_sanity_humidity", "m07_probability_bounds", "q23_prediction_sanity", "m03_grid_features", "j19_village_view_join", "w10_rain_series", "v07_rain_timeline", "b04_quantile_map_humidity", "g13_slope_stats", "g14_aspect_stats", "g15_ruggedness_stats"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FAST = [n for n in QUERIES if n not in SLOW]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    message, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert message.startswith(("ok", "rows-only")), message


def test_entry(spark):
    assert entry.entry(spark).count() == 12


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
