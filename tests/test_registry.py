"""Registered queries against their checking SQL on the smallest sample (skipped without it)."""

import sys
from pathlib import Path

import pytest

from gridrisk.catalog import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SF = Path("/root/testdata/sf0.001")
NAMES = [
    "norm_text", "enriched_parcels", "community_agg_zip", "rank_communities", "merge_kev", "explode_products", "vendor_priors",
    "global_priors", "device_score", "fleet_by_country", "fleet_global", "community_scores", "describe_features", "corr_matrix",
    "join_nearby_devices", "risk_percentile", "alert_top_n", "scan_cve_json", "sink_json",
]


@pytest.mark.skipif(not SF.exists(), reason="no sample tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    check = pytest.importorskip("check")
    ok, note = check.compare(spark, check.connect(str(SF)), str(SF), name)
    assert ok, note


def test_entry_points():
    import __spark_entry__ as entry

    queries, texts = entry.queries(), entry.oracle_sql()
    assert set(texts) <= set(queries)
    assert len(queries) >= 180
    assert set(QUERIES) <= set(queries)
    # The training-data operators come in through the entry point alone.
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in QUERIES)
