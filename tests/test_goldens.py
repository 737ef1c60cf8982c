"""Hand-computed results."""

import pytest
from pyspark.sql import functions as F

from gridrisk.functions import text as X
from gridrisk.functions.geo import is_critical_region, region_capacity, state_weight, zip3_state
from gridrisk.functions.numeric import half_even
from gridrisk.operators import devices as D
from gridrisk.operators import explore as E
from gridrisk.operators import threat as T
from gridrisk.operators import vulnerabilities as V

DEVICE = (
    "ip string, port int, vendor string, country string, has_tls boolean, has_modbus boolean, has_mqtt boolean, "
    "default_creds_indicator boolean, firmware_version string, ingest_seq long"
)


def values(spark, column, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {column}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_device_goldens(spark):
    rows = [
        ("1.2.3.4", 80, "Growatt", "DE", False, False, False, True, "3.2.1", 1),
        ("5.6.7.8", 80, "SolarView", "JP", False, False, False, False, "v6.0", 2),
        ("9.10.11.12", 1883, "Sungrow", "IT", False, False, True, False, "WiNet v1.1.0", 3),
        ("13.14.15.16", 443, "SMA", "US", True, False, False, False, "4.1.0", 4),
    ]
    scored = D.score_devices(spark.createDataFrame(rows, DEVICE)).orderBy("ingest_seq").collect()
    assert [(r.risk_score, r.risk_severity) for r in scored] == [(78, "HIGH"), (55, "MEDIUM"), (74, "HIGH"), (40, "MEDIUM")]
    assert scored[1].matched_cves == ["CVE-2022-29303", "CVE-2023-23333"]
    assert scored[0].matched_cves == []
    assert scored[0].risk_components.cve == 24.0


def test_unknown_vendor_and_empty_firmware(spark):
    rows = [("a", 1, "Acme", None, None, None, None, None, None, 1), ("b", 1, "", "DE", True, False, False, False, "", 2)]
    scored = D.score_devices(spark.createDataFrame(rows, DEVICE)).orderBy("ingest_seq").collect()
    # 0.09 + 0 + 0.15 + 0 + 0.05 + 0.015 and 0.09 + 0 + 0 + 0 + 0.05 + 0.05
    assert [r.risk_score for r in scored] == [30, 19]


def test_fleet_golden(spark):
    def fleet(n, vendor, country, creds, score, severity):
        return spark.range(n).select(
            F.lit(vendor).alias("vendor"), F.lit(country).alias("country"), F.lit(False).alias("has_tls"),
            F.lit(creds).alias("default_creds_indicator"), F.lit(score).alias("risk_score"), F.lit(severity).alias("risk_severity"),
        )

    devices = (
        fleet(500, "Growatt", "DE", True, 85, "CRITICAL")
        .unionByName(fleet(800, "SolarView", "JP", False, 90, "CRITICAL"))
        .unionByName(fleet(300, "Sungrow", "IT", False, 70, "HIGH"))
    )
    total = D.fleet_global(devices).first()
    assert (total.total_devices_found, total.total_exposed_capacity_mw) == (1600, 16.0)
    assert total.countries_at_risk == [] and total.total_default_creds == 500
    japan = D.fleet_by_country(devices).filter("country = 'JP'").first()
    assert (japan.exposed_capacity_mw, japan.solar_gw, japan.pct_of_grid, japan.risk_label) == (8.0, 10.0, 0.08, "MEDIUM")
    assert japan.vendors == {"SolarView": 800}


def test_exposure_edges_are_strict(spark):
    rows = spark.createDataFrame([(1, 20000, 10.0), (2, 5000, 10.0), (3, 20001, 10.0), (4, 5, 0.0)], "i int, n int, gw double")
    out = [(r.risk_label, r.destabilization_risk) for r in D.exposure_impact(rows, "n", "gw").orderBy("i").collect()]
    assert out == [("HIGH", False), ("MEDIUM", False), ("CRITICAL", True), ("MEDIUM", False)]


def test_zip_and_geo_keys(spark):
    zips = values(spark, "v string", ["7001", "94528-1234", "abc", None], X.norm_zip(F.col("v")))
    assert zips == ["07001", "94528", "", ""]
    assert values(spark, "v string", ["12", "123456", None], X.pad_geo_id(F.col("v"))) == ["00012", "123456", None]
    assert values(spark, "v string", ["07001", "94528", "00999", "10001", "x1234", "96999"], zip3_state(F.col("v"))) == [
        None, "CA", None, "NY", None, None,
    ]
    assert values(spark, "v string", ["07001"], zip3_state(F.col("v"), fill_gaps=True)) == ["NJ"]
    assert values(spark, "v string", ["CA", "WV", None], state_weight(F.col("v"))) == [1.0, 0.1, 0.1]


def test_regions(spark):
    assert values(spark, "v string", ["DE", "CA", "US", None], region_capacity(F.col("v"))) == [90.0, 50.0, 10.0, 10.0]
    assert values(spark, "v string", ["DE", "CA", "TX", "PL", None], is_critical_region(F.col("v"))) == [True, True, True, False, False]


def test_numbers(spark):
    out = values(spark, "v string", ["12", " 1.5e3 ", "12d", "1f", "nan", "", None, "-3.", "x"], X.to_number(F.col("v")))
    assert out == [12.0, 1500.0, None, None, None, None, None, -3.0, None]
    assert values(spark, "v double", [0.125, 0.375, 1.015], half_even(F.col("v"), 2)) == [0.12, 0.38, 1.01]


def test_whole_words_and_titles(spark):
    from gridrisk.constants import RELEVANT_TERMS

    out = values(spark, "v string", ["smart", "sma_x", "SMA x", "sunny portal", None], X.is_relevant_text(F.col("v"), RELEVANT_TERMS))
    assert out == [False, False, True, True, False]
    assert values(spark, "v string", ["sma_x", "acme corp", "3com", ""], X.title_case(F.col("v"))) == ["Sma_X", "Acme Corp", "3Com", ""]


def test_cpe(spark):
    out = values(spark, "v string", ["a:b:c:d:e", "cpe:2.3:a::p:*", ""], V.cpe_parse(F.col("v")))
    assert [tuple(r) for r in out] == [(None, None), (None, "p"), (None, None)]


def test_tier_edges(spark):
    out = values(spark, "v double", [0.0, 55.0, 63.0, 70.0, 100.0, 100.1], E.tier_cut(F.col("v")))
    assert [None if v is None else v.split(" (")[0] for v in out] == [None, "Low", "Medium", "High", "Very High", None]


def test_empty_corpus_pressure(spark):
    products = spark.createDataFrame([], "cve_id string, vendor string, product string, is_vulnerable int")
    cves = spark.createDataFrame([], "cve_id string, cvss_score double, cisa_kev int, description string")
    row = T.base_pressure(products, cves).first()
    assert row.base_pressure == 50.0 and row.solar_cve_count is None


@pytest.mark.parametrize(
    "text,expected",
    [("Firmware: v3.2.1", "3.2.1"), ("version 2.0 fw 9", "2.0"), ("nothing", None), ("FW/1.4", "1.4")],
)
def test_firmware_patterns(spark, text, expected):
    from gridrisk.functions.matching import firmware_version

    none = F.lit(None).cast("string")
    assert values(spark, "v string", [text], firmware_version(F.col("v"), none, none)) == [expected]
    # The banner is tried with every pattern before the headers are looked at.
    assert values(spark, "v string", ["fw 7.7"], firmware_version(F.col("v"), F.lit("firmware 1.0"), none)) == ["7.7"]
