"""Distributed exact statistics against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.catalog import QUERIES, explore
from gridrisk.catalog import community as CC
from gridrisk.catalog.registry import Inputs
from gridrisk.functions.quantiles import exact_medians, exact_quantiles
from gridrisk.operators import explore as E
from gridrisk.operators import model as M


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 else f"k{i % 40}"
        rows.append((key, rng.lognormvariate(0, 2), float(rng.randint(0, 5)), None if i % 5 == 0 else rng.random()))
    rows += [(None, 1.0, None, 2.0), (None, 3.0, None, float("nan"))]
    return rows, spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(7).persist()


@pytest.mark.parametrize(("accuracy", "direct"), [(100, 0), (100, 104), (10_000, 0), (10_000, 100_000)])
def test_grouped_quantiles(skewed, accuracy, direct):
    """``direct`` 0 brackets every group, 104 lies between the groups; accuracy 100 makes sketches coarse."""
    rows, df = skewed
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r.k, r["name"]): (r.n, r.q) for r in exact_quantiles(df, ["a", "b", "c"], probs, ["k"], accuracy, direct).collect()}
    keys = {r[0] for r in rows}
    for k in keys:
        for i, name in enumerate("abc", start=1):
            vals = [r[i] for r in rows if r[0] == k and r[i] is not None and not math.isnan(r[i])]
            if not vals:
                assert (k, name) not in got
                continue
            n, q = got[(k, name)]
            assert n == len(vals)
            assert np.allclose(q, np.quantile(vals, probs), rtol=0, atol=1e-9)


@pytest.mark.parametrize("direct", [0, 6001, 6002])
def test_global_median(skewed, direct):
    rows, df = skewed
    row = exact_medians(df, {"m": "a"}, accuracy=100, direct=direct).first()
    assert row.m == pytest.approx(np.median([r[1] for r in rows]), abs=1e-12)


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e-6])
def test_percentile_rank(spark, scale):
    rng = random.Random(3)
    scores = [round(rng.gauss(50, 10), 1) * scale for _ in range(800)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(scores)], "geo_id string, community_risk_prior_score double")
    got = {r.geo_id: r.risk_percentile for r in M.risk_percentile(df).collect()}
    for i, s in enumerate(scores):
        assert got[str(i)] == pytest.approx(sum(x < s for x in scores) / (len(scores) - 1))


def _km(a, b):
    (la, lo), (lb, lp) = a, b
    p, q = math.radians(la), math.radians(lb)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("lat_range,lon_range", [((30, 36), (-100, -95)), ((68, 76), (10, 40)), ((-3, 3), (176, 184)), ((85, 90), (-180, 180))])
def test_nearby_devices_against_all_pairs(spark, lat_range, lon_range):
    rng = random.Random(11)

    def place():
        lon = rng.uniform(*lon_range)
        return rng.uniform(*lat_range), lon - 360 if lon > 180 else lon

    homes = [(str(i), *place()) for i in range(60)]
    spots = [place() for _ in range(80)]
    devices = [(*rng.choice(spots), rng.randint(0, 100), rng.random() < 0.3, rng.random() < 0.5) for _ in range(400)]
    got = M.join_nearby_devices(
        spark.createDataFrame(homes, "geo_id string, lat double, lon double"),
        spark.createDataFrame(devices, "lat double, lon double, risk_score int, default_creds_indicator boolean, has_tls boolean"),
        120.0,
    ).collect()
    assert len(got) == len(homes)
    for r in got:
        near = [d for d in devices if _km((r.lat, r.lon), d[:2]) <= 120.0]
        assert r.nearby_observed_exposure_count == len(near)
        if near:
            assert r.nearby_avg_device_risk == pytest.approx(sum(d[2] for d in near) / len(near))
            assert r.nearby_high_severity_count == sum(d[2] >= 60 for d in near)


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,), (10.0,), (None,)], "v double")
    assert [r.rows for r in E.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 2]


def test_deciles_share_bins_for_ties(spark):
    df = spark.range(100).select(
        F.when(F.col("id") < 15, 1.0).otherwise(F.col("id").cast("double")).alias("median_household_income"),
        F.col("id").cast("double").alias("solar_candidate_share"),
    )
    bins = {r.income_decile: r.median_share for r in E.income_deciles(df).collect()}
    assert bins[1] == 7.0 and 10 in bins


def test_kmeans_labels_follow_scores(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("geo_id"),
        ((F.col("id") % 5) * 10 + F.rand(1)).alias("community_risk_prior_score"),
        *[((F.col("id") % 5) + F.rand(i) / 10).alias(c) for i, c in enumerate(M.CLUSTER_FEATURES)],
    )
    named = M.cluster_rank(M.kmeans_tiers(df, restarts=3))
    means = named.groupBy("risk_cluster", "risk_cluster_label").agg(F.avg("community_risk_prior_score").alias("m")).orderBy("risk_cluster").collect()
    assert [r.risk_cluster_label for r in means] == ["MINIMAL", "LOW", "MODERATE", "ELEVATED", "CRITICAL"]
    assert [r.m for r in means] == sorted(r.m for r in means)
    assert named.count() == 300


def test_brackets_reach_the_values_without_a_shuffle(spark):
    df = spark.range(2000).select((F.col("id") % 997).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for by in ([], ["g"]):
            found = exact_quantiles(df, ["v"], [0.5], by=by, direct=0)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan
            assert found.count() == (3 if by else 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_baseline_models_score_once_and_keep_every_pair(spark, tmp_path, monkeypatch):
    # Order 5 stands three times, order 7 twice, 11 has no key.
    keys = [*range(1, 60), 5, 5, 7, None]
    orders = spark.createDataFrame(
        [(k, 1 + i % 9, "FO"[i % 2], 1000.0 * i) for i, k in enumerate(keys)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double",
    )
    parts = spark.range(1, 20).select(F.col("id").alias("p_partkey"), F.lit("p").alias("p_name"))
    lines = spark.range(1, 80).select(
        (F.col("id") % 20).alias("l_partkey"), F.col("id").alias("l_suppkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")
    )
    for name, rows in (("orders", orders), ("part", parts), ("lineitem", lines)):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, scored, calls = [], CC.scored, []
    monkeypatch.setattr(M, "baseline_models", lambda data, label, features: seen.append((data, label, features)) or data)
    monkeypatch.setattr(CC, "scored", lambda t: calls.append(1) or scored(t))
    QUERIES["baseline_models"](spark, str(tmp_path))
    assert len(calls) == 1
    data, label, features = seen[0]
    t = Inputs(spark, str(tmp_path))
    labels = M.weak_labels(explore.near(t)).select("geo_id", "label_exposed")
    wanted = labels.join(scored(t).select("geo_id", *features), "geo_id").select("geo_id", label, *features)
    rows = wanted.collect()
    assert sorted(map(repr, data.select("geo_id", label, *features).collect())) == sorted(map(repr, rows))
    assert max(Counter(r.geo_id for r in rows).values()) == 9


def test_baseline_models_learn_from_bounded_files(spark, monkeypatch):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("geo_id"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 2 + F.rand(1) / 4).alias("a"),
        F.rand(2).alias("b"),
    )
    bounds, write = [], M.write_table
    monkeypatch.setattr(M, "write_table", lambda df, path, **how: bounds.append(how) or write(df, path, rows_per_file=50))
    found = {r.model: r.held_out_auc for r in M.baseline_models(df, "label", ["a", "b"]).collect()}
    assert set(found) == {"boosted_trees", "logistic"} and min(found.values()) > 0.85
    assert len(bounds) == 1 and bounds[0]["rows_per_file"] > 0


def test_rows_per_file(spark, tmp_path):
    back = M.write_table(spark.range(100).coalesce(1), str(tmp_path / "t"), rows_per_file=30)
    assert len(back.inputFiles()) == 4 and back.count() == 100
