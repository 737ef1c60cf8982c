"""Clusters, labels, composite scores, baselines and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridrisk import constants as C
from gridrisk.functions.geo import KM_PER_DEGREE, haversine_km
from gridrisk.functions.matching import first_match
from gridrisk.functions.numeric import as_count, half_even, or_zero, with_one_row
from gridrisk.functions.quantiles import exact_medians
from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table

CLUSTER_FEATURES = [
    "single_family_share", "owner_occupancy_rate", "solar_candidate_share",
    "income_solar_interaction", "age_risk_factor", "high_value_share", "state_solar_weight",
    "median_property_age",
]


def median_impute(df: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """Null → exact column median, for several columns in one pass."""
    medians = exact_medians(df, {f"_m_{c}": c for c in columns})
    wide = with_one_row(df, medians)
    return wide.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).select(*df.columns)


def kmeans_tiers(df: DataFrame, k: int = 5, seed: int = 42, restarts: int = 10,
                 columns: Sequence[str] = CLUSTER_FEATURES, parallel: int = 4) -> DataFrame:
    """Standardised k-means with restarts; the lowest-cost model assigns ``cluster_id``.

    The scaled vectors are written once and every restart reads them; a few restarts run at the
    same time. Scaling by the sample instead of the population deviation multiplies every feature
    by the same factor, so clusters are the same.
    """
    spark = df.sparkSession
    filled = median_impute(df.withColumns({f"_f_{c}": F.col(c) for c in columns}), [f"_f_{c}" for c in columns])
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="_raw").transform(filled)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(vectors)
    scaled = scaler.transform(vectors).select(*df.columns, "_x")
    points = write_table(scaled, scratch_path(spark, "cluster-points"))

    def fit(restart: int):
        learner = KMeans(k=k, seed=seed + restart, featuresCol="_x", predictionCol="cluster_id")
        return learner.fit(points.select("_x"))

    with ThreadPool(parallel) as pool:
        models = pool.map(fit, range(restarts))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(points).drop("_x")


def cluster_rank(df: DataFrame, k: int = 5) -> DataFrame:
    """Clusters ranked by mean score ascending, with their labels.

    The window covers the k cluster means only.
    """
    means = df.groupBy("cluster_id").agg(F.avg("community_risk_prior_score").alias("m"))
    ranked = means.withColumn(
        "risk_cluster", F.row_number().over(Window.orderBy("m", "cluster_id")) - 1
    ).select("cluster_id", "risk_cluster")
    label = first_match(
        [(F.col("risk_cluster") == i, F.lit(name)) for i, name in enumerate(C.CLUSTER_LABELS[:k])],
        F.lit(None).cast("string"),
    )
    return df.join(ranked, "cluster_id", "left").withColumn("risk_cluster_label", label)


def cluster_rank_raw(df: DataFrame) -> DataFrame:
    """Variant that keeps the raw id and labels clusters by mean score descending."""
    means = df.groupBy("cluster_id").agg(F.avg("community_risk_prior_score").alias("m"))
    ranked = means.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("m"), "cluster_id")) - 1)
    labels = list(reversed(C.CLUSTER_LABELS))
    label = first_match([(F.col("_r") == i, F.lit(n)) for i, n in enumerate(labels)], F.lit(None).cast("string"))
    named = ranked.withColumn("risk_cluster_label", label).select("cluster_id", "risk_cluster_label")
    return df.join(named, "cluster_id", "left").withColumn("risk_cluster", F.col("cluster_id"))


PROFILE_MEANS = {
    "avg_risk_score": "community_risk_prior_score",
    "avg_solar_readiness": "solar_readiness_score",
    "avg_cyber_pressure": "solar_cyber_pressure_score",
    "avg_sf_share": "single_family_share",
    "avg_owner_rate": "owner_occupancy_rate",
    "avg_solar_candidate": "solar_candidate_share",
    "avg_income_interaction": "income_solar_interaction",
    "avg_age_factor": "age_risk_factor",
    "avg_state_weight": "state_solar_weight",
}


def cluster_profiles(df: DataFrame, digits: int | None = 3) -> DataFrame:
    means = df.groupBy("risk_cluster").agg(
        F.first("risk_cluster_label", ignorenulls=True).alias("label"),
        F.count("geo_id").alias("count"),
        *[half_even(F.avg(c), digits).alias(n) for n, c in PROFILE_MEANS.items()],
    )
    medians = exact_medians(
        df, {"median_home_value": "median_home_value", "median_income": "median_household_income"}, by=["risk_cluster"]
    )
    rounded = medians.select(
        "risk_cluster", *[half_even(F.col(c), digits).alias(c) for c in ("median_home_value", "median_income")]
    )
    return means.join(rounded, "risk_cluster", "left")


# --- observed devices near communities -----------------------------------------------------
def device_positions(devices: DataFrame) -> DataFrame:
    """Devices summed per exact position: geolocation gives many devices one position."""
    return (
        devices.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("lat", "lon")
        .agg(
            F.count(F.lit(1)).alias("devices"),
            F.sum("risk_score").alias("score_sum"),
            as_count(F.col("default_creds_indicator")).alias("creds"),
            as_count(~F.coalesce(F.col("has_tls"), F.lit(False))).alias("no_tls"),
            as_count(F.col("risk_score") >= 60).alias("high"),
        )
    )


def join_nearby_devices(communities: DataFrame, devices: DataFrame, radius_km: float) -> DataFrame:
    """Device counts and rates within a radius of each community centroid.

    Positions and communities meet in latitude/longitude cells at least a radius wide; every
    community looks at its own cell and the neighbours. Both sides are reduced to distinct
    positions first, and only sums travel on, so a crowded place stays one row per side.
    """
    cell_lat = radius_km / KM_PER_DEGREE
    places = communities.select("lat", "lon").distinct()
    own = F.floor(F.col("lat") / F.lit(cell_lat))

    def reach(band: Column) -> Column:
        """Cell width in degrees of longitude: the radius at the band's far edge, with a margin."""
        edge = F.greatest(F.abs(band), F.abs(band + 1)) * F.lit(cell_lat)
        return F.when(edge >= 87, F.lit(360.0)).otherwise(F.lit(1.01 * cell_lat) / F.cos(F.radians(edge)))

    points = (
        device_positions(devices)
        .withColumnsRenamed({"lat": "d_lat", "lon": "d_lon"})
        .withColumn("band", F.floor(F.col("d_lat") / F.lit(cell_lat)))
        .withColumn("cell", F.floor(F.col("d_lon") / reach(F.col("band"))))
    )
    # Cells belong to the device's band; the wider of the two widths covers the radius, also
    # across the date line.
    around = (
        places.withColumn("own_reach", reach(own))
        .withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
        .withColumn("width", reach(F.col("band")))
        .withColumn("half", F.greatest("own_reach", "width"))
        .withColumn("span", F.ceil(F.col("half") / F.col("width")))
    )
    lon, half, span = F.col("lon"), F.col("half"), F.col("span")
    starts = F.array_compact(
        F.array(lon, F.when(lon + half > 180, lon - 360), F.when(lon - half < -180, lon + 360))
    )
    cells = F.flatten(
        F.transform(
            starts,
            lambda x: F.sequence(F.floor(x / F.col("width")) - span, F.floor(x / F.col("width")) + span),
        )
    )
    probes = around.select("lat", "lon", "band", F.explode(F.array_distinct(cells)).alias("cell"))
    near = (
        probes.join(points, ["band", "cell"])
        .filter(haversine_km(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon")) <= radius_km)
        .groupBy("lat", "lon")
        .agg(*[F.sum(c).alias(c) for c in ("devices", "score_sum", "creds", "no_tls", "high")])
    )
    out = communities.join(near, ["lat", "lon"], "left")

    def rate(column: str) -> Column:
        return F.try_divide(F.col(column).cast("double"), F.col("devices"))

    return out.select(
        *communities.columns,
        F.coalesce("devices", F.lit(0)).alias("nearby_observed_exposure_count"),
        rate("score_sum").alias("nearby_avg_device_risk"),
        rate("creds").alias("nearby_default_creds_rate"),
        rate("no_tls").alias("nearby_no_tls_rate"),
        F.coalesce("high", F.lit(0)).alias("nearby_high_severity_count"),
    )


def weak_labels(near: DataFrame, min_high: int = 2) -> DataFrame:
    """Exposure labels from nearby observations."""
    return near.withColumns(
        {
            "label_exposed": (F.col("nearby_observed_exposure_count") > 0).cast("int"),
            "label_high_risk": (F.col("nearby_high_severity_count") >= min_high).cast("int"),
        }
    )


def risk_density_target(near: DataFrame, homes: str = "total_housing_units") -> DataFrame:
    """Observed risk score per 1,000 homes."""
    observed = F.col("nearby_observed_exposure_count") * or_zero(F.col("nearby_avg_device_risk"))
    return near.withColumn("risk_density", F.try_divide(1000 * observed, F.nullif(F.col(homes), F.lit(0.0))))


def two_stage_risk(df: DataFrame, presence: Column, vulnerable: Column, weight: Column) -> DataFrame:
    """P(presence) × P(vulnerable | presence) × grid weight."""
    return df.withColumn("community_risk", presence * vulnerable * weight)


def three_lens_score(df: DataFrame, adoption: Column, vulnerability: Column, exposure: Column) -> DataFrame:
    return df.withColumn("community_risk_score", 0.40 * adoption + 0.35 * vulnerability + 0.25 * exposure)


def priority_score(df: DataFrame, multiplier: Column) -> DataFrame:
    return df.withColumn("priority_score", F.col("community_risk_score") * multiplier)


_BUCKETS = 256


def _score_ranks(df: DataFrame, score: str) -> DataFrame:
    """``_v, risk_percentile`` of every distinct score.

    Running counts inside buckets, plus the total of the buckets below. The bucket edges come from a
    sketch of the distinct scores, so buckets are of like depth whatever the range of the score.
    """
    distinct = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    steps = [i / _BUCKETS for i in range(1, _BUCKETS)]
    edges = distinct.agg(F.percentile_approx("_v", steps, 10_000)).scalar()
    counts = distinct.withColumn("_e", edges).withColumn(
        "_b", F.size(F.filter("_e", lambda e: e < F.col("_v")))
    ).drop("_e")
    below_in_bucket = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("_in", F.coalesce(F.sum("_c").over(below_in_bucket), F.lit(0)))
    buckets = counts.groupBy("_b").agg(F.sum("_c").alias("_n"))
    # One row per bucket.
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("_b", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"))
    total = counts.agg(F.sum("_c"))
    return inner.join(starts, "_b").select(
        "_v",
        F.coalesce(
            F.try_divide((F.col("_start") + F.col("_in")).cast("double"), total.scalar() - 1), F.lit(0.0)
        ).alias("risk_percentile"),
    )


def risk_percentile(df: DataFrame, score: str = "community_risk_prior_score") -> DataFrame:
    """Percentile rank in [0, 1] without sorting the table in one task; equal scores share a rank."""
    return df.join(_score_ranks(df, score), F.col(score) == F.col("_v"), "left").drop("_v")


def leaderboard(df: DataFrame, weights: dict[str, float], n: int = 100, top: int = 3) -> DataFrame:
    """The n best communities with percentile, rank and their largest score contributions.

    The n rows are taken first; only they meet the percentiles.
    """
    score = "community_risk_prior_score"
    best = df.orderBy(F.desc(score), "geo_id").limit(n)
    ranked = best.join(_score_ranks(df, score), F.col(score) == F.col("_v"), "left")
    parts = F.array(
        *[F.struct((F.lit(w) * or_zero(F.col(c))).alias("points"), F.lit(c).alias("feature")) for c, w in weights.items()]
    )
    ordered = F.slice(F.sort_array(parts, asc=False), 1, top)
    # The window covers the n rows kept by the limit.
    position = F.row_number().over(Window.orderBy(F.desc("community_risk_prior_score"), "geo_id"))
    return ranked.select(
        position.alias("rank"),
        "geo_id",
        "community_risk_prior_score",
        "risk_percentile",
        F.array_join(F.transform(ordered, lambda s: s["feature"]), ",").alias("top_features"),
    )


def baseline_models(df: DataFrame, label: str, features: Sequence[str], key: str = "geo_id",
                    trees: int = 10, depth: int = 3) -> DataFrame:
    """Boosted trees and a logistic baseline, judged on held-out communities.

    The split hashes the community id, so a community is always on the same side. Returns one
    row per model with its held-out area under the curve.
    """
    filled = median_impute(df, features).select(
        *features, F.col(label).cast("double").alias("label"), (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("held_out")
    )
    # Written, not cached: memory is left to what the learners cache themselves.
    written = write_table(filled, scratch_path(df.sparkSession, "baseline"), rows_per_file=250_000)
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(written).drop(*features)
    train, test = data.filter(~F.col("held_out")), data.filter("held_out")
    judge = BinaryClassificationEvaluator(labelCol="label")
    rows = []
    for name, learner in (
        ("boosted_trees", GBTClassifier(maxIter=trees, maxDepth=depth, seed=42)),
        ("logistic", LogisticRegression(maxIter=20)),
    ):
        scored = learner.fit(train).transform(test)
        rows.append((name, float(judge.evaluate(scored))))
    return df.sparkSession.createDataFrame(rows, "model string, held_out_auc double")
