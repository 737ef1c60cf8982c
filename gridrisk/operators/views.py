"""Ranked and summarised views of the scored communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.numeric import half_even

RISK_COLUMNS = [
    "geo_id", "lat", "lon", "community_risk_prior_score", "solar_readiness_score",
    "solar_cyber_pressure_score", "solar_candidate_share", "single_family_share",
    "owner_occupancy_rate", "median_home_value", "median_household_income",
    "total_housing_units", "total_population", "high_value_share", "median_property_age",
    "state", "risk_cluster", "risk_cluster_label", "state_solar_weight",
    "income_solar_interaction", "age_risk_factor",
]
TOP_COLUMNS = [
    "geo_id", "lat", "lon", "community_risk_prior_score", "solar_readiness_score",
    "solar_candidate_share", "owner_occupancy_rate", "single_family_share", "median_home_value",
    "median_household_income", "total_housing_units",
]


def join_centroids(scores: DataFrame, centroids: DataFrame) -> DataFrame:
    """Inner join on the community id; coordinates always come from the centroids."""
    left = scores.drop(*[c for c in ("lat", "lon") if c in scores.columns])
    return left.join(centroids.select("geo_id", "lat", "lon"), "geo_id")


def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def view_risk(scores: DataFrame, centroids: DataFrame) -> DataFrame:
    joined = join_centroids(scores, centroids)
    return joined.select(*_present(joined, RISK_COLUMNS))


def view_top_zips(located: DataFrame, n: int = 25) -> DataFrame:
    """The n highest scores; ties by community id."""
    ranked = located.orderBy(F.desc("community_risk_prior_score"), "geo_id").limit(n)
    return ranked.select(*_present(ranked, TOP_COLUMNS))


def view_stats(located: DataFrame, cves: DataFrame, vendors: DataFrame, digits: int | None = 1) -> DataFrame:
    """One row of key figures over communities, curated product rows and vendor priors."""
    score = F.col("cvss_score")
    corpus = cves.groupBy("cve_id").agg(
        F.count(F.when(score >= C.CRITICAL_CVSS, 1)).alias("critical"), F.max(score).alias("top")
    ).agg(
        F.count(F.lit(1)).alias("total_cves"), F.sum("critical").alias("critical_cves"), F.max("top").alias("max_cvss")
    )
    vendor_count = vendors.agg(F.count(F.lit(1)))
    pressure = F.col("solar_cyber_pressure_score")
    clusters = []
    if "risk_cluster_label" in located.columns:
        clusters = [
            F.count(F.when(F.col("risk_cluster_label") == label, 1)).alias(label.lower() + "_count")
            for label in reversed(C.CLUSTER_LABELS)
        ]
    communities = located.agg(
        F.count(F.lit(1)).alias("total_zctas"),
        *clusters,
        half_even(F.avg("community_risk_prior_score"), digits).alias("avg_risk_score"),
        F.format_string("%.1f-%.1f", F.min(pressure), F.max(pressure)).alias("cyber_pressure_range"),
    )
    packed = corpus.select(F.struct("*")).scalar()
    return communities.withColumn("_c", packed).select(
        *communities.columns, "_c.*", vendor_count.scalar().alias("vendor_count")
    )
