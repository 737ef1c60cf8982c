"""Census-style community features, readiness and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.geo import lookup, state_weight, zip3_state
from gridrisk.functions.numeric import clip, half_even, or_zero, with_one_row
from gridrisk.functions.quantiles import exact_medians
from gridrisk.functions.text import numeric, pad_geo_id


def known(value: Column) -> Column:
    """Null in place of the missing-value sentinel."""
    return F.when(value > C.CENSUS_MISSING_BELOW, value)


def acs_features(acs: DataFrame, reference_year: int = C.REFERENCE_YEAR) -> DataFrame:
    """Shares, counts and medians per community from census-style columns (text or numbers)."""
    counts = [c for c in C.CENSUS_VARIABLES.values() if c in acs.columns]
    base = acs.withColumns({c: known(numeric(acs, c)) for c in counts})
    units = F.greatest(F.coalesce("total_housing_units", F.lit(1.0)), F.lit(1.0))
    occupied = or_zero(F.col("occupied_units"))
    detached = or_zero(F.col("single_family_detached_units"))
    shares = base.withColumns(
        {
            "parcel_count": F.col("total_housing_units"),
            "residential_parcel_count": F.col("occupied_units"),
            "single_family_count": detached,
            "single_family_share": clip(detached / units, 0.0, 1.0),
            "residential_share": clip(occupied / units, 0.0, 1.0),
            "owner_occupancy_rate": clip(
                or_zero(F.col("owner_occupied_units")) / F.greatest(occupied, F.lit(1.0)), 0.0, 1.0
            ),
            "high_value_share": F.when(
                or_zero(F.col("median_home_value")) >= C.HIGH_VALUE_HOME, F.lit(1.0)
            ).otherwise(F.lit(0.0)),
            "median_final_value": F.col("median_home_value"),
            "median_property_age": F.greatest(F.lit(float(reference_year)) - F.col("median_year_built"), F.lit(0.0)),
            "housing_density_proxy": F.col("total_housing_units"),
        }
    )
    # greatest() skips nulls, so a missing year has to stay missing.
    shares = shares.withColumn(
        "median_property_age", F.when(F.col("median_year_built").isNotNull(), F.col("median_property_age"))
    ).withColumn("solar_candidate_share", clip(F.col("single_family_share") * F.col("owner_occupancy_rate"), 0.0, 1.0))
    full = shares.withColumn(
        "solar_candidate_count", F.rint(F.col("solar_candidate_share") * units).cast("bigint")
    )
    order = [
        "geo_id", "state_fips", "name", "parcel_count", "residential_parcel_count", "single_family_count",
        "solar_candidate_count", "single_family_share", "residential_share", "owner_occupancy_rate",
        "solar_candidate_share", "high_value_share", "median_final_value", "median_home_value",
        "median_household_income", "median_year_built", "median_property_age", "total_population",
        "total_housing_units", "occupied_units", "owner_occupied_units", "renter_occupied_units",
        "single_family_detached_units", "single_family_attached_units", "housing_density_proxy",
    ]
    return full.select(*[c for c in order if c in full.columns])


def filter_inhabited(df: DataFrame) -> DataFrame:
    return df.filter(or_zero(F.col("total_housing_units")) > 0)


def filter_zip_range(df: DataFrame, low: str, high: str, column: str = "geo_id") -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def fips_state(code: Column) -> Column:
    return lookup(code, {fips: state for state, fips in C.STATE_FIPS.items()})


def state_fips(state: Column) -> Column:
    return lookup(state, C.STATE_FIPS)


def filter_state(df: DataFrame, states: list[str], column: str = "state_fips") -> DataFrame:
    """Membership of a FIPS column in a list of state abbreviations; no column, no filter."""
    if column not in df.columns:
        return df
    return df.filter(F.col(column).isin([C.STATE_FIPS[s] for s in states if s in C.STATE_FIPS]))


def geo_id_rename(df: DataFrame, key: str) -> DataFrame:
    return df.withColumnRenamed(key, "geo_id") if key != "geo_id" else df


def state_summary(features: DataFrame) -> DataFrame:
    """Per state FIPS: counts, sums, medians and mean shares, ordered by mean candidate share."""
    valid = features.filter(F.col("state_fips").isNotNull())
    sums = valid.groupBy("state_fips").agg(
        F.count("geo_id").alias("zcta_count"),
        F.coalesce(F.sum("total_housing_units"), F.lit(0.0)).alias("total_housing_units"),
        F.coalesce(F.sum("total_population"), F.lit(0.0)).alias("total_population"),
        F.avg("single_family_share").alias("avg_single_family_share"),
        F.avg("owner_occupancy_rate").alias("avg_owner_occupancy_rate"),
        F.avg("solar_candidate_share").alias("avg_solar_candidate_share"),
    )
    medians = exact_medians(
        valid,
        {"median_home_value": "median_home_value", "median_household_income": "median_household_income"},
        by=["state_fips"],
    )
    return sums.join(medians, "state_fips", "left").orderBy(F.desc("avg_solar_candidate_share"), "state_fips")


# --- first version: housing readiness and one global pressure ------------------------------
def readiness_v1(df: DataFrame) -> DataFrame:
    garage = F.col("garage_share") if "garage_share" in df.columns else F.lit(0.0)
    score = 100 * (
        0.35 * or_zero(F.col("single_family_share"))
        + 0.25 * or_zero(F.col("residential_share"))
        + 0.20 * or_zero(F.col("solar_candidate_share"))
        + 0.10 * or_zero(F.col("high_value_share"))
        + 0.10 * or_zero(garage)
    )
    return df.withColumn("solar_readiness_score", score)


def community_score(df: DataFrame, digits: int | None = 2) -> DataFrame:
    score = 0.55 * F.col("solar_readiness_score") + 0.45 * F.col("solar_cyber_pressure_score")
    return df.withColumn("community_risk_prior_score", half_even(score, digits))


def rank_communities(df: DataFrame, key: str = "geo_id") -> DataFrame:
    """Score descending; ties by community id."""
    return df.orderBy(F.desc("community_risk_prior_score"), F.asc(key))


def join_global_priors(df: DataFrame, priors: DataFrame) -> DataFrame:
    """Attach the one-row priors to every community."""
    return with_one_row(df, priors)


def score_v1(df: DataFrame, priors: DataFrame, key: str, digits: int | None = 2) -> DataFrame:
    scored = community_score(readiness_v1(join_global_priors(df, priors)), digits)
    return rank_communities(geo_id_rename(scored, key))


# --- second version: state-weighted pressure, income and age -------------------------------
def map_states(df: DataFrame, fill_gaps: bool = False) -> DataFrame:
    state = df.withColumn("geo_id", pad_geo_id(F.col("geo_id"))).withColumn(
        "state", zip3_state(F.col("geo_id"), fill_gaps)
    )
    return state.withColumn("state_solar_weight", state_weight(F.col("state")))


def state_pressure(df: DataFrame, base: DataFrame, digits: int | None = 2) -> DataFrame:
    """Base pressure × state weight, with the corpus statistics carried along."""
    attached = with_one_row(df, base)
    score = F.col("base_pressure") * F.col("state_solar_weight")
    return attached.withColumn("solar_cyber_pressure_score", half_even(score, digits)).drop("base_pressure")


def population_stats(df: DataFrame) -> DataFrame:
    """One row of the medians and limits that the features scale by."""
    medians = exact_medians(
        df, {"income_median": "median_household_income", "age_median": "median_property_age"}
    )
    income = F.col("median_household_income")
    limits = df.agg(F.min(income).alias("income_min"), F.max(income).alias("income_max"))
    return with_one_row(limits, medians)


def _income_interaction(digits: int | None) -> Column:
    # Filling with the median cannot move the minimum or the maximum.
    filled = F.coalesce(F.col("median_household_income"), F.col("income_median"))
    scaled = (filled - F.col("income_min")) / (F.col("income_max") - F.col("income_min") + 1e-9)
    return half_even(scaled * F.col("solar_candidate_share"), digits)


def _age_factor(digits: int | None) -> Column:
    age = F.coalesce("median_property_age", "age_median")
    return half_even(F.exp(-0.5 * F.pow((age - 25) / 12, F.lit(2.0))), digits)


def income_interaction(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Min–max income (missing → median) × candidate share."""
    stats = population_stats(df)
    return with_one_row(df, stats).withColumn("income_solar_interaction", _income_interaction(digits)).drop(*stats.columns)


def age_factor(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Bell curve around 25 years (missing age → median)."""
    stats = population_stats(df)
    return with_one_row(df, stats).withColumn("age_risk_factor", _age_factor(digits)).drop(*stats.columns)


def readiness_v2(df: DataFrame, digits: int | None = 2) -> DataFrame:
    score = 100 * (
        0.30 * or_zero(F.col("single_family_share"))
        + 0.20 * or_zero(F.col("residential_share"))
        + 0.15 * or_zero(F.col("solar_candidate_share"))
        + 0.15 * or_zero(F.col("income_solar_interaction"))
        + 0.10 * or_zero(F.col("age_risk_factor"))
        + 0.10 * or_zero(F.col("high_value_share"))
    )
    return df.withColumn("solar_readiness_score", half_even(score, digits))


def engineer_features(features: DataFrame, base: DataFrame, digits: bool = True) -> DataFrame:
    """State, pressure, income and age features. Medians and limits cover all communities.

    The statistics and the pressure row travel together as one constant row.
    """
    stats = population_stats(features)
    wide = with_one_row(map_states(features), with_one_row(base, stats))
    pressure = half_even(F.col("base_pressure") * F.col("state_solar_weight"), 2 if digits else None)
    return wide.withColumns(
        {
            "solar_cyber_pressure_score": pressure,
            "income_solar_interaction": _income_interaction(4 if digits else None),
            "age_risk_factor": _age_factor(4 if digits else None),
        }
    ).drop("base_pressure", *stats.columns)


def score_v2(features: DataFrame, base: DataFrame, digits: bool = True) -> DataFrame:
    """Scored, inhabited communities (unordered; see ``rank_communities``)."""
    places = 2 if digits else None
    scored = community_score(readiness_v2(engineer_features(features, base, digits), places), places)
    return filter_inhabited(scored)


def score_by_state(scored: DataFrame, n: int = 10) -> DataFrame:
    return (
        scored.filter(F.col("state").isNotNull())
        .groupBy("state")
        .agg(F.avg("community_risk_prior_score").alias("mean_score"), F.count(F.lit(1)).alias("communities"))
        .orderBy(F.desc("mean_score"), "state")
        .limit(n)
    )


def weight_by_state(df: DataFrame, n: int = 10) -> DataFrame:
    """The weight of each occurring state; it is constant inside a state."""
    return (
        df.filter(F.col("state").isNotNull())
        .groupBy("state")
        .agg(F.first("state_solar_weight", ignorenulls=True).alias("state_solar_weight"))
        .orderBy(F.desc("state_solar_weight"), "state")
        .limit(n)
    )


def top_candidates(features: DataFrame, n: int = 10) -> DataFrame:
    return features.orderBy(F.desc("solar_candidate_share"), "geo_id").limit(n)


# --- alerts --------------------------------------------------------------------------------
def readiness_alert(acs: DataFrame, high_value: float = C.ALERT_HIGH_VALUE_HOME) -> DataFrame:
    """Readiness in [0, 1] from three housing signals."""
    columns = ["total_housing_units", "single_family_detached_units", "owner_occupied_units", "median_home_value"]
    df = acs.withColumns({c: known(numeric(acs, c)) for c in columns})
    units = F.greatest(or_zero(F.col("total_housing_units")), F.lit(1.0))
    df = df.withColumns(
        {
            "single_family_share": clip(or_zero(F.col("single_family_detached_units")) / units, 0.0, 1.0),
            "owner_occupied_share": clip(or_zero(F.col("owner_occupied_units")) / units, 0.0, 1.0),
            "high_value_share": F.when(or_zero(F.col("median_home_value")) >= high_value, F.lit(1.0)).otherwise(
                F.lit(0.0)
            ),
        }
    )
    return df.withColumn(
        "solar_readiness",
        0.45 * F.col("single_family_share") + 0.35 * F.col("owner_occupied_share") + 0.20 * F.col("high_value_share"),
    )


def filter_alert_threshold(cves: DataFrame, min_cvss: float | None = C.ALERT_MIN_CVSS) -> DataFrame:
    """Scored CVEs that name a vendor and reach the minimum; ``None`` skips the minimum."""
    some = cves.filter(F.col("cvss_v3_score").isNotNull() & (F.size("vendor_keywords_matched") > 0))
    return some if min_cvss is None else some.filter(F.col("cvss_v3_score") >= min_cvss)


def cve_urgency(cves: DataFrame, pressure: DataFrame) -> DataFrame:
    """Urgency per CVE: the highest pressure among its vendors, or its own score when none is named."""
    named = (
        cves.select("cve_id", F.explode("vendor_keywords_matched").alias("vendor"))
        .join(pressure.select("vendor", "cyber_pressure_score"), "vendor")
        .groupBy("cve_id")
        .agg(F.max("cyber_pressure_score").alias("worst"))
    )
    own = or_zero(F.col("cvss_v3_score")) / 10
    unnamed = F.coalesce(F.size("vendor_keywords_matched"), F.lit(0)) == 0
    return cves.join(named, "cve_id", "left").select(
        "cve_id",
        F.when(unnamed, F.lit("unknown vendor"))
        .otherwise(F.array_join("vendor_keywords_matched", ", "))
        .alias("affected_vendors"),
        F.when(unnamed, own).otherwise(or_zero(F.col("worst"))).alias("vendor_cyber_pressure"),
    )


def join_alert(communities: DataFrame, one_urgency: DataFrame) -> DataFrame:
    """One CVE against every community: the one-row urgency is attached, nothing is shuffled."""
    return with_one_row(communities.select("geo_id", "solar_readiness"), one_urgency).withColumn(
        "alert_score", F.col("vendor_cyber_pressure") * F.col("solar_readiness")
    )


def alert_top_n(urgencies: DataFrame, communities: DataFrame, n: int = C.ALERT_TOP_N) -> DataFrame:
    """The n highest alert scores of every CVE.

    A positive urgency scales all communities alike, so the top n are the n readiest communities;
    with an urgency of 0 all scores tie. Both short lists are found once and attached; no pairs are
    built beyond the answer. Ties go by community id.
    """
    known = communities.select("geo_id", "solar_readiness").filter("solar_readiness IS NOT NULL")

    def listed(*order: Column) -> Column:
        return known.orderBy(*order).limit(n).agg(F.collect_list(F.struct("geo_id", "solar_readiness"))).scalar()

    ready = listed(F.desc("solar_readiness"), F.col("geo_id"))
    return (
        urgencies.withColumn(
            "c", F.explode(F.when(F.col("vendor_cyber_pressure") > 0, ready).otherwise(listed(F.col("geo_id"))))
        )
        .select("cve_id", "c.geo_id", "affected_vendors", "vendor_cyber_pressure", "c.solar_readiness")
        .withColumn("alert_score", F.col("vendor_cyber_pressure") * F.col("solar_readiness"))
    )
