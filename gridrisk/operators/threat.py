"""Curated vulnerable products → vendor priors and threat pressure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.matching import first_match, matched_keywords
from gridrisk.functions.numeric import as_count, half_even, or_zero
from gridrisk.functions.text import is_relevant_text, title_case

PRODUCT_KEY = [
    "cve_id", "vendor_canonical", "product", "cpe_uri", "version_start_including",
    "version_start_excluding", "version_end_including", "version_end_excluding",
]


def vendor_canonical(vendor: Column) -> Column:
    """Allowlisted name, else the title case of the raw vendor."""
    names: dict[str, list[str]] = {}
    for raw, name in C.VENDOR_ALLOWLIST.items():
        names.setdefault(name, []).append(raw)
    return first_match([(vendor.isin(raws), F.lit(n)) for n, raws in names.items()], title_case(vendor))


def clean_products(products: DataFrame) -> DataFrame:
    return products.withColumns(
        {
            "vendor": F.lower(F.trim(F.coalesce(F.col("vendor"), F.lit("")))),
            "product": F.trim(F.coalesce(F.col("product"), F.lit(""))),
            "is_vulnerable": F.coalesce(F.col("is_vulnerable").cast("int"), F.lit(1)),
        }
    )


def join_products_cves(products: DataFrame, cves: DataFrame) -> DataFrame:
    """Left join; each description is judged once per CVE, before it meets its product rows."""
    judged = cves.withColumn(
        "description_relevant", is_relevant_text(F.col("description"), C.RELEVANT_TERMS)
    )
    return products.join(judged, "cve_id", "left")


def filter_vulnerable(merged: DataFrame) -> DataFrame:
    """Vulnerable rows of an allowlisted vendor or a relevant text, without the denied vendors."""
    listed = F.col("vendor").isin(list(C.VENDOR_ALLOWLIST))
    text = F.coalesce(F.col("description_relevant"), F.lit(False)) | is_relevant_text(
        F.col("product"), C.RELEVANT_TERMS
    )
    return merged.filter((F.col("is_vulnerable") == 1) & (listed | text) & ~F.col("vendor").isin(C.VENDOR_DENYLIST))


def filter_vendor_only(merged: DataFrame) -> DataFrame:
    """Vulnerable rows of an allowlisted vendor that is not denied."""
    return merged.filter(
        (F.col("is_vulnerable") == 1)
        & F.col("vendor").isin(list(C.VENDOR_ALLOWLIST))
        & ~F.col("vendor").isin(C.VENDOR_DENYLIST)
    )


def severity_flags(df: DataFrame) -> DataFrame:
    score = or_zero(F.col("cvss_score"))
    critical = score >= C.CRITICAL_CVSS
    return df.withColumns(
        {
            "critical_flag": critical,
            "high_flag": score >= C.HIGH_CVSS,
            "vuln_weight": F.coalesce(F.col("cvss_score"), F.lit(5.0)) / 10.0
            + F.coalesce(F.col("cisa_kev"), F.lit(0)) * 0.5
            + critical.cast("int") * 0.25,
        }
    )


def dedup_products(relevant: DataFrame) -> DataFrame:
    """Distinct over the eight key columns; nulls count as equal."""
    return relevant.select(*PRODUCT_KEY).distinct()


def curate(products: DataFrame, cves: DataFrame) -> DataFrame:
    """Relevant vulnerable products with the fields and flags of their CVE.

    Only the keys are deduplicated; the CVE fields, which depend on the CVE alone, are joined to
    the distinct rows, so long texts never go through the deduplication.
    """
    relevant = filter_vulnerable(join_products_cves(clean_products(products), cves))
    named = relevant.withColumn("vendor_canonical", vendor_canonical(F.col("vendor")))
    return severity_flags(dedup_products(named).join(cves, "cve_id", "left"))


def sort_curated(curated: DataFrame) -> DataFrame:
    return curated.orderBy(
        F.col("vendor_canonical").asc(), F.col("cvss_score").desc_nulls_last(), F.col("cve_id").asc()
    )


def _per_vendor_cve(curated: DataFrame) -> DataFrame:
    """First level: one row per (vendor, CVE), so a vendor with most of the rows spreads out."""
    return curated.groupBy("vendor_canonical", "cve_id").agg(
        F.max("critical_flag").alias("critical"),
        F.max("high_flag").alias("high"),
        F.max(F.col("cisa_kev") == 1).alias("kev"),
        F.sum(F.coalesce("cisa_kev", F.lit(0))).alias("kev_rows"),
        F.sum("cvss_score").alias("score_sum"),
        F.count("cvss_score").alias("score_rows"),
        F.max("cvss_score").alias("score_max"),
        F.sum("vuln_weight").alias("weight_sum"),
        F.count(F.lit(1)).alias("rows"),
    )


def _vendor_counts(curated: DataFrame) -> DataFrame:
    by_cve = (
        _per_vendor_cve(curated)
        .groupBy("vendor_canonical")
        .agg(
            F.count(F.lit(1)).alias("cve_count"),
            as_count(F.col("critical")).alias("critical_cve_count"),
            as_count(F.col("high")).alias("high_or_worse_count"),
            as_count(F.col("kev")).alias("kev_cve_count"),
            F.sum("kev_rows").alias("kev_rows"),
            F.try_divide(F.sum("score_sum"), F.sum("score_rows")).alias("avg_cvss"),
            F.max("score_max").alias("max_cvss"),
            (F.sum("weight_sum") / F.sum("rows")).alias("avg_vuln_weight"),
        )
    )
    by_product = (
        curated.select("vendor_canonical", "product")
        .distinct()
        .groupBy("vendor_canonical")
        .agg(F.count("product").alias("product_count"))
    )
    return by_cve.join(by_product, "vendor_canonical").withColumnRenamed("vendor_canonical", "vendor")


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def vendor_priors(curated: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per vendor: distinct counts, severity over product rows and the 0–100 risk score."""
    counts = _vendor_counts(curated)
    score = (
        35 * (or_zero(F.col("max_cvss")) / 10.0)
        + 25 * _ratio("critical_cve_count", "cve_count")
        + 20 * _ratio("kev_cve_count", "cve_count")
        + 20 * (or_zero(F.col("avg_cvss")) / 10.0)
    )
    return counts.withColumn("vendor_risk_score", half_even(score, digits)).select(
        "vendor", "cve_count", "product_count", "critical_cve_count", "high_or_worse_count",
        "kev_cve_count", "avg_cvss", "max_cvss", "avg_vuln_weight", "vendor_risk_score",
    )


def vendor_priors_alt(curated: DataFrame, digits: int | None = 4) -> DataFrame:
    """The 0–1 variant: KEV counts product rows and the mean weight enters directly."""
    counts = _vendor_counts(curated).withColumn("max_cvss_score", or_zero(F.col("max_cvss")))
    prior = (
        0.40 * (F.col("max_cvss_score") / 10.0)
        + 0.25 * _ratio("critical_cve_count", "cve_count")
        + 0.20 * _ratio("kev_rows", "cve_count")
        + 0.15 * F.col("avg_vuln_weight")
    )
    return counts.select(
        "vendor", "cve_count", "product_count", "critical_cve_count", "high_or_worse_count",
        F.col("kev_rows").alias("kev_count"), "max_cvss_score",
        half_even(F.col("avg_vuln_weight"), digits).alias("avg_vuln_weight"),
        half_even(prior, digits).alias("vendor_risk_prior"),
    )


def sort_vendor_priors(priors: DataFrame) -> DataFrame:
    return priors.orderBy(F.desc("avg_vuln_weight"), F.desc("cve_count"), F.asc("vendor"))


def vendor_ranking(priors: DataFrame) -> DataFrame:
    return priors.orderBy(F.desc("vendor_risk_score"), F.asc("vendor"))


def vendor_band(score: Column) -> Column:
    return F.when(score >= 60, F.lit("high")).when(score >= 40, F.lit("medium")).otherwise(F.lit("low"))


def view_vendors(priors: DataFrame) -> DataFrame:
    """Priors with a 0–100 score, derived from the 0–1 prior where it is missing."""
    if "vendor_risk_prior" in priors.columns and "vendor_risk_score" not in priors.columns:
        return priors.withColumn("vendor_risk_score", half_even(F.col("vendor_risk_prior") * 100, 1))
    return priors


def _corpus(rows: DataFrame, vendor: str) -> DataFrame:
    """One row over a product corpus, from per-CVE and per-vendor partial counts."""
    score = or_zero(F.col("cvss_score"))
    by_cve = rows.groupBy("cve_id").agg(
        F.max(score >= C.CRITICAL_CVSS).alias("critical"),
        F.max(F.col("cisa_kev") == 1).alias("kev"),
        F.sum(F.coalesce("cisa_kev", F.lit(0))).alias("kev_rows"),
        F.max(score).alias("score_max"),
        F.sum(score).alias("score_sum"),
        F.count(F.lit(1)).alias("rows"),
    )
    vendors = rows.select(vendor).distinct().agg(F.count(vendor).alias("vendors"))
    return by_cve.agg(
        F.count(F.lit(1)).alias("solar_cve_count"),
        as_count(F.col("critical")).alias("solar_critical_cve_count"),
        as_count(F.col("kev")).alias("solar_kev_cve_count"),
        F.sum("kev_rows").alias("kev_rows"),
        F.max("score_max").alias("max_cvss"),
        F.try_divide(F.sum("score_sum"), F.sum("rows")).alias("avg_cvss"),
    ).withColumn("solar_vendor_count", vendors.scalar())


def _pressure(kev: str) -> Column:
    return 100 * (
        0.35 * (or_zero(F.col("max_cvss")) / 10.0)
        + 0.25 * _ratio("solar_critical_cve_count", "solar_cve_count")
        + 0.20 * _ratio(kev, "solar_cve_count")
        + 0.20 * (or_zero(F.col("avg_cvss")) / 10.0)
    )


def global_priors(curated: DataFrame, priors: DataFrame, digits: int | None = 2,
                  stat_digits: int | None = 4) -> DataFrame:
    """One row of corpus statistics and the pressure score."""
    mean_risk = priors.agg(F.avg("vendor_risk_score").alias("m"))
    return _corpus(curated, "vendor_canonical").withColumn("mean_risk", mean_risk.scalar()).select(
        "solar_cve_count",
        "solar_critical_cve_count",
        "solar_kev_cve_count",
        "solar_vendor_count",
        half_even(F.col("avg_cvss"), stat_digits).alias("solar_avg_cvss"),
        half_even(F.col("max_cvss"), stat_digits).alias("solar_max_cvss"),
        half_even(or_zero(F.col("mean_risk")), stat_digits).alias("solar_avg_vendor_risk"),
        half_even(_pressure("solar_kev_cve_count"), digits).alias("solar_cyber_pressure_score"),
    )


def base_pressure(products: DataFrame, cves: DataFrame, digits: int | None = 2, stat_digits: int | None = 4,
                  count_kev_rows: bool = False) -> DataFrame:
    """Pressure over allowlisted vendors only; 50 without statistics when nothing matches.

    ``count_kev_rows`` counts exploited product rows instead of distinct CVEs.
    """
    merged = join_products_cves(clean_products(products), cves)
    stats = _corpus(filter_vendor_only(merged), "vendor")
    some = F.col("solar_cve_count") > 0
    kev = "kev_rows" if count_kev_rows else "solar_kev_cve_count"

    def known(value: Column) -> Column:
        return F.when(some, value)

    return stats.select(
        F.when(some, half_even(_pressure(kev), digits)).otherwise(F.lit(C.EMPTY_CORPUS_PRESSURE)).alias("base_pressure"),
        known(F.col("solar_cve_count")).alias("solar_cve_count"),
        known(F.col("solar_critical_cve_count")).alias("solar_critical_cve_count"),
        known(F.col(kev)).alias("solar_kev_cve_count"),
        known(F.col("solar_vendor_count")).alias("solar_vendor_count"),
        known(half_even(F.col("avg_cvss"), stat_digits)).alias("solar_avg_cvss"),
        known(half_even(F.col("max_cvss"), stat_digits)).alias("solar_max_cvss"),
    )


def tag_vendors(cves: DataFrame, vendors: Sequence[str] = C.ALERT_VENDORS) -> DataFrame:
    """Add the configured vendors named in each description."""
    return cves.withColumn("vendor_keywords_matched", matched_keywords(F.col("description"), vendors))


def vendor_pressure_text(tagged: DataFrame, vendors: Sequence[str] = C.ALERT_VENDORS,
                         digits: int | None = 3) -> DataFrame:
    """Pressure of each configured vendor from tagged CVEs; vendors without CVEs stay at zero."""
    per_vendor = (
        tagged.select(F.explode("vendor_keywords_matched").alias("vendor"), "cvss_v3_score", "in_kev")
        .groupBy("vendor")
        .agg(
            F.count(F.lit(1)).alias("cve_count"),
            F.max("cvss_v3_score").alias("max_cvss"),
            F.avg("cvss_v3_score").alias("mean_cvss"),
            as_count(F.col("cvss_v3_score") >= C.CRITICAL_CVSS).alias("critical_cve_count"),
            as_count(F.col("in_kev")).alias("kev_count"),
        )
    )
    listed = tagged.sparkSession.createDataFrame([(v,) for v in vendors], "vendor string")
    filled = listed.join(per_vendor, "vendor", "left").fillna(0)
    pressure = (
        0.4 * (F.col("max_cvss") / 10)
        + 0.3 * (F.col("mean_cvss") / 10)
        + 0.2 * _ratio("critical_cve_count", "cve_count")
        + 0.1 * _ratio("kev_count", "cve_count")
    )
    text_digits = None if digits is None else 2
    return filled.select(
        "vendor",
        "cve_count",
        half_even(F.col("max_cvss"), text_digits).alias("max_cvss"),
        half_even(F.col("mean_cvss"), text_digits).alias("mean_cvss"),
        "critical_cve_count",
        "kev_count",
        half_even(pressure, digits).alias("cyber_pressure_score"),
    )
