"""Exploration statistics, exact and distributed."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.numeric import half_even, with_one_row
from gridrisk.functions.quantiles import exact_medians, exact_quantiles

DESCRIBE_COLUMNS = [
    "single_family_share", "residential_share", "owner_occupancy_rate", "solar_candidate_share",
    "high_value_share", "median_home_value", "median_household_income", "median_year_built",
    "median_property_age", "total_population", "total_housing_units", "solar_readiness_score",
    "community_risk_prior_score",
]
CORR_COLUMNS = [
    "single_family_share", "residential_share", "owner_occupancy_rate", "solar_candidate_share",
    "high_value_share", "median_home_value", "median_household_income", "median_property_age",
    "total_housing_units", "solar_readiness_score", "community_risk_prior_score",
]
TIER_PROFILE_COLUMNS = [
    "single_family_share", "owner_occupancy_rate", "solar_candidate_share", "median_home_value",
    "median_household_income", "total_housing_units",
]


def describe_features(df: DataFrame, columns: Sequence[str] = DESCRIBE_COLUMNS) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    values = {c: F.col(c).cast("double") for c in columns}
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"_{i}")
            for i, (c, v) in enumerate(values.items())
        ]
    )
    stats = wide.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(values))])).alias("s")).select("s.*")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "name", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")
    )
    return stats.join(quartiles, "name", "left").withColumnRenamed("name", "column_name")


def score_summary(df: DataFrame, column: str = "community_risk_prior_score") -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")
    )


def missing_audit(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Null count and percentage per column, only where any is missing."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names])
    long = counts.unpivot(["_n"], names, "column_name", "missing_count")
    return (
        long.filter("missing_count > 0")
        .select(
            "column_name",
            "missing_count",
            half_even(F.col("missing_count") / F.col("_n") * 100, digits).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def _one_quantile(df: DataFrame, column: str, prob: float, name: str) -> DataFrame:
    return exact_quantiles(df, [column], [prob]).select(F.col("q")[0].alias(name))


def quantile_threshold(df: DataFrame, column: str, prob: float = 0.9) -> DataFrame:
    """The quantile and the number of rows at or above it."""
    wide = with_one_row(df.select(column), _one_quantile(df, column, prob, "threshold"))
    return wide.agg(
        F.max("threshold").alias("threshold"),
        F.count(F.when(F.col(column) >= F.col("threshold"), 1)).alias("rows_at_or_above"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over [min, max]; the last bin is closed, empty bins are kept."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    limits = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    position = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = (
        with_one_row(values, limits)
        .groupBy(F.coalesce(position, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    grid = limits.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def histogram_clipped(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Histogram after clipping at the 99th percentile, with the unclipped median."""
    cut = exact_quantiles(df, [column], [0.5, 0.99]).select(
        F.col("q")[0].alias("median"), F.col("q")[1].alias("p99")
    )
    bars = histogram(clipped_source(df, column, cut), column, bins)
    return with_one_row(bars, cut.select("median"))


def clipped_source(df: DataFrame, column: str, cut: DataFrame) -> DataFrame:
    """The non-null values of a column, clipped at ``p99`` of the one-row ``cut``."""
    rows = with_one_row(df.select(column).filter(F.col(column).isNotNull()), cut.select("p99"))
    return rows.select(F.least(F.col(column), F.col("p99")).alias(column))


def histogram_density_by_tier(df: DataFrame, column: str, tier: str = "risk_tier", bins: int = 40) -> DataFrame:
    """Per tier: clip at the tier's 99th percentile, then density over the tier's own range."""
    rows = df.filter(F.col(column).isNotNull() & F.col(tier).isNotNull()).select(tier, column)
    p99 = exact_quantiles(rows, [column], [0.99], by=[tier]).select(tier, F.col("q")[0].alias("p99"))
    # One row per tier: few and fixed, so the planner broadcasts it.
    clipped = rows.join(p99, tier).select(tier, F.least(F.col(column), F.col("p99")).alias("v"))
    limits = clipped.groupBy(tier).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    position = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = (
        clipped.join(limits, tier)
        .groupBy(tier, "lo", "hi", "n", F.coalesce(position, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(tier, "bin", "rows", (F.col("rows") / (F.col("n") * width)).alias("density"))


def score_decomposition(df: DataFrame) -> DataFrame:
    """Distinct pressure values, and the two terms of the top community's score."""
    distinct = df.select("solar_cyber_pressure_score").distinct().agg(
        F.count("solar_cyber_pressure_score").alias("pressure_values")
    )
    top = df.orderBy(F.desc("community_risk_prior_score"), "geo_id").limit(1)
    return top.select(
        distinct.scalar().alias("pressure_values"),
        "geo_id",
        "solar_readiness_score",
        "solar_cyber_pressure_score",
        (0.55 * F.col("solar_readiness_score")).alias("readiness_term"),
        (0.45 * F.col("solar_cyber_pressure_score")).alias("pressure_term"),
        "community_risk_prior_score",
    )


def linear_fit(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Slope and intercept (missing x as 0) and Pearson r, one row per predictor."""
    pairs = F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("x")) for x in xs])
    long = df.select(F.col(y).cast("double").alias("y"), F.explode(pairs).alias("p")).select("y", "p.*")
    filled = F.coalesce("x", F.lit(0.0))
    return long.groupBy(F.col("name").alias("predictor")).agg(
        F.regr_slope("y", filled).alias("slope"),
        F.regr_intercept("y", filled).alias("intercept"),
        F.corr("x", "y").alias("r"),
    )


def corr_matrix(df: DataFrame, columns: Sequence[str] = CORR_COLUMNS) -> DataFrame:
    """Pearson correlation of every column pair, in one aggregation over the table."""
    pairs = list(combinations(columns, 2))
    one = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    listed = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(listed).alias("p")).select("p.a", "p.b", "p.r")


def corr_with_target(df: DataFrame, target: str = "community_risk_prior_score",
                     columns: Sequence[str] = CORR_COLUMNS) -> DataFrame:
    others = [c for c in columns if c != target]
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in others])
    return one.unpivot([], others, "column_name", "r").orderBy(F.desc("r"), "column_name")


def tier_cut(score: Column) -> Column:
    """Right-closed tiers; a score outside all of them is null."""
    tier = F.lit(None).cast("string")
    edges = C.RISK_TIER_EDGES
    for low, high, label in reversed(list(zip(edges, edges[1:], C.RISK_TIER_LABELS))):
        tier = F.when((score > low) & (score <= high), F.lit(label)).otherwise(tier)
    return tier


def tier_counts(df: DataFrame, score: str = "community_risk_prior_score") -> DataFrame:
    """Rows per tier in tier order; empty tiers stay with zero."""
    counts = df.groupBy(tier_cut(F.col(score)).alias("risk_tier")).agg(F.count(F.lit(1)).alias("communities"))
    tiers = df.sparkSession.createDataFrame(list(enumerate(C.RISK_TIER_LABELS)), "position int, risk_tier string")
    return tiers.join(counts, "risk_tier", "left").fillna(0, ["communities"]).orderBy("position")


def tier_profile(df: DataFrame, score: str = "community_risk_prior_score", digits: int | None = 2,
                 columns: Sequence[str] = TIER_PROFILE_COLUMNS) -> DataFrame:
    tiered = df.withColumn("risk_tier", tier_cut(F.col(score))).filter(F.col("risk_tier").isNotNull())
    medians = exact_medians(tiered, {c: c for c in columns}, by=["risk_tier"])
    return medians.select("risk_tier", *[half_even(F.col(c), digits).alias(c) for c in columns])


def income_deciles(df: DataFrame, value: str = "median_household_income",
                   measure: str = "solar_candidate_share", bins: int = 10) -> DataFrame:
    """Median measure per quantile bin of a value; equal values share a bin."""
    rows = df.filter(F.col(value).isNotNull()).select(value, measure)
    edges = exact_quantiles(rows, [value], [i / bins for i in range(bins + 1)]).select(F.col("q").alias("edges"))
    below = F.size(F.filter(F.col("edges"), lambda e: e < F.col(value)))
    binned = with_one_row(rows, edges).withColumn("income_decile", F.greatest(below, F.lit(1)))
    return exact_medians(binned, {"median_share": measure}, by=["income_decile"])


def grid_bin_2d(df: DataFrame, x: str, y: str, columns: int = 40, x_below: float | None = None,
                x_scale: float = 1.0) -> DataFrame:
    """Counts on a hexagonal grid: two offset lattices, each point goes to the nearer centre."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if x_below is not None:
        points = points.filter(F.col(x) < x_below)
    points = points.select((F.col(x) / x_scale).alias("x"), F.col(y).cast("double").alias("y"))
    rows = int(columns / 3**0.5)
    limits = points.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    pad_x, pad_y = (F.col("x1") - F.col("x0")) * 1e-9, (F.col("y1") - F.col("y0")) * 1e-9
    frame = limits.select(
        (F.col("x0") - pad_x).alias("x0"),
        ((F.col("x1") - F.col("x0") + 2 * pad_x) / columns).alias("dx"),
        (F.col("y0") - pad_y).alias("y0"),
        ((F.col("y1") - F.col("y0") + 2 * pad_y) / rows).alias("dy"),
    )
    placed = with_one_row(points, frame).select(
        "x0", "dx", "y0", "dy", ((F.col("x") - F.col("x0")) / F.col("dx")).alias("u"),
        ((F.col("y") - F.col("y0")) / F.col("dy")).alias("v"),
    )
    even = F.pow(F.col("u") - F.rint("u"), F.lit(2)) + 3 * F.pow(F.col("v") - F.rint("v"), F.lit(2))
    odd = F.pow(F.col("u") - F.floor("u") - 0.5, F.lit(2)) + 3 * F.pow(F.col("v") - F.floor("v") - 0.5, F.lit(2))
    nearer = placed.select(
        "x0", "dx", "y0", "dy",
        F.when(even < odd, F.rint("u")).otherwise(F.floor("u") + 0.5).alias("i"),
        F.when(even < odd, F.rint("v")).otherwise(F.floor("v") + 0.5).alias("j"),
    )
    return nearer.groupBy("i", "j", "x0", "dx", "y0", "dy").agg(F.count(F.lit(1)).alias("rows")).select(
        (F.col("x0") + F.col("i") * F.col("dx")).alias("x"),
        (F.col("y0") + F.col("j") * F.col("dy")).alias("y"),
        "rows",
    )


def sample_scatter(df: DataFrame, n: int = 5000, key: str = "geo_id") -> DataFrame:
    """A repeatable sample of n rows, chosen by digest of the key."""
    return (
        df.orderBy(F.md5(key), key)
        .limit(n)
        .select(
            key,
            F.log10(F.greatest(F.col("total_housing_units"), F.lit(1.0))).alias("log10_units"),
            "solar_candidate_share",
            "community_risk_prior_score",
        )
    )


def parse_dates_year(df: DataFrame, column: str) -> DataFrame:
    """Coerced date and year; what does not parse is null."""
    date = F.try_to_timestamp(F.col(column)).cast("date")
    return df.withColumn("parsed_date", date).withColumn("year", F.year("parsed_date"))


def cves_by(df: DataFrame, key: str) -> DataFrame:
    """Distinct CVEs per non-null key; pairs are made distinct first."""
    return (
        df.filter(F.col(key).isNotNull())
        .select(key, "cve_id")
        .distinct()
        .groupBy(key)
        .agg(F.count("cve_id").alias("cve_count"))
    )


def cve_corpus_stats(curated: DataFrame, vendor: str = "vendor_canonical") -> DataFrame:
    dated = parse_dates_year(curated, "published_date")
    cves = curated.select("cve_id").distinct().agg(F.count("cve_id").alias("n"))
    vendors = curated.select(vendor).distinct().agg(F.count(vendor).alias("n"))
    return dated.agg(
        F.min("parsed_date").cast("string").alias("first_date"),
        F.max("parsed_date").cast("string").alias("last_date"),
        F.count(F.when(F.col("cvss_score") >= C.CRITICAL_CVSS, 1)).alias("critical_rows"),
        F.max("cvss_score").alias("max_cvss"),
    ).select(cves.scalar().alias("cves"), vendors.scalar().alias("vendors"), "*")


def top_bottom(df: DataFrame, top: int = 15, bottom: int = 10) -> DataFrame:
    """First and last rows of the ranked table."""
    score = F.col("community_risk_prior_score")
    first = df.orderBy(score.desc(), F.col("geo_id").asc()).limit(top).withColumn("part", F.lit("top"))
    last = df.orderBy(score.asc(), F.col("geo_id").desc()).limit(bottom).withColumn("part", F.lit("bottom"))
    return first.unionByName(last)


QUALITY_ISSUES = {
    "missing_home_value": "median_home_value",
    "missing_income": "median_household_income",
    "missing_year_built": "median_year_built",
}


def quality_summary(df: DataFrame, digits: int | None = 1) -> DataFrame:
    """Null counts and rates behind each known data issue, and whether pressure is constant."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(name) for name, c in QUALITY_ISSUES.items()],
        F.max("median_household_income").alias("cap"),
    )
    capped = with_one_row(df.select("median_household_income"), one.select("cap")).agg(
        F.count(F.when(F.col("median_household_income") == F.col("cap"), 1))
    )
    spread = df.select("solar_cyber_pressure_score").distinct().agg(F.count(F.lit(1)))
    wide = one.withColumn("income_at_cap", capped.scalar()).withColumn("pressure_values", spread.scalar())
    names = [*QUALITY_ISSUES, "income_at_cap", "pressure_values"]
    return wide.unpivot(["n"], names, "issue", "rows").select(
        "issue", "rows", half_even(F.col("rows") / F.col("n") * 100, digits).alias("pct")
    )
