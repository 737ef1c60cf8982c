"""Queries over statistics, clusters, labels and leaderboards."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridrisk import constants as C
from gridrisk.catalog import community as CC
from gridrisk.catalog import threat as TC
from gridrisk.catalog.registry import STEPS, query, sql_case
from gridrisk.operators import community as K
from gridrisk.operators import devices as D
from gridrisk.operators import explore as E
from gridrisk.operators import model as M
from gridrisk.operators import views as W
from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table

SCORE = "community_risk_prior_score"


def table(t):
    """The scored communities as a written table: the statistics below read it more than once."""
    return write_table(CC.scored(t), scratch_path(t.spark, "scores"))


# --- descriptive statistics ----------------------------------------------------------------
_DESCRIBE = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM s_scored"
    for c in E.DESCRIBE_COLUMNS
)


@query("describe_features", _DESCRIBE, ["mean", "std", "min", "max", "p25", "p50", "p75"])
def _(t):
    return E.describe_features(table(t))


@query("score_summary", f"SELECT min({SCORE}) AS min, max({SCORE}) AS max, avg({SCORE}) AS mean, stddev_samp({SCORE}) AS std FROM s_scored",
       ["min", "max", "mean", "std"])
def _(t):
    return E.score_summary(CC.scored(t))


_AUDITED = ["geo_id", "state", "median_home_value", "median_household_income", "median_year_built", "median_property_age", "total_population"]
_AUDIT = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM s_scored"
    for c in _AUDITED
)


@query("missing_audit", f"SELECT * FROM ({_AUDIT}) a WHERE missing_count > 0", ["missing_pct"])
def _(t):
    return E.missing_audit(CC.scored(t).select(*_AUDITED), None)


@query("quantile_threshold", f"""
SELECT threshold, count(*) FILTER (WHERE {SCORE} >= threshold) AS rows_at_or_above
FROM s_scored, (SELECT quantile_cont({SCORE}, 0.9) AS threshold FROM s_scored) q GROUP BY threshold
""", ["threshold"])
def _(t):
    return E.quantile_threshold(table(t), SCORE)


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""
SELECT CAST(g.bin AS INT) AS bin, lo + g.bin * (hi - lo) / {bins} AS bin_start, lo + (g.bin + 1) * (hi - lo) / {bins} AS bin_end,
       coalesce(n, 0) AS rows
FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) l, range({bins}) g(bin)
LEFT JOIN (SELECT least(floor(({column} - lo) / (hi - lo) * {bins}), {bins} - 1) AS b, count(*) AS n
           FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) l2 WHERE {column} IS NOT NULL GROUP BY 1) h ON h.b = g.bin
"""


@query("histogram", _histogram_sql("s_scored", SCORE, 80), ["bin_start", "bin_end"])
def _(t):
    return E.histogram(table(t), SCORE, 80)


STEPS["clip_values"] = """
SELECT least(median_home_value, p99) AS v FROM s_scored, (SELECT quantile_cont(median_home_value, 0.99) AS p99 FROM s_scored) q
WHERE median_home_value IS NOT NULL
"""


@query("histogram_clipped", f"""
SELECT *, (SELECT median(median_home_value) FROM s_scored) AS median FROM ({_histogram_sql('clip_values', 'v', 60)}) h
""", ["bin_start", "bin_end", "median"])
def _(t):
    return E.histogram_clipped(table(t), "median_home_value")


_TIER = sql_case(
    [
        (f"{SCORE} > {lo} AND {SCORE} <= {hi}", f"'{label}'")
        for lo, hi, label in zip(C.RISK_TIER_EDGES, C.RISK_TIER_EDGES[1:], C.RISK_TIER_LABELS)
    ],
    "NULL",
)
STEPS["tiered"] = f"SELECT *, {_TIER} AS risk_tier FROM s_scored"
STEPS["tier_clip"] = """
SELECT t.risk_tier, least(median_home_value, p99) AS v FROM tiered t
JOIN (SELECT risk_tier, quantile_cont(median_home_value, 0.99) AS p99 FROM tiered GROUP BY risk_tier) q ON t.risk_tier = q.risk_tier
WHERE median_home_value IS NOT NULL
"""


@query("histogram_density_by_tier", """
SELECT t.risk_tier, CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS INT) AS bin, count(*) AS rows, count(*) / (n * ((hi - lo) / 40)) AS density
FROM tier_clip t JOIN (SELECT risk_tier AS rt, min(v) AS lo, max(v) AS hi, count(*) AS n FROM tier_clip GROUP BY 1) l ON t.risk_tier = rt
GROUP BY t.risk_tier, bin, lo, hi, n
""", ["density"])
def _(t):
    tiered = table(t).withColumn("risk_tier", E.tier_cut(F.col(SCORE)))
    return E.histogram_density_by_tier(tiered, "median_home_value")


@query("score_decomposition", f"""
SELECT (SELECT count(DISTINCT solar_cyber_pressure_score) FROM s_scored) AS pressure_values, geo_id, solar_readiness_score,
       solar_cyber_pressure_score, 0.55 * solar_readiness_score AS readiness_term, 0.45 * solar_cyber_pressure_score AS pressure_term, {SCORE}
FROM s_scored ORDER BY {SCORE} DESC, geo_id LIMIT 1
""", ["solar_readiness_score", "solar_cyber_pressure_score", "readiness_term", "pressure_term", SCORE])
def _(t):
    return E.score_decomposition(table(t))


_FIT = ["single_family_share", "residential_share", "solar_candidate_share"]
_FIT_SQL = "\nUNION ALL ".join(
    f"SELECT '{x}' AS predictor, regr_slope(solar_readiness_score, coalesce({x}, 0)) AS slope, "
    f"regr_intercept(solar_readiness_score, coalesce({x}, 0)) AS intercept, corr({x}, solar_readiness_score) AS r FROM s_scored"
    for x in _FIT
)


@query("linear_fit", _FIT_SQL, ["slope", "intercept", "r"])
def _(t):
    return E.linear_fit(CC.scored(t), "solar_readiness_score", _FIT)


_PAIRS = ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for a, b in combinations(E.CORR_COLUMNS, 2)
)


@query("corr_matrix", f"SELECT p.a AS a, p.b AS b, p.r AS r FROM (SELECT unnest([{_PAIRS}]) AS p FROM s_scored) q", ["r"])
def _(t):
    return E.corr_matrix(CC.scored(t))


_TARGET = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, corr({c}, {SCORE}) AS r FROM s_scored" for c in E.CORR_COLUMNS if c != SCORE
)


@query("corr_with_target", _TARGET, ["r"])
def _(t):
    return E.corr_with_target(CC.scored(t))


# --- tiers, deciles, grids -----------------------------------------------------------------
@query("tier_cut", f"""
SELECT CAST(position AS INT) AS position, l.risk_tier, count(t.geo_id) AS communities
FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(C.RISK_TIER_LABELS))}) l(position, risk_tier)
LEFT JOIN tiered t ON l.risk_tier = t.risk_tier GROUP BY ALL
""")
def _(t):
    return E.tier_counts(CC.scored(t))


@query("tier_profile", f"""
SELECT risk_tier, {', '.join(f'median({c}) AS {c}' for c in E.TIER_PROFILE_COLUMNS)} FROM tiered WHERE risk_tier IS NOT NULL GROUP BY risk_tier
""", E.TIER_PROFILE_COLUMNS)
def _(t):
    return E.tier_profile(table(t), digits=None)


STEPS["decile_edges"] = f"""
SELECT quantile_cont(median_household_income, [{', '.join(str(i / 10) for i in range(11))}]) AS edges FROM s_scored
"""


@query("income_deciles", """
SELECT CAST(greatest(1, len(list_filter(edges, lambda e: e < median_household_income))) AS INT) AS income_decile,
       median(solar_candidate_share) AS median_share
FROM s_scored, decile_edges WHERE median_household_income IS NOT NULL GROUP BY 1
""", ["median_share"])
def _(t):
    return E.income_deciles(table(t))


STEPS["hex_points"] = """
SELECT median_home_value / 1000 AS x, solar_candidate_share AS y FROM s_scored
WHERE median_home_value < 1500000 AND solar_candidate_share IS NOT NULL
"""
STEPS["hex_frame"] = """
SELECT x0 - (x1 - x0) * 1e-9 AS x0, (x1 - x0 + 2 * ((x1 - x0) * 1e-9)) / 40 AS dx,
       y0 - (y1 - y0) * 1e-9 AS y0, (y1 - y0 + 2 * ((y1 - y0) * 1e-9)) / 23 AS dy
FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM hex_points) l
"""


@query("grid_bin_2d", """
SELECT x0 + i * dx AS x, y0 + j * dy AS y, count(*) AS rows FROM (
SELECT x0, dx, y0, dy, CASE WHEN d1 < d2 THEN round_even(u, 0) ELSE floor(u) + 0.5 END AS i,
       CASE WHEN d1 < d2 THEN round_even(v, 0) ELSE floor(v) + 0.5 END AS j
FROM (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) AS d1, pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS d2
      FROM (SELECT x0, dx, y0, dy, (x - x0) / dx AS u, (y - y0) / dy AS v FROM hex_points, hex_frame) p) d) n
GROUP BY i, j, x0, dx, y0, dy
""", ["x", "y"])
def _(t):
    return E.grid_bin_2d(table(t), "median_home_value", "solar_candidate_share", x_below=1_500_000.0, x_scale=1000.0)


@query("sample_scatter", """
SELECT geo_id, log10(greatest(total_housing_units, 1.0)) AS log10_units, solar_candidate_share, community_risk_prior_score
FROM s_scored ORDER BY md5(geo_id), geo_id LIMIT 5000
""", ["log10_units", "solar_candidate_share", "community_risk_prior_score"])
def _(t):
    return E.sample_scatter(CC.scored(t))


# --- vulnerability statistics --------------------------------------------------------------
@query("cve_by_vendor", "SELECT vendor_canonical, count(DISTINCT cve_id) AS cve_count FROM pr_curated GROUP BY 1")
def _(t):
    return E.cves_by(TC.curated(t), "vendor_canonical")


@query("cve_by_year", """
SELECT CAST(year(CAST(published_date AS DATE)) AS INT) AS year, count(DISTINCT cve_id) AS cve_count FROM pr_curated
WHERE published_date IS NOT NULL GROUP BY 1
""")
def _(t):
    return E.cves_by(E.parse_dates_year(TC.curated(t), "published_date"), "year")


@query("parse_dates_year", """
SELECT event_id, CAST(year(try_cast(substring(s, 1, 10) AS DATE)) AS INT) AS year FROM (
SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS s FROM events) e
""")
def _(t):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return E.parse_dates_year(t.events.withColumn("s", text), "s").select("event_id", "year")


@query("cve_corpus_stats", """
SELECT count(DISTINCT cve_id) AS cves, count(DISTINCT vendor_canonical) AS vendors, min(published_date) AS first_date,
       max(published_date) AS last_date, count(*) FILTER (WHERE cvss_score >= 9) AS critical_rows, max(cvss_score) AS max_cvss FROM pr_curated
""", ["max_cvss"])
def _(t):
    return E.cve_corpus_stats(TC.curated(t))


_TB = ["geo_id", SCORE, "solar_readiness_score", "solar_candidate_share"]


@query("top_bottom", f"""
SELECT * FROM (SELECT {', '.join(_TB)}, 'top' AS part FROM s_scored ORDER BY {SCORE} DESC, geo_id LIMIT 15) a
UNION ALL SELECT * FROM (SELECT {', '.join(_TB)}, 'bottom' AS part FROM s_scored ORDER BY {SCORE}, geo_id DESC LIMIT 10) b
""", _TB[1:])
def _(t):
    return E.top_bottom(CC.scored(t).select(*_TB))


@query("quality_summary", """
SELECT issue, rows, rows / n * 100 AS pct FROM (SELECT count(*) AS n FROM s_scored) c, (
SELECT 'missing_home_value' AS issue, count(*) - count(median_home_value) AS rows FROM s_scored
UNION ALL SELECT 'missing_income', count(*) - count(median_household_income) FROM s_scored
UNION ALL SELECT 'missing_year_built', count(*) - count(median_year_built) FROM s_scored
UNION ALL SELECT 'income_at_cap', count(*) FROM s_scored WHERE median_household_income = (SELECT max(median_household_income) FROM s_scored)
UNION ALL SELECT 'pressure_values', count(DISTINCT solar_cyber_pressure_score) FROM s_scored) q
""", ["pct"])
def _(t):
    return E.quality_summary(table(t), None)


# --- clusters ------------------------------------------------------------------------------
_IMPUTED = ["geo_id", "median_property_age", "median_household_income"]


@query("median_impute", """
SELECT geo_id, coalesce(median_property_age, (SELECT median(median_property_age) FROM s_scored)) AS median_property_age,
       coalesce(median_household_income, (SELECT median(median_household_income) FROM s_scored)) AS median_household_income FROM s_scored
""", _IMPUTED[1:])
def _(t):
    return M.median_impute(table(t).select(*_IMPUTED), _IMPUTED[1:])


@query("kmeans_tiers")
def _(t):
    return M.cluster_rank(M.kmeans_tiers(table(t))).select("geo_id", "risk_cluster", "risk_cluster_label", SCORE)


@query("cluster_rank", f"SELECT geo_id, cluster_id, CAST(risk_cluster AS INT) AS risk_cluster, risk_cluster_label FROM cluster_named")
def _(t):
    return M.cluster_rank(CC.clustered(t)).select("geo_id", "cluster_id", "risk_cluster", "risk_cluster_label")


_RAW = sql_case([(f"r = {i}", f"'{n}'") for i, n in enumerate(reversed(C.CLUSTER_LABELS))], "NULL")


@query("cluster_rank_raw", f"""
SELECT geo_id, c.cluster_id, {_RAW} AS risk_cluster_label FROM clustered c JOIN (
SELECT cluster_id, row_number() OVER (ORDER BY avg({SCORE}) DESC, cluster_id) - 1 AS r FROM clustered GROUP BY cluster_id) o ON c.cluster_id = o.cluster_id
""")
def _(t):
    return M.cluster_rank_raw(CC.clustered(t)).select("geo_id", "cluster_id", "risk_cluster_label")


@query("cluster_profiles", f"""
SELECT CAST(risk_cluster AS INT) AS risk_cluster, max(risk_cluster_label) AS label, count(geo_id) AS count,
       {', '.join(f'avg({c}) AS {n}' for n, c in M.PROFILE_MEANS.items())},
       median(median_home_value) AS median_home_value, median(median_household_income) AS median_income
FROM cluster_named GROUP BY risk_cluster
""", [*M.PROFILE_MEANS, "median_home_value", "median_income"])
def _(t):
    named = write_table(M.cluster_rank(CC.clustered(t)), scratch_path(t.spark, "clusters"))
    return M.cluster_profiles(named, None)


# --- labels, composites, leaderboard -------------------------------------------------------
RADIUS_KM = 50.0
_KM = """2 * 6371.0088 * asin(sqrt(pow(sin(radians(d.lat - c.lat) / 2), 2)
   + cos(radians(c.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - c.lon) / 2), 2)))"""
STEPS["d_positions"] = """
SELECT lat, lon, count(*) AS devices, sum(risk_score) AS score_sum, count(*) FILTER (WHERE default_creds_indicator) AS creds,
       count(*) FILTER (WHERE NOT has_tls) AS no_tls, count(*) FILTER (WHERE risk_score >= 60) AS high
FROM d_scored WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY lat, lon
"""
STEPS["c_positions"] = "SELECT DISTINCT lat, lon FROM located"
STEPS["near_rows"] = f"""
SELECT l.geo_id, l.lat, l.lon, l.total_housing_units, l.solar_candidate_share, l.state_solar_weight, l.solar_cyber_pressure_score, l.{SCORE},
       CAST(coalesce(devices, 0) AS BIGINT) AS nearby_observed_exposure_count, score_sum / devices AS nearby_avg_device_risk,
       creds / devices AS nearby_default_creds_rate, no_tls / devices AS nearby_no_tls_rate, CAST(coalesce(high, 0) AS BIGINT) AS nearby_high_severity_count
FROM located l LEFT JOIN (
SELECT c.lat, c.lon, sum(devices) AS devices, sum(score_sum) AS score_sum, sum(creds) AS creds, sum(no_tls) AS no_tls, sum(high) AS high
FROM c_positions c JOIN d_positions d ON {_KM} <= {RADIUS_KM} GROUP BY c.lat, c.lon) n ON l.lat = n.lat AND l.lon = n.lon
"""
_NEAR = ["geo_id", "nearby_observed_exposure_count", "nearby_avg_device_risk", "nearby_default_creds_rate", "nearby_no_tls_rate",
         "nearby_high_severity_count"]
_NEAR_KEEP = ["geo_id", "lat", "lon", "total_housing_units", "solar_candidate_share", "state_solar_weight", "solar_cyber_pressure_score", SCORE]


def near(t, places=None):
    """Device sums around ``places``, the located communities unless given."""
    places = CC.located(t).select(*_NEAR_KEEP) if places is None else places
    places = write_table(places, scratch_path(t.spark, "located"))
    return M.join_nearby_devices(places, D.score_devices(D.dedup_device(t.v_devices)), RADIUS_KM)


@query("join_nearby_devices", f"SELECT {', '.join(_NEAR)} FROM near_rows", _NEAR[2:5])
def _(t):
    return near(t).select(*_NEAR)


@query("weak_labels", """
SELECT geo_id, CAST(nearby_observed_exposure_count > 0 AS INT) AS label_exposed, CAST(nearby_high_severity_count >= 2 AS INT) AS label_high_risk FROM near_rows
""")
def _(t):
    return M.weak_labels(near(t)).select("geo_id", "label_exposed", "label_high_risk")


@query("risk_density_target", """
SELECT geo_id, 1000 * (nearby_observed_exposure_count * coalesce(nearby_avg_device_risk, 0)) / nullif(total_housing_units, 0) AS risk_density FROM near_rows
""", ["risk_density"])
def _(t):
    return M.risk_density_target(near(t)).select("geo_id", "risk_density")


@query("two_stage_risk", """
SELECT geo_id, solar_candidate_share * (solar_cyber_pressure_score / 100) * state_solar_weight AS community_risk FROM s_scored
""", ["community_risk"])
def _(t):
    return M.two_stage_risk(
        CC.scored(t), F.col("solar_candidate_share"), F.col("solar_cyber_pressure_score") / 100, F.col("state_solar_weight")
    ).select("geo_id", "community_risk")


STEPS["lens_rows"] = """
SELECT geo_id, 0.40 * solar_candidate_share * 100 + 0.35 * solar_cyber_pressure_score + 0.25 * coalesce(nearby_avg_device_risk, 0) AS community_risk_score,
       state_solar_weight FROM near_rows
"""


def lenses(t):
    return M.three_lens_score(
        near(t), F.col("solar_candidate_share") * 100, F.col("solar_cyber_pressure_score"),
        F.coalesce("nearby_avg_device_risk", F.lit(0.0)),
    )


@query("three_lens_score", "SELECT geo_id, community_risk_score FROM lens_rows", ["community_risk_score"])
def _(t):
    return lenses(t).select("geo_id", "community_risk_score")


@query("priority_score", "SELECT geo_id, community_risk_score * (1 + state_solar_weight) AS priority_score FROM lens_rows", ["priority_score"])
def _(t):
    return M.priority_score(lenses(t), 1 + F.col("state_solar_weight")).select("geo_id", "priority_score")


STEPS["pct_rows"] = f"SELECT *, percent_rank() OVER (ORDER BY {SCORE}) AS risk_percentile FROM s_rounded"
STEPS["s_rounded"] = f"SELECT * REPLACE (round({SCORE}, 6) AS {SCORE}) FROM s_scored"


def rounded_scores(t):
    rows = CC.scored(t).withColumn(SCORE, F.round(SCORE, 6))
    return write_table(rows, scratch_path(t.spark, "ranked"))


@query("risk_percentile", "SELECT geo_id, risk_percentile FROM pct_rows", ["risk_percentile"])
def _(t):
    return M.risk_percentile(rounded_scores(t)).select("geo_id", "risk_percentile")


_BOARD = {
    "single_family_share": 30.0, "residential_share": 20.0, "solar_candidate_share": 15.0,
    "income_solar_interaction": 15.0, "age_risk_factor": 10.0, "high_value_share": 10.0,
}


@query("leaderboard", f"""
SELECT CAST(row_number() OVER (ORDER BY {SCORE} DESC, geo_id) AS INT) AS rank, geo_id, {SCORE}, risk_percentile
FROM pct_rows ORDER BY {SCORE} DESC, geo_id LIMIT 100
""", [SCORE, "risk_percentile"])
def _(t):
    return M.leaderboard(rounded_scores(t), _BOARD).drop("top_features")


_PARTS = ", ".join(f"{{'points': {w} * coalesce({c}, 0), 'feature': '{c}'}}" for c, w in _BOARD.items())


@query("leaderboard_features", f"""
SELECT CAST(row_number() OVER (ORDER BY {SCORE} DESC, geo_id) AS INT) AS rank, geo_id,
       array_to_string([s.feature for s in list_reverse_sort([{_PARTS}])[1:3]], ',') AS top_features
FROM (SELECT * REPLACE (round({SCORE}, 6) AS {SCORE}) FROM s_scored) q ORDER BY {SCORE} DESC, geo_id LIMIT 100
""")
def _(t):
    return M.leaderboard(rounded_scores(t), _BOARD).select("rank", "geo_id", "top_features")


_BASELINE = ["single_family_share", "owner_occupancy_rate", "age_risk_factor", "median_property_age"]


@query("baseline_models")
def _(t):
    # The features travel with the places, so the scores are computed once. Each label of an id meets each of its
    # feature rows: of n rows of an id, every one counts n times.
    times = F.count(F.lit(1)).over(Window.partitionBy("geo_id"))
    places = CC.located(t).select(*_NEAR_KEEP, *_BASELINE).withColumn("times", times)
    labelled = M.weak_labels(near(t, places)).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    data = write_table(labelled.select("geo_id", "label_exposed", *_BASELINE), scratch_path(t.spark, "labelled"))
    return M.baseline_models(data, "label_exposed", _BASELINE)
