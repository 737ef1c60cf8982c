"""Queries over census-style communities, scores and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.catalog import threat as TC
from gridrisk.catalog.registry import STEPS, query, sql_case, sql_clip, sql_list
from gridrisk.functions.geo import state_capacity, state_weight, zip3_state
from gridrisk.operators import community as K
from gridrisk.operators import lookup as L
from gridrisk.operators import threat as T
from gridrisk.operators import views as W
from gridrisk.plans import jobs

_RAW = ["total_housing_units", "occupied_units", "owner_occupied_units", "single_family_detached_units",
        "median_home_value", "median_household_income", "median_year_built", "total_population"]
_CLEAN = ", ".join(f"CASE WHEN {c} > -600000 THEN {c} END AS {c}" for c in _RAW)
STEPS["f_base"] = f"SELECT * REPLACE ({_CLEAN}) FROM v_acs"
STEPS["f_acs"] = f"""
SELECT *, {sql_clip('single_family_share * owner_occupancy_rate')} AS solar_candidate_share,
       CAST(round_even({sql_clip('single_family_share * owner_occupancy_rate')} * units, 0) AS BIGINT) AS solar_candidate_count
FROM (
SELECT *, greatest(coalesce(total_housing_units, 1), 1) AS units,
       {sql_clip('coalesce(single_family_detached_units, 0) / greatest(coalesce(total_housing_units, 1), 1)')} AS single_family_share,
       {sql_clip('coalesce(occupied_units, 0) / greatest(coalesce(total_housing_units, 1), 1)')} AS residential_share,
       {sql_clip('coalesce(owner_occupied_units, 0) / greatest(coalesce(occupied_units, 0), 1)')} AS owner_occupancy_rate,
       CASE WHEN coalesce(median_home_value, 0) >= 1000000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high_value_share,
       CASE WHEN median_year_built IS NOT NULL THEN greatest(2026 - median_year_built, 0) END AS median_property_age
FROM f_base) a
"""
ACS_OUT = [
    "geo_id", "total_housing_units", "single_family_share", "residential_share", "owner_occupancy_rate", "solar_candidate_share",
    "solar_candidate_count", "high_value_share", "median_home_value", "median_household_income", "median_property_age", "total_population",
]
_ACS_DOUBLES = [c for c in ACS_OUT if c not in ("geo_id", "solar_candidate_count")]

_STATE = sql_case(
    [(f"substring(geo_id, 1, 3) BETWEEN '{lo:03d}' AND '{hi:03d}'", f"'{s}'") for lo, hi, s in C.ZIP3_RANGES], "NULL"
)
_CAPS = state_capacity()
_MAX = max(_CAPS.values())
_WEIGHT = (
    "coalesce((SELECT greatest(0.1, round_even(ln(1 + gw) / ln(1 + " + str(_MAX) + "), 4)) FROM (VALUES "
    + ", ".join(f"('{s}', {gw}::DOUBLE)" for s, gw in _CAPS.items())
    + ") w(ws, gw) WHERE ws = state), 0.1)"
)
STEPS["s_state"] = f"SELECT *, {_STATE} AS state FROM f_acs"
STEPS["s_weight"] = f"SELECT *, CAST({_WEIGHT} AS DOUBLE) AS state_solar_weight FROM s_state"
STEPS["s_limits"] = """
SELECT median(median_household_income) AS income_median, min(median_household_income) AS income_min,
       max(median_household_income) AS income_max, median(median_property_age) AS age_median FROM f_acs
"""
STEPS["s_features"] = """
SELECT s.*, b.base_pressure * state_solar_weight AS solar_cyber_pressure_score,
       (coalesce(median_household_income, income_median) - income_min) / (income_max - income_min + 1e-9) * solar_candidate_share AS income_solar_interaction,
       exp(-0.5 * pow((coalesce(median_property_age, age_median) - 25) / 12, 2)) AS age_risk_factor
FROM s_weight s, s_limits, base_row b
"""
STEPS["s_scored"] = """
SELECT *, 0.55 * solar_readiness_score + 0.45 * solar_cyber_pressure_score AS community_risk_prior_score FROM (
SELECT *, 100 * (0.30 * single_family_share + 0.20 * residential_share + 0.15 * solar_candidate_share
        + 0.15 * income_solar_interaction + 0.10 * age_risk_factor + 0.10 * high_value_share) AS solar_readiness_score
FROM s_features) r WHERE coalesce(total_housing_units, 0) > 0
"""


def features(t):
    return K.acs_features(t.v_acs)


def base(t):
    return T.base_pressure(t.v_products, t.v_cves, None, None)


def scored(t):
    return jobs.scores_v2(t.v_acs, t.v_products, t.v_cves, digits=False)


@query("acs_features", f"SELECT {', '.join(ACS_OUT)} FROM f_acs", _ACS_DOUBLES)
def _(t):
    return features(t).select(*ACS_OUT)


@query("filter_inhabited", "SELECT geo_id, total_housing_units FROM f_acs WHERE coalesce(total_housing_units, 0) > 0", ["total_housing_units"])
def _(t):
    return K.filter_inhabited(features(t)).select("geo_id", "total_housing_units")


@query("filter_zip_range", "SELECT geo_id FROM v_acs WHERE geo_id BETWEEN '90001' AND '96162'")
def _(t):
    return K.filter_zip_range(t.v_acs, *C.ALERT_ZCTA_RANGES["CA"]).select("geo_id")


@query("zip3_state", "SELECT geo_id, state FROM s_state")
def _(t):
    return t.v_acs.select("geo_id", zip3_state(F.col("geo_id")).alias("state"))


_FIPS = sql_case([(f"state = '{s}'", f"'{f}'") for s, f in C.STATE_FIPS.items()], "NULL")
STEPS["s_fips"] = f"SELECT *, {_FIPS} AS state_fips FROM s_state"


def with_fips(t):
    return features(t).withColumn("state_fips", K.state_fips(zip3_state(F.col("geo_id"))))


@query("fips_state", "SELECT geo_id, state_fips, CASE WHEN state_fips IS NOT NULL THEN state END AS state FROM s_fips")
def _(t):
    return with_fips(t).select("geo_id", "state_fips", K.fips_state(F.col("state_fips")).alias("state"))


@query("filter_state", f"SELECT geo_id, state_fips FROM s_fips WHERE state IN ({sql_list(C.HIGH_SOLAR_STATES)})")
def _(t):
    return K.filter_state(with_fips(t), C.HIGH_SOLAR_STATES).select("geo_id", "state_fips")


@query("state_summary", """
SELECT state_fips, count(geo_id) AS zcta_count, sum(total_housing_units) AS total_housing_units, sum(total_population) AS total_population,
       avg(single_family_share) AS avg_single_family_share, avg(owner_occupancy_rate) AS avg_owner_occupancy_rate,
       avg(solar_candidate_share) AS avg_solar_candidate_share, median(median_home_value) AS median_home_value,
       median(median_household_income) AS median_household_income
FROM s_fips WHERE state_fips IS NOT NULL GROUP BY state_fips
""", ["total_housing_units", "total_population", "avg_single_family_share", "avg_owner_occupancy_rate", "avg_solar_candidate_share",
      "median_home_value", "median_household_income"])
def _(t):
    return K.state_summary(with_fips(t))


@query("state_weight", "SELECT geo_id, state, state_solar_weight FROM s_weight", ["state_solar_weight"])
def _(t):
    return K.map_states(t.v_acs).select("geo_id", "state", "state_solar_weight")


@query("union_capacity", f"""
SELECT state, count(*) AS communities, max(gw) AS solar_gw FROM s_state LEFT JOIN (VALUES {', '.join(f"('{s}', {gw}::DOUBLE)" for s, gw in _CAPS.items())}) w(ws, gw) ON state = ws
WHERE state IS NOT NULL GROUP BY state
""", ["solar_gw"])
def _(t):
    capacities = t.spark.createDataFrame(list(state_capacity().items()), "state string, solar_gw double")
    states = t.v_acs.select(zip3_state(F.col("geo_id")).alias("state")).filter(F.col("state").isNotNull())
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("communities")).join(capacities, "state", "left")


@query("scan_grid_dim", f"""
SELECT coalesce(g.code, d.code) AS code, scope, solar_gw, grid_critical, coalesce(devices, 0) AS devices
FROM (SELECT country AS code, count(*) AS devices FROM v_devices GROUP BY country) d
FULL JOIN (VALUES {', '.join(f"('{c}', 'country', {gw}::DOUBLE, {str(k).lower()})" for c, gw, k in C.EUROPE_GRID)},
      {', '.join(f"('{c}', 'state', {gw}::DOUBLE, {str(k).lower()})" for c, gw, k in C.STATE_GRID)}) g(code, scope, solar_gw, grid_critical)
  ON d.code = g.code
""", ["solar_gw"])
def _(t):
    from gridrisk.sources.readers import grid_dimension

    counts = t.v_devices.groupBy(F.col("country").alias("code")).agg(F.count(F.lit(1)).alias("devices"))
    return grid_dimension(t.spark).join(counts, "code", "full").fillna(0, ["devices"])


@query("state_pressure", "SELECT geo_id, solar_cyber_pressure_score FROM s_features", ["solar_cyber_pressure_score"])
def _(t):
    return K.state_pressure(K.map_states(t.v_acs), base(t), None).select("geo_id", "solar_cyber_pressure_score")


@query("income_interaction", "SELECT geo_id, income_solar_interaction FROM s_features", ["income_solar_interaction"])
def _(t):
    return K.income_interaction(features(t), None).select("geo_id", "income_solar_interaction")


@query("age_factor", "SELECT geo_id, age_risk_factor FROM s_features", ["age_risk_factor"])
def _(t):
    return K.age_factor(features(t), None).select("geo_id", "age_risk_factor")


@query("readiness_v2", "SELECT geo_id, total_population, solar_readiness_score FROM s_scored", ["total_population", "solar_readiness_score"])
def _(t):
    return scored(t).select("geo_id", "total_population", "solar_readiness_score")


SCORED_OUT = [
    "geo_id", "state", "state_solar_weight", "solar_cyber_pressure_score", "income_solar_interaction", "age_risk_factor",
    "solar_readiness_score", "community_risk_prior_score", "solar_cve_count",
]


@query("community_scores", f"""
SELECT {', '.join(c for c in SCORED_OUT[:-1])}, b.solar_cve_count FROM s_scored, (SELECT solar_cve_count FROM base_row) b
""", SCORED_OUT[2:-1])
def community_scores(t):
    return K.rank_communities(scored(t)).select(*SCORED_OUT)


@query("score_by_state", """
SELECT state, avg(community_risk_prior_score) AS mean_score, count(*) AS communities FROM s_scored WHERE state IS NOT NULL
GROUP BY state ORDER BY mean_score DESC, state LIMIT 10
""", ["mean_score"])
def _(t):
    return K.score_by_state(scored(t))


@query("weight_by_state", """
SELECT state, max(state_solar_weight) AS state_solar_weight FROM s_weight WHERE state IS NOT NULL
GROUP BY state ORDER BY state_solar_weight DESC, state LIMIT 10
""", ["state_solar_weight"])
def _(t):
    return K.weight_by_state(K.map_states(t.v_acs))


@query("top_candidate_zctas", """
SELECT geo_id, solar_candidate_share FROM f_acs WHERE coalesce(total_housing_units, 0) > 0
ORDER BY solar_candidate_share DESC, geo_id LIMIT 10
""", ["solar_candidate_share"])
def _(t):
    return K.top_candidates(K.filter_inhabited(features(t))).select("geo_id", "solar_candidate_share")


# --- alerts --------------------------------------------------------------------------------
STEPS["r_alert"] = f"""
SELECT geo_id, 0.45 * sf + 0.35 * ow + 0.20 * hv AS solar_readiness FROM (
SELECT geo_id, {sql_clip('coalesce(single_family_detached_units, 0) / greatest(coalesce(total_housing_units, 0), 1)')} AS sf,
       {sql_clip('coalesce(owner_occupied_units, 0) / greatest(coalesce(total_housing_units, 0), 1)')} AS ow,
       CASE WHEN coalesce(median_home_value, 0) >= 750000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hv FROM f_base) a
"""
_NAMES = "CASE WHEN contains(lower(description), '{v}') THEN '{v}' END"
STEPS["cve_tags"] = f"""
SELECT *, coalesce(concat_ws(', ', {', '.join(_NAMES.format(v=v) for v in C.ALERT_VENDORS)}), '') AS named FROM h_v3
"""
STEPS["cve_urgent"] = """
SELECT t.cve_id, t.cvss_v3_score, CASE WHEN named = '' THEN 'unknown vendor' ELSE named END AS affected_vendors,
       CASE WHEN named = '' THEN coalesce(cvss_v3_score, 0) / 10
            ELSE coalesce((SELECT max(cyber_pressure_score) FROM pressure_rows p WHERE contains(', ' || t.named || ',', ', ' || p.vendor || ',')), 0) END AS vendor_cyber_pressure
FROM cve_tags t
"""


def readiness(t):
    return K.readiness_alert(t.v_acs)


def pressure(tagged):
    return T.vendor_pressure_text(tagged, digits=None)


@query("readiness_alert", "SELECT * FROM r_alert", ["solar_readiness"])
def _(t):
    return readiness(t).select("geo_id", "solar_readiness")


@query("filter_alert_threshold", "SELECT cve_id, cvss_v3_score, named FROM cve_tags WHERE cvss_v3_score >= 7 AND named <> ''", ["cvss_v3_score"])
def _(t):
    return K.filter_alert_threshold(TC.v3_rows(t)).select("cve_id", "cvss_v3_score", F.array_join("vendor_keywords_matched", ", ").alias("named"))


@query("cve_urgency", "SELECT cve_id, affected_vendors, vendor_cyber_pressure FROM cve_urgent", ["vendor_cyber_pressure"])
def _(t):
    rows = TC.v3_rows(t)
    return K.cve_urgency(rows, pressure(rows))


STEPS["one_cve"] = """
SELECT u.* FROM cve_urgent u JOIN cve_tags c ON u.cve_id = c.cve_id WHERE c.cvss_v3_score IS NOT NULL AND named <> ''
ORDER BY c.cvss_v3_score DESC, u.cve_id LIMIT 1
"""


@query("join_alert", """
SELECT geo_id, solar_readiness, cve_id, affected_vendors, vendor_cyber_pressure, vendor_cyber_pressure * solar_readiness AS alert_score
FROM r_alert, one_cve
""", ["solar_readiness", "vendor_cyber_pressure", "alert_score"])
def _(t):
    rows = TC.v3_rows(t)
    newest = K.filter_alert_threshold(rows, None).orderBy(F.desc("cvss_v3_score"), "cve_id").limit(1)
    return K.join_alert(readiness(t), K.cve_urgency(newest, pressure(rows)))


STEPS["alert_rows"] = """
SELECT cve_id, geo_id, affected_vendors, vendor_cyber_pressure, solar_readiness, alert_score FROM (
  SELECT u.cve_id, geo_id, affected_vendors, vendor_cyber_pressure, solar_readiness, vendor_cyber_pressure * solar_readiness AS alert_score,
         row_number() OVER (PARTITION BY u.cve_id ORDER BY vendor_cyber_pressure * solar_readiness DESC,
                            CASE WHEN vendor_cyber_pressure > 0 THEN solar_readiness END DESC, geo_id) AS place
  FROM cve_urgent u JOIN cve_tags c ON u.cve_id = c.cve_id, r_alert WHERE c.cvss_v3_score >= 7 AND named <> '') ranked WHERE place <= 10
"""


@query("alert_top_n", "SELECT * FROM alert_rows", ["vendor_cyber_pressure", "solar_readiness", "alert_score"])
def _(t):
    rows = TC.v3_rows(t)
    return K.alert_top_n(K.cve_urgency(K.filter_alert_threshold(rows), pressure(rows)), readiness(t))


# --- views and lookups ---------------------------------------------------------------------
STEPS["located"] = "SELECT s.*, c.lat, c.lon FROM s_scored s JOIN v_centroids c ON s.geo_id = c.geo_id"


def located(t):
    return W.join_centroids(scored(t), t.v_centroids)


@query("join_centroids", "SELECT geo_id, lat, lon, community_risk_prior_score FROM located", ["lat", "lon", "community_risk_prior_score"])
def _(t):
    return located(t).select("geo_id", "lat", "lon", "community_risk_prior_score")


_VIEW = [c for c in W.RISK_COLUMNS if not c.startswith("risk_cluster")]


@query("view_risk", f"SELECT {', '.join(_VIEW)} FROM located", [c for c in _VIEW if c not in ("geo_id", "state")])
def _(t):
    return W.view_risk(scored(t), t.v_centroids)


@query("view_top_zips", f"SELECT {', '.join(W.TOP_COLUMNS)} FROM located ORDER BY community_risk_prior_score DESC, geo_id LIMIT 25", W.TOP_COLUMNS[1:])
def _(t):
    return W.view_top_zips(located(t))


STEPS["clustered"] = """
SELECT *, CAST(total_housing_units AS BIGINT) // 100 AS cluster_id FROM located
"""
STEPS["cluster_order"] = f"""
SELECT cluster_id, row_number() OVER (ORDER BY avg(community_risk_prior_score), cluster_id) - 1 AS risk_cluster FROM clustered GROUP BY cluster_id
"""
_CLUSTER_LABEL = sql_case([(f"risk_cluster = {i}", f"'{n}'") for i, n in enumerate(C.CLUSTER_LABELS)], "NULL")
STEPS["cluster_named"] = f"SELECT c.*, risk_cluster, {_CLUSTER_LABEL} AS risk_cluster_label FROM clustered c JOIN cluster_order o ON c.cluster_id = o.cluster_id"


def clustered(t):
    """Communities with a reproducible cluster id (size classes stand in for k-means)."""
    return located(t).withColumn("cluster_id", F.floor(F.col("total_housing_units") / 100))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE risk_cluster_label = '{n}') AS {n.lower()}_count" for n in reversed(C.CLUSTER_LABELS))


@query("view_stats", f"""
SELECT count(*) AS total_zctas, {_COUNTS}, avg(community_risk_prior_score) AS avg_risk_score,
       printf('%.1f-%.1f', min(solar_cyber_pressure_score), max(solar_cyber_pressure_score)) AS cyber_pressure_range,
       (SELECT count(DISTINCT cve_id) FROM pr_curated) AS total_cves, (SELECT count(*) FROM pr_curated WHERE cvss_score >= 9) AS critical_cves,
       (SELECT max(cvss_score) FROM pr_curated) AS max_cvss, (SELECT count(*) FROM vendor_prior_rows) AS vendor_count
FROM cluster_named
""", ["avg_risk_score", "max_cvss"])
def _(t):
    from gridrisk.operators.model import cluster_rank

    curated = TC.curated_table(t)
    return W.view_stats(cluster_rank(clustered(t)), curated, T.vendor_priors(curated), None)


@query("join_zip_lookup", """
SELECT record_id, zip_code, s.geo_id, s.state AS state, round_even(s.solar_candidate_share, 3) AS solar_candidate_share,
       round_even(s.single_family_share, 3) AS single_family_share, median_home_value, CAST(s.total_housing_units AS BIGINT) AS total_units
FROM v_parcels p LEFT JOIN s_scored s ON p.zip_code = s.geo_id
""", ["median_home_value"])
def _(t):
    return L.join_zip_lookup(t.v_parcels, scored(t)).select(
        "record_id", "zip_code", "geo_id", "state", "solar_candidate_share", "single_family_share", "median_home_value", "total_units"
    )


_PARTS = "string_split(address, ',')"


@query("address_split_batch", r"""
SELECT record_id, trim(coalesce(s[1], '')) AS street, trim(coalesce(s[2], '')) AS city,
       upper(regexp_extract(trim(coalesce(s[3], '')), '^([A-Za-z]{2})\s*([0-9]{5})?', 1)) AS state,
       regexp_extract(trim(coalesce(s[3], '')), '^([A-Za-z]{2})\s*([0-9]{5})?', 2) AS zip
FROM (SELECT record_id, string_split(address, ',') AS s FROM (
  SELECT record_id, coalesce(property_address, '') || ', ' || city || CASE WHEN record_id % 5 = 0 THEN '' ELSE ', ' || lower(state) || ' ' || CASE WHEN record_id % 7 = 0 THEN '' ELSE zip_code END END AS address
  FROM v_parcels) a) b
""")
def _(t):
    state = F.concat(F.lit(", "), F.lower("state"), F.lit(" "), F.when(F.col("record_id") % 7 == 0, "").otherwise(F.col("zip_code")))
    address = F.concat(
        F.coalesce("property_address", F.lit("")), F.lit(", "), F.col("city"), F.when(F.col("record_id") % 5 == 0, "").otherwise(state)
    )
    return t.v_parcels.select("record_id", L.address_split(address).alias("a")).select("record_id", "a.*")


def responses(t):
    """Lookup responses as JSON text: some flat, some nested, some unmatched."""
    from gridrisk.sources.schemas import PROPERTY_RESPONSE_SCHEMA

    rid = F.col("record_id")
    flat = rid % 2 == 0
    record = F.struct(
        F.when(rid % 9 == 0, "XX01").otherwise(F.lit("AS01,YS02")).alias("Results"),
        F.when(flat, F.col("property_address")).alias("AddressLine1"),
        F.when(flat, F.concat("zip_code", F.lit("-1234"))).alias("PostalCode"),
        F.col("city").alias("City"),
        F.col("state").alias("State"),
        F.when(flat, F.col("year_built").cast("string")).alias("YearBuilt"),
        F.col("bedrooms").cast("string").alias("Bedrooms"),
        F.when(rid % 3 == 0, "Y").when(rid % 3 == 1, "R").otherwise(F.lit("?")).alias("OwnerOccupied"),
        F.struct(F.col("property_address").alias("AddressLine1"), F.col("zip_code").alias("PostalCode")).alias("Address"),
        F.struct(F.col("latitude").cast("string").alias("Latitude"), F.col("longitude").cast("string").alias("Longitude")).alias("GeoCode"),
        F.struct(F.col("year_built").cast("string").alias("YearBuilt")).alias("PropertyUseInfo"),
        F.struct(F.when(rid % 4 != 0, F.col("total_assessed_value").cast("string")).alias("MarketValueTotal")).alias("Tax"),
        F.struct(F.col("sales_price").cast("string").alias("EstimatedValue")).alias("Valuation"),
    )
    text = t.v_parcels.select(F.to_json(F.struct(rid.alias("request_id"), F.array(record).alias("Records"))).alias("body"))
    return text.select(F.from_json("body", PROPERTY_RESPONSE_SCHEMA).alias("r")).select("r.*")


_MATCHED = "record_id % 9 <> 0"


@query("property_flatten_batch", f"""
SELECT record_id AS request_id, coalesce(property_address, '') AS address, zip_code, city, state, CASE WHEN latitude > 0 THEN latitude END AS lat,
       CASE WHEN longitude > 0 THEN longitude END AS lon, CAST(year_built AS BIGINT) AS year_built,
       CASE WHEN bedrooms > 0 THEN CAST(bedrooms AS BIGINT) END AS bedrooms,
       CASE record_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS owner_occupied,
       CASE WHEN v > 0 THEN v END AS market_value
FROM (SELECT *, CASE WHEN record_id % 4 <> 0 THEN total_assessed_value ELSE sales_price END AS v FROM v_parcels) p WHERE {_MATCHED}
""", ["lat", "lon", "market_value"])
def _(t):
    return L.property_flatten(responses(t)).select(
        "request_id", "address", "zip_code", "city", "state", "lat", "lon", "year_built", "bedrooms", "owner_occupied", "market_value"
    )


@query("filter_result_codes", f"SELECT record_id AS request_id FROM v_parcels WHERE {_MATCHED}")
def _(t):
    rows = responses(t).select("request_id", F.get("Records", F.lit(0)).alias("r"))
    return L.filter_result_codes(rows, "r.Results").select("request_id")
