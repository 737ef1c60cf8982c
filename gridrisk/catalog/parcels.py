"""Queries over parcels, valuations and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk.catalog.registry import STEPS, query, sql_digits, sql_state, sql_text
from gridrisk.functions import text as X
from gridrisk.operators import community as K
from gridrisk.operators import parcels as P
from gridrisk.operators import threat as T
from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table


def _key(address: str) -> str:
    return (
        f"{sql_text(address)} || '|' || {sql_text('city')} || '|' || {sql_state('state')} || '|' || "
        f"{sql_digits('zip_code', 5)}"
    )


_GEO_KEY = f"{sql_state('state')} || '|' || {sql_digits('zip_code', 5)} || '|' || {sql_digits('zip4', 4)}"

STEPS["p_norm"] = f"""
SELECT *, {_key('property_address')} AS address_key, {_GEO_KEY} AS geo_join_key,
       contains(lower(land_use), 'residential') AS is_residential,
       contains(lower(land_use), 'single family') AS is_single_family,
       2026 - year_built AS property_age
FROM v_parcels
"""
STEPS["a_norm"] = f"""
SELECT * FROM (SELECT *, {_key('address')} AS address_key FROM v_avm) a
WHERE state IN (SELECT state FROM v_parcels) AND zip_code IN (SELECT zip_code FROM v_parcels)
"""
STEPS["a_latest"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY address_key ORDER BY valuation_date DESC NULLS LAST, record_id_avm) AS rn
  FROM a_norm) x WHERE rn = 1
"""
STEPS["g_first"] = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY geo_join_key ORDER BY record_id_geo) AS rn
  FROM (SELECT *, {_GEO_KEY} AS geo_join_key FROM v_geo) g) x WHERE rn = 1
"""
STEPS["p_joined"] = """
SELECT p.*, a.record_id_avm AS avm_record_id, a.final_value, a.high_value AS avm_high_value,
       a.low_value AS avm_low_value, a.valuation_date AS avm_valuation_date,
       g.geo_fips_code, g.geo_census_key, g.geo_census_key_decennial, g.geo_latitude, g.geo_longitude
FROM p_norm p LEFT JOIN a_latest a ON p.address_key = a.address_key
LEFT JOIN g_first g ON p.geo_join_key = g.geo_join_key
"""
STEPS["p_enriched"] = """
SELECT *, is_residential AND coalesce(number_of_units, 0) <= 2
          AND effective_latitude IS NOT NULL AND effective_longitude IS NOT NULL AS solar_candidate_home
FROM (
SELECT *, avm_record_id IS NOT NULL AS matched_avm, geo_census_key IS NOT NULL AS matched_geo,
       avm_high_value - avm_low_value AS value_spread,
       CASE WHEN fips_code <> '' THEN fips_code ELSE geo_fips_code END AS effective_fips_code,
       coalesce(census_key, geo_census_key) AS effective_census_key,
       coalesce(census_key_decennial, geo_census_key_decennial) AS effective_census_key_decennial,
       coalesce(latitude, geo_latitude) AS effective_latitude,
       coalesce(longitude, geo_longitude) AS effective_longitude,
       total_assessed_value / nullif(final_value, 0) AS assessed_to_avm_ratio,
       coalesce(garage_cars, 0) > 0 AS has_garage,
       coalesce(final_value, total_assessed_value) >= 1000000 AS high_value_home
FROM p_joined) e
"""


def _community_sql(key: str) -> str:
    return f"""
SELECT {key}, count(record_id) AS parcel_count,
       count(*) FILTER (WHERE is_residential) AS residential_parcel_count,
       count(*) FILTER (WHERE is_single_family) AS single_family_count,
       count(*) FILTER (WHERE solar_candidate_home) AS solar_candidate_count,
       count(*) FILTER (WHERE matched_avm) AS matched_avm_count,
       count(*) FILTER (WHERE matched_geo) AS matched_geo_count,
       avg(total_assessed_value) AS mean_assessed_value, avg(final_value) AS mean_final_value,
       avg(number_of_units) AS avg_units, avg(number_of_buildings) AS avg_buildings,
       avg(CAST(has_garage AS INT)) AS garage_share, avg(CAST(high_value_home AS INT)) AS high_value_share,
       median(total_assessed_value) AS median_assessed_value, median(final_value) AS median_final_value,
       median(lot_size) AS median_lot_size, median(CAST(year_built AS DOUBLE)) AS median_year_built,
       median(CAST(property_age AS DOUBLE)) AS median_property_age,
       median(CAST(bedrooms AS DOUBLE)) AS median_bedrooms, median(baths) AS median_baths,
       count(*) FILTER (WHERE is_residential) / count(record_id) AS residential_share,
       count(*) FILTER (WHERE is_single_family) / count(record_id) AS single_family_share,
       count(*) FILTER (WHERE solar_candidate_home) / count(record_id) AS solar_candidate_share,
       count(*) FILTER (WHERE matched_avm) / count(record_id) AS avm_match_rate,
       count(*) FILTER (WHERE matched_geo) / count(record_id) AS geo_match_rate
FROM p_enriched WHERE {key} IS NOT NULL AND trim({key}) <> '' GROUP BY {key}
"""


for _name, _column in (("zip", "zip_code"), ("census", "effective_census_key_decennial"), ("fips", "effective_fips_code")):
    STEPS[f"c_{_name}"] = _community_sql(_column)

COMMUNITY_DOUBLES = [
    "mean_assessed_value", "mean_final_value", "avg_units", "avg_buildings", "garage_share",
    "high_value_share", "median_assessed_value", "median_final_value", "median_lot_size",
    "median_year_built", "median_property_age", "median_bedrooms", "median_baths",
    "residential_share", "single_family_share", "solar_candidate_share", "avm_match_rate",
    "geo_match_rate",
]
ENRICHED_DOUBLES = [
    "effective_latitude", "effective_longitude", "total_assessed_value", "sales_price",
    "final_value", "avm_high_value", "avm_low_value", "value_spread", "lot_size", "baths",
    "partial_baths", "assessed_to_avm_ratio",
]


def enriched(t):
    return P.enrich_parcels(t.v_parcels, t.v_avm, t.v_geo)


def parcel_table(t):
    """Enriched parcels as a written table: the rollups read them more than once."""
    return write_table(enriched(t), scratch_path(t.spark, "parcels"))


def joined(t):
    left = P.normalize_parcels(t.v_parcels)
    values = P.latest_avm(P.semi_avm_prefilter(P.normalize_avm(t.v_avm), left))
    return P.join_parcel_geo(P.join_parcel_avm(left, values), P.first_geo(P.normalize_geo(t.v_geo)))


# --- scalar functions ----------------------------------------------------------------------
@query("norm_text", f"SELECT doc_id, md5({sql_text('text')}) AS norm_md5, length({sql_text('text')}) AS norm_length FROM documents")
def _(t):
    norm = X.norm_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("bigint").alias("norm_length"))


@query("norm_zip", f"SELECT c_custkey, {sql_digits('c_name', 5)} AS zip FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.norm_zip(F.col("c_name")).alias("zip"))


@query("norm_fips", f"""SELECT c_custkey, {sql_digits("CAST(c_nationkey AS STRING)", 5)} AS fips FROM customer""")
def _(t):
    return t.customer.select("c_custkey", X.norm_fips(F.col("c_nationkey").cast("string")).alias("fips"))


@query("norm_zip4", f"SELECT record_id_geo, {sql_digits('zip4', 4)} AS zip4 FROM v_geo")
def _(t):
    return t.v_geo.select("record_id_geo", X.norm_zip4(F.col("zip4")).alias("zip4"))


@query("norm_state", f"SELECT page_id, {sql_state('title')} AS state FROM (SELECT seq AS page_id, title FROM v_observed) p")
def _(t):
    return t.v_observed.select(F.col("seq").alias("page_id"), X.norm_state(F.col("title")).alias("state"))


@query("pad_geo_id", """
SELECT o_orderkey, CASE WHEN length(k) < 5 THEN lpad(k, 5, '0') ELSE k END AS geo_id
FROM (SELECT o_orderkey, CAST(o_orderkey * 37 AS STRING) AS k FROM orders) o
""")
def _(t):
    return t.orders.select("o_orderkey", X.pad_geo_id((F.col("o_orderkey") * 37).cast("string")).alias("geo_id"))


@query("to_number", """
SELECT event_id, try_cast(props AS DOUBLE) AS whole, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS part,
       try_cast(event_type AS DOUBLE) AS kind FROM events
""", ["whole", "part", "kind"])
def _(t):
    part = F.regexp_extract("props", "([0-9]+)", 1)
    return t.events.select(
        "event_id",
        X.to_number(F.col("props")).alias("whole"),
        X.to_number(part).alias("part"),
        X.to_number(F.col("event_type")).alias("kind"),
    )


@query("address_key", "SELECT record_id, address_key FROM p_norm")
def _(t):
    return P.normalize_parcels(t.v_parcels).select("record_id", "address_key")


@query("geo_join_key", "SELECT record_id, geo_join_key FROM p_norm")
def _(t):
    return P.normalize_parcels(t.v_parcels).select("record_id", "geo_join_key")


@query("land_use_flags", "SELECT record_id, is_residential, is_single_family FROM p_norm")
def _(t):
    return P.land_use_flags(t.v_parcels).select("record_id", "is_residential", "is_single_family")


@query("property_age", "SELECT record_id, CAST(property_age AS BIGINT) AS property_age FROM p_norm")
def _(t):
    return t.v_parcels.select("record_id", P.property_age(F.col("year_built")).cast("bigint").alias("property_age"))


_EFFECTIVE = [
    "record_id", "effective_fips_code", "effective_census_key", "effective_census_key_decennial",
    "effective_latitude", "effective_longitude",
]


@query("effective_cols", f"SELECT {', '.join(_EFFECTIVE)} FROM p_enriched", ["effective_latitude", "effective_longitude"])
def _(t):
    return P.effective_columns(joined(t)).select(*_EFFECTIVE)


@query("value_features", "SELECT record_id, value_spread, assessed_to_avm_ratio FROM p_enriched",
       ["value_spread", "assessed_to_avm_ratio"])
def _(t):
    return P.value_features(joined(t)).select("record_id", "value_spread", "assessed_to_avm_ratio")


@query("parcel_flags", "SELECT record_id, has_garage, high_value_home, solar_candidate_home FROM p_enriched")
def _(t):
    flagged = P.parcel_flags(P.effective_columns(joined(t)))
    return flagged.select("record_id", "has_garage", "high_value_home", "solar_candidate_home")


@query("match_flags", "SELECT record_id, matched_avm, matched_geo FROM p_enriched")
def _(t):
    return P.match_flags(joined(t)).select("record_id", "matched_avm", "matched_geo")


# --- joins, filters, deduplication ---------------------------------------------------------
@query("join_parcel_avm", """
SELECT p.record_id, a.record_id_avm AS avm_record_id, a.final_value, a.valuation_date AS avm_valuation_date
FROM p_norm p LEFT JOIN a_latest a ON p.address_key = a.address_key
""", ["final_value"])
def _(t):
    left = P.normalize_parcels(t.v_parcels)
    values = P.latest_avm(P.semi_avm_prefilter(P.normalize_avm(t.v_avm), left))
    return P.join_parcel_avm(left, values).select("record_id", "avm_record_id", "final_value", "avm_valuation_date")


@query("join_parcel_geo", """
SELECT p.record_id, g.geo_fips_code, g.geo_census_key, g.geo_latitude
FROM p_norm p LEFT JOIN g_first g ON p.geo_join_key = g.geo_join_key
""", ["geo_latitude"])
def _(t):
    left = P.normalize_parcels(t.v_parcels)
    return P.join_parcel_geo(left, P.first_geo(P.normalize_geo(t.v_geo))).select(
        "record_id", "geo_fips_code", "geo_census_key", "geo_latitude"
    )


@query("semi_avm_prefilter", "SELECT record_id_avm, address_key FROM a_norm")
def _(t):
    kept = P.semi_avm_prefilter(P.normalize_avm(t.v_avm), P.normalize_parcels(t.v_parcels))
    return kept.select("record_id_avm", "address_key")


@query("latest_avm", """
SELECT address_key, record_id_avm, valuation_date FROM (
  SELECT *, row_number() OVER (PARTITION BY address_key ORDER BY valuation_date DESC NULLS LAST, record_id_avm) AS rn
  FROM a_norm) x WHERE rn = 1
""")
def _(t):
    return P.latest_avm(P.normalize_avm(t.v_avm)).select("address_key", "record_id_avm", "valuation_date")


@query("first_geo", "SELECT geo_join_key, record_id_geo, geo_census_key FROM g_first")
def _(t):
    return P.first_geo(P.normalize_geo(t.v_geo)).select("geo_join_key", "record_id_geo", "geo_census_key")


@query("filter_valid_group_key", "SELECT record_id, fips_code FROM v_parcels WHERE trim(fips_code) <> ''")
def _(t):
    return P.filter_valid_group_key(t.v_parcels, "fips_code").select("record_id", "fips_code")


@query("enriched_parcels", f"SELECT {', '.join(P.ENRICHED_COLUMNS)} FROM p_enriched", ENRICHED_DOUBLES)
def _(t):
    return enriched(t)


@query("sort_parcels", "SELECT record_id, state, zip_code, city, property_address FROM p_norm")
def _(t):
    return P.sort_parcels(P.normalize_parcels(t.v_parcels)).select("record_id", "state", "zip_code", "city", "property_address")


# --- aggregation and ranking ---------------------------------------------------------------
@query("community_agg_zip", "SELECT * FROM c_zip", COMMUNITY_DOUBLES)
def _(t):
    return P.community_agg(parcel_table(t), "zip_code")


@query("community_agg_census", "SELECT * FROM c_census", COMMUNITY_DOUBLES)
def _(t):
    return P.community_agg(parcel_table(t), "effective_census_key_decennial")


@query("community_agg_fips", "SELECT * FROM c_fips", COMMUNITY_DOUBLES)
def _(t):
    return P.community_agg(parcel_table(t), "effective_fips_code")


_LEVELS = {"zip": "zip_code", "census": "effective_census_key_decennial", "fips": "effective_fips_code"}
_LEVEL_SQL = "\nUNION ALL ".join(
    f"SELECT '{level}' AS level, {key} AS geo_id, * EXCLUDE ({key}) FROM c_{level}" for level, key in _LEVELS.items()
)


@query("community_agg", _LEVEL_SQL, COMMUNITY_DOUBLES)
def _(t):
    """All three levels in one schema, in one pass over the written parcel table."""
    return P.community_agg_levels(parcel_table(t), _LEVELS)


@query("geo_id_rename", "SELECT zip_code AS geo_id, parcel_count FROM c_zip")
def _(t):
    return K.geo_id_rename(P.community_agg(parcel_table(t), "zip_code"), "zip_code").select("geo_id", "parcel_count")


STEPS["c_scored"] = """
SELECT *, 0.55 * solar_readiness_score + 0.45 * solar_cyber_pressure_score AS community_risk_prior_score FROM (
SELECT zip_code AS geo_id, c.* EXCLUDE (zip_code), gp.*,
       100 * (0.35 * single_family_share + 0.25 * residential_share + 0.20 * solar_candidate_share
              + 0.10 * high_value_share + 0.10 * garage_share) AS solar_readiness_score
FROM c_zip c, global_prior_row gp) s
"""
SCORED_V1 = ["geo_id", "parcel_count", "solar_cyber_pressure_score", "solar_readiness_score", "community_risk_prior_score"]


def scored_v1(t):
    curated = write_table(T.curate(t.v_products, t.v_cves), scratch_path(t.spark, "curated"))
    priors = T.global_priors(curated, T.vendor_priors(curated, None), None, None)
    return K.score_v1(P.community_agg(parcel_table(t), "zip_code"), priors, "zip_code", None)


@query("readiness_v1", "SELECT geo_id, solar_readiness_score FROM c_scored", ["solar_readiness_score"])
def _(t):
    return K.readiness_v1(P.community_agg(parcel_table(t), "zip_code")).select(
        F.col("zip_code").alias("geo_id"), "solar_readiness_score"
    )


@query("rank_communities", f"SELECT {', '.join(SCORED_V1)} FROM c_scored", SCORED_V1[2:])
def rank_communities(t):
    return scored_v1(t).select(*SCORED_V1)


@query("community_score", "SELECT geo_id, community_risk_prior_score FROM c_scored", ["community_risk_prior_score"])
def _(t):
    return scored_v1(t).select("geo_id", "community_risk_prior_score")


@query("join_global_priors", """
SELECT zip_code, parcel_count, solar_cve_count, solar_vendor_count, solar_avg_cvss, solar_cyber_pressure_score
FROM c_zip, global_prior_row
""", ["solar_avg_cvss", "solar_cyber_pressure_score"])
def _(t):
    curated = write_table(T.curate(t.v_products, t.v_cves), scratch_path(t.spark, "curated"))
    priors = T.global_priors(curated, T.vendor_priors(curated, None), None, None)
    return K.join_global_priors(P.community_agg(parcel_table(t), "zip_code"), priors).select(
        "zip_code", "parcel_count", "solar_cve_count", "solar_vendor_count", "solar_avg_cvss", "solar_cyber_pressure_score"
    )
