"""Queries over observations, devices and fleets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk import adapters, constants as C
from gridrisk.catalog.registry import STEPS, query, sql_case, sql_contains_any, sql_list
from gridrisk.functions import matching as M
from gridrisk.functions.geo import critical_regions
from gridrisk.operators import containment as K
from gridrisk.operators import devices as D

# --- observations --------------------------------------------------------------------------
_TEXT = "lower(coalesce(data, '') || ' ' || coalesce(product, '') || ' ' || coalesce(title, '') || ' ' || coalesce(html, ''))"


def _first_vendor(text: str) -> str:
    return sql_case([(sql_contains_any(text, words), f"'{v}'") for v, words in C.BANNER_VENDOR_KEYWORDS], "'Unknown'")


def _firmware() -> str:
    hits = [
        f"nullif(regexp_extract(coalesce({text}, ''), '(?i){pattern}', 1), '')"
        for text in ("data", "headers", "html")
        for pattern in C.FIRMWARE_PATTERNS
    ]
    return f"coalesce({', '.join(hits)})"


STEPS["o_flat"] = f"""
SELECT seq AS ingest_seq, ip_str AS ip, port, {_first_vendor(_TEXT)} AS vendor, query_vendor, coalesce(product, '') AS product,
       coalesce(country_code, '') AS country, coalesce(title, '') AS http_title, cert_cn IS NOT NULL AS has_tls,
       coalesce(cert_cn, '') AS tls_cert_subject, port = 502 AS has_modbus, seq % 2 = 0 AS has_mqtt,
       {sql_contains_any('lower(data)', C.DEFAULT_CREDENTIAL_HINTS)} AS default_creds_indicator,
       {_firmware()} AS firmware_version, coalesce(substring(seen_at, 1, 10), '') AS last_seen,
       'obs-' || CAST(seq AS STRING) AS observation_id
FROM v_observed
"""
FLAT_COLUMNS = [
    "ingest_seq", "ip", "port", "vendor", "query_vendor", "product", "country", "http_title", "has_tls",
    "tls_cert_subject", "has_modbus", "has_mqtt", "default_creds_indicator", "firmware_version", "last_seen",
    "observation_id",
]


def observed(t):
    return adapters.observations(t.v_observed).withColumns(
        {"transport": F.lit(None).cast("string"), **{c: F.lit(None).cast("string") for c in ("os", "org", "isp", "asn")}}
    ).withColumn("hostnames", F.lit(None).cast("array<string>")).withColumn(
        "location",
        F.struct(
            F.col("location.country_code").alias("country_code"),
            *[F.lit(None).cast("string").alias(c) for c in ("country_name", "region_code", "city")],
            *[F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")],
        ),
    )


@query("identify_vendor", f"SELECT page_id, {_first_vendor('lower(html)')} AS vendor FROM pages")
def _(t):
    nothing = F.lit(None).cast("string")
    return t.pages.select("page_id", M.identify_vendor(nothing, nothing, nothing, F.col("html")).alias("vendor"))


@query("default_creds_flag", f"SELECT doc_id, {sql_contains_any('lower(text)', C.DEFAULT_CREDENTIAL_HINTS)} AS hinted FROM documents")
def _(t):
    return t.documents.select("doc_id", M.default_credentials(F.col("text")).alias("hinted"))


@query("firmware_extract", f"SELECT seq, {_firmware()} AS firmware_version FROM v_observed")
def _(t):
    return t.v_observed.select("seq", M.firmware_version(F.col("data"), F.col("headers"), F.col("html")).alias("firmware_version"))


@query("flatten_device", f"SELECT {', '.join(FLAT_COLUMNS)} FROM o_flat")
def _(t):
    return D.flatten_device(observed(t)).select(*FLAT_COLUMNS)


_TITLE_TEXT = "lower(coalesce(title, ''))"
_BODY_TEXT = "lower(coalesce(data, '') || ' ' || coalesce(html, ''))"


def _rule_sql() -> str:
    selects = []
    for vendor, name, words, titles, ports in C.BANNER_RULES:
        conditions = [f"contains({_BODY_TEXT}, '{w}')" for w in words]
        conditions += [f"contains({_TITLE_TEXT}, '{w}')" for w in titles]
        if ports:
            conditions.append(f"port IN ({', '.join(map(str, ports))})")
        selects.append(f"SELECT seq, '{vendor}' AS rule_vendor, '{name}' AS rule FROM v_observed WHERE {' AND '.join(conditions)}")
    return "\nUNION ALL ".join(selects)


@query("rule_match_banners", _rule_sql())
def _(t):
    body = F.concat_ws(" ", F.coalesce("data", F.lit("")), F.coalesce("html", F.lit("")))
    return K.matched_rules(t.v_observed, "seq", K.banner_rule_table(t.spark), body, F.col("title"), F.array("port"))


@query("union_query_results", """
SELECT run, ip, port, ingest_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY ip, port ORDER BY run, ingest_seq) AS rn FROM (
    SELECT 0 AS run, ip, port, ingest_seq FROM v_devices WHERE port = 80
    UNION ALL SELECT 1, ip, port, ingest_seq FROM v_devices WHERE default_creds_indicator) u) x WHERE rn = 1
""")
def _(t):
    runs = D.union_query_results(t.v_devices.filter("port = 80"), t.v_devices.filter("default_creds_indicator"))
    first = D.first_per_key(runs, ["ip", "port"], F.col("run").asc(), F.col("ingest_seq").asc())
    return first.select("run", "ip", "port", "ingest_seq")


@query("union_chunks", "SELECT ingest_seq, ip, port FROM v_devices WHERE has_tls UNION ALL SELECT ingest_seq, ip, port FROM v_devices WHERE NOT has_tls")
def _(t):
    parts = [t.v_devices.filter("has_tls"), t.v_devices.filter("NOT has_tls"), t.v_devices.filter("port < 0")]
    return D.union_query_results(*parts).select("ingest_seq", "ip", "port")


# --- scores --------------------------------------------------------------------------------
STEPS["d_first"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ip, port ORDER BY ingest_seq) AS rn FROM v_devices) x WHERE rn = 1
"""
_KEY = sql_case([(f"contains(lower(coalesce(vendor, '')), '{w}')", f"'{k}'") for w, k in C.VENDOR_KEYWORDS], "NULL")
_FW = "lower(coalesce(firmware_version, ''))"
_FIRMWARE_RISK = sql_case(
    [
        (
            f"vendor_key = '{v}' AND {_FW} <> '' AND (contains({_FW}, '{fw.lower()}') OR contains('{fw.lower()}', {_FW}))",
            str(C.FIRMWARE_STATUS_RISK[s]),
        )
        for v, fw, s in C.VENDOR_FIRMWARE
    ],
    "NULL",
)
# Worst band per vendor, worked by hand from the dictionary.
_WORST = "CASE vendor_key WHEN 'Growatt' THEN 1.0 WHEN 'Sungrow' THEN 1.0 WHEN 'SMA' THEN 1.0 WHEN 'SolarView' THEN 1.0 WHEN 'Growatt_ShineLan' THEN 0.7 END"
_AGE = f"""CASE WHEN coalesce(firmware_version, '') = '' THEN 0.5
  WHEN {sql_contains_any('firmware_version', C.OLD_FIRMWARE_HINTS)} THEN 0.9
  WHEN try_cast(regexp_extract(firmware_version, '([0-9]+)\\.([0-9]+)', 1) AS BIGINT) IS NULL THEN 0.5
  WHEN try_cast(regexp_extract(firmware_version, '([0-9]+)\\.([0-9]+)', 1) AS BIGINT) <= 1 THEN 0.8
  WHEN try_cast(regexp_extract(firmware_version, '([0-9]+)\\.([0-9]+)', 1) AS BIGINT) <= 2 THEN 0.5 ELSE 0.2 END"""
_CVES = sql_case(
    [
        (f"vendor_key = '{v}'", "'" + ",".join(c for w, c, _ in C.VENDOR_CVES if w == v) + "'")
        for v in C.VENDOR_RISK_LEVEL
    ],
    "''",
)
STEPS["d_parts"] = f"""
SELECT *, CAST(coalesce({_FIRMWARE_RISK}, {_WORST}, 0.3) AS DOUBLE) AS cve_part, CAST({_AGE} AS DOUBLE) AS age_part,
       CAST(CASE WHEN country IN ({sql_list(critical_regions())}) THEN 1.0 ELSE 0.3 END AS DOUBLE) AS geo_part,
       {_CVES} AS matched_cves
FROM (SELECT *, {_KEY} AS vendor_key FROM d_first) k
"""
STEPS["d_scored"] = """
SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_severity
FROM (
SELECT *, CAST(least(round_even((0.0::DOUBLE + 0.30::DOUBLE * cve_part + 0.25::DOUBLE * CASE WHEN default_creds_indicator THEN 1 ELSE 0 END
   + 0.15::DOUBLE * CASE WHEN has_tls THEN 0 ELSE 1 END + 0.15::DOUBLE * CASE WHEN has_modbus OR has_mqtt THEN 1 ELSE 0 END
   + 0.10::DOUBLE * age_part + 0.05::DOUBLE * geo_part) * 100, 0), 100) AS BIGINT) AS risk_score
FROM d_parts) s
"""


def scored(t):
    return D.score_devices(D.dedup_device(t.v_devices))


@query("dedup_device", "SELECT ip, port, ingest_seq, vendor FROM d_first")
def _(t):
    return D.dedup_device(t.v_devices).select("ip", "port", "ingest_seq", "vendor")


@query("join_keyword_vendor", f"SELECT ingest_seq, {_KEY} AS vendor_key FROM v_devices")
def _(t):
    return K.vendor_keys(t.v_devices, K.dictionary_tables(t.spark)["keywords"]).select("ingest_seq", "vendor_key")


@query("join_firmware_intel", f"SELECT ingest_seq, CAST({_FIRMWARE_RISK} AS DOUBLE) AS firmware_risk FROM (SELECT *, {_KEY} AS vendor_key FROM v_devices) d",
       ["firmware_risk"])
def _(t):
    rules = K.dictionary_tables(t.spark)
    return K.firmware_risks(K.vendor_keys(t.v_devices, rules["keywords"]), rules["firmware"]).select("ingest_seq", "firmware_risk")


@query("cve_component", "SELECT ingest_seq, cve_part AS cve_component FROM d_parts", ["cve_component"])
def _(t):
    return K.vendor_risks(D.dedup_device(t.v_devices), K.dictionary_tables(t.spark)).select("ingest_seq", "cve_component")


@query("firmware_age", "SELECT ingest_seq, age_part AS firmware_age FROM d_parts", ["firmware_age"])
def _(t):
    return D.dedup_device(t.v_devices).select("ingest_seq", D.firmware_age(F.col("firmware_version")).alias("firmware_age"))


@query("matched_cves", "SELECT ingest_seq, matched_cves FROM d_parts")
def _(t):
    known = K.vendor_risks(D.dedup_device(t.v_devices), K.dictionary_tables(t.spark))
    return known.select("ingest_seq", F.array_join("matched_cves", ",").alias("matched_cves"))


@query("device_score", """
SELECT ingest_seq, ip, port, risk_score, risk_severity, round(cve_part * 30, 1) AS cve_points, round(age_part * 10, 1) AS firmware_points,
       round_even(geo_part * 5, 1) AS geo_points FROM d_scored
""", ["cve_points", "firmware_points", "geo_points"])
def _(t):
    return scored(t).select(
        "ingest_seq", "ip", "port", "risk_score", "risk_severity", F.col("risk_components.cve").alias("cve_points"),
        F.col("risk_components.firmware_age").alias("firmware_points"), F.col("risk_components.geo").alias("geo_points"),
    )


@query("severity_distribution", f"""
SELECT CAST(c.position AS INT) AS position, c.risk_severity, count(d.ip) AS devices
FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(C.SEVERITY_ORDER))}) c(position, risk_severity)
LEFT JOIN d_scored d ON c.risk_severity = d.risk_severity GROUP BY ALL
""")
def _(t):
    return D.severity_distribution(scored(t))


@query("top_devices", "SELECT ip, port, risk_score, ingest_seq FROM d_scored ORDER BY risk_score DESC, ingest_seq LIMIT 10")
def _(t):
    return D.top_devices(scored(t)).select("ip", "port", "risk_score", "ingest_seq")


_COUNTS = """
SELECT 'vendor' AS kind, name, devices FROM (SELECT coalesce(vendor, '') AS name, count(*) AS devices FROM d_first GROUP BY 1 ORDER BY devices DESC, name LIMIT 10) v
UNION ALL SELECT 'country', name, devices FROM (SELECT coalesce(country, '') AS name, count(*) AS devices FROM d_first GROUP BY 1 ORDER BY devices DESC, name LIMIT 10) c
UNION ALL SELECT 'flag', 'default_creds', count(*) FROM d_first WHERE default_creds_indicator
UNION ALL SELECT 'flag', 'no_tls', count(*) FROM d_first WHERE NOT has_tls
UNION ALL SELECT 'flag', 'modbus', count(*) FROM d_first WHERE has_modbus
UNION ALL SELECT 'flag', 'mqtt', count(*) FROM d_first WHERE has_mqtt
"""


@query("device_counters", _COUNTS)
def _(t):
    return D.device_counters(D.dedup_device(t.v_devices))


# --- fleet ---------------------------------------------------------------------------------
_REGION = sql_case(
    [(f"country = '{c}'", str(gw)) for c, gw, _ in C.EUROPE_GRID] + [(f"country = '{c}'", str(gw)) for c, gw, _ in C.STATE_GRID],
    str(C.UNKNOWN_REGION_GW),
)
_LABEL = "CASE WHEN pct > 2.0 THEN 'CRITICAL' WHEN pct > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END"
STEPS["d_pairs"] = """
SELECT coalesce(nullif(country, ''), 'XX') AS country, coalesce(nullif(vendor, ''), 'Unknown') AS vendor, count(*) AS devices
FROM d_scored GROUP BY 1, 2
"""
STEPS["fleet_c"] = f"""
SELECT c.*, v.vendors, solar_gw, total_devices * 10.0::DOUBLE / 1000 AS exposed_capacity_mw,
       total_devices * 10.0::DOUBLE / 1000 / 1000 AS exposed_capacity_gw, pct AS pct_of_grid, pct > 2.0 AS destabilization_risk, {_LABEL} AS risk_label
FROM (
SELECT *, total_devices * 10.0::DOUBLE / 1000 / 1000 / solar_gw * 100 AS pct FROM (
SELECT coalesce(nullif(country, ''), 'XX') AS country, count(*) AS total_devices,
       count(*) FILTER (WHERE risk_severity = 'CRITICAL') AS critical_devices,
       count(*) FILTER (WHERE default_creds_indicator) AS default_creds_devices,
       count(*) FILTER (WHERE NOT has_tls) AS no_tls_devices, avg(risk_score) AS avg_risk_score
FROM d_scored GROUP BY 1) g, LATERAL (SELECT CAST({_REGION} AS DOUBLE) AS solar_gw) r) c
JOIN (SELECT country AS vc, string_agg(vendor || ':' || CAST(devices AS STRING), ',' ORDER BY vendor) AS vendors FROM d_pairs GROUP BY country) v ON c.country = v.vc
"""
FLEET_C = [
    "country", "total_devices", "vendors", "solar_gw", "exposed_capacity_mw", "exposed_capacity_gw", "pct_of_grid",
    "destabilization_risk", "risk_label", "critical_devices", "default_creds_devices", "no_tls_devices", "avg_risk_score",
]
_FLEET_C_DOUBLES = ["solar_gw", "exposed_capacity_mw", "exposed_capacity_gw", "pct_of_grid", "avg_risk_score"]


def by_country(t):
    return D.fleet_by_country(scored(t), digits=False)


@query("fleet_by_country", f"SELECT {', '.join(FLEET_C)} FROM fleet_c", _FLEET_C_DOUBLES)
def fleet_by_country(t):
    entries = F.transform(F.map_entries("vendors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return by_country(t).withColumn("vendors", F.array_join(F.array_sort(entries), ",")).select(*FLEET_C)


STEPS["fleet_v"] = """
SELECT coalesce(nullif(vendor, ''), 'Unknown') AS vendor, count(*) AS total_devices,
       string_agg(DISTINCT coalesce(country, 'XX'), ',' ORDER BY coalesce(country, 'XX')) AS countries,
       count(*) * 10.0::DOUBLE / 1000 AS exposed_capacity_mw, count(*) FILTER (WHERE risk_severity = 'CRITICAL') AS critical_devices,
       count(*) FILTER (WHERE risk_severity = 'CRITICAL') / count(*) * 100 AS critical_pct, avg(risk_score) AS avg_risk_score
FROM d_scored GROUP BY 1
"""


@query("fleet_by_vendor", "SELECT * FROM fleet_v", ["exposed_capacity_mw", "critical_pct", "avg_risk_score"])
def _(t):
    return D.fleet_by_vendor(scored(t), digits=False).withColumn("countries", F.array_join("countries", ","))


@query("fleet_global", """
SELECT count(*) AS total_devices_found, count(*) * 10.0::DOUBLE / 1000 AS total_exposed_capacity_mw, 336.0::DOUBLE AS eu_solar_gw,
       count(*) * 10.0::DOUBLE / 1000 / 1000 / 336 * 100 AS eu_pct_of_grid, count(*) * 10.0::DOUBLE / 1000 / 1000 / 336 * 100 > 2 AS eu_destabilization_risk,
       coalesce((SELECT string_agg(country, ',' ORDER BY country) FROM fleet_c WHERE destabilization_risk), '') AS countries_at_risk,
       count(*) FILTER (WHERE risk_severity = 'CRITICAL') AS total_critical_devices,
       count(*) FILTER (WHERE default_creds_indicator) AS total_default_creds, count(*) FILTER (WHERE NOT has_tls) AS total_no_tls
FROM d_scored
""", ["total_exposed_capacity_mw", "eu_solar_gw", "eu_pct_of_grid"])
def _(t):
    return D.fleet_global(scored(t), digits=False).withColumn("countries_at_risk", F.array_join("countries_at_risk", ",")).drop(
        "eu_destabilization_threshold_gw", "avg_inverter_kw_assumed"
    )


@query("top_countries", "SELECT country, total_devices FROM fleet_c ORDER BY total_devices DESC, country LIMIT 15")
def _(t):
    return D.top_countries(by_country(t)).select("country", "total_devices")


@query("at_risk_countries", "SELECT country, pct_of_grid FROM fleet_c WHERE destabilization_risk", ["pct_of_grid"])
def _(t):
    return D.at_risk_countries(by_country(t)).select("country", "pct_of_grid")


@query("vendor_breakdown", "SELECT vendor, total_devices, critical_pct FROM fleet_v", ["critical_pct"])
def _(t):
    return D.vendor_breakdown(D.fleet_by_vendor(scored(t), digits=False)).select("vendor", "total_devices", "critical_pct")


@query("join_region_capacity", f"SELECT ingest_seq, country, CAST({_REGION} AS DOUBLE) AS solar_gw FROM v_devices", ["solar_gw"])
def _(t):
    return D.join_region_capacity(t.v_devices).select("ingest_seq", "country", "solar_gw")


STEPS["region_counts"] = f"""
SELECT *, devices * 10.0::DOUBLE / 1000 AS mw, devices * 10.0::DOUBLE / 1000 / 1000 / solar_gw * 100 AS pct FROM (
SELECT country, count(*) AS devices, CAST({_REGION} AS DOUBLE) AS solar_gw
FROM (SELECT coalesce(nullif(country, ''), 'XX') AS country FROM v_devices) d GROUP BY country) r
"""


@query("exposure_impact", f"""
SELECT country, devices, solar_gw, mw AS exposed_capacity_mw, mw / 1000 AS exposed_capacity_gw, pct AS pct_of_grid,
       pct > 2.0 AS destabilization_risk, {_LABEL} AS risk_label FROM region_counts
""", ["solar_gw", "exposed_capacity_mw", "exposed_capacity_gw", "pct_of_grid"])
def _(t):
    country = F.coalesce(F.nullif("country", F.lit("")), F.lit("XX")).alias("country")
    counts = t.v_devices.groupBy(country).agg(F.count(F.lit(1)).alias("devices"))
    return D.exposure_impact(D.join_region_capacity(counts), "devices", "solar_gw", digits=False)


@query("union_critical_regions", f"""
SELECT r.country, count(d.ip) AS devices FROM (VALUES {', '.join(f"('{c}')" for c in critical_regions())}) r(country)
LEFT JOIN v_devices d ON r.country = d.country GROUP BY r.country
""")
def _(t):
    return D.critical_region_devices(t.v_devices)


STEPS["state_caps"] = f"""
SELECT state, greatest(coalesce(k.gw, 0), coalesce(r.gw, 0)) AS solar_gw FROM (
SELECT coalesce(k.state, r.state) AS state FROM (VALUES {', '.join(f"('{s}')" for s, _, _ in C.STATE_GRID)}) k(state)
FULL OUTER JOIN (SELECT DISTINCT location AS state FROM v_capacity WHERE length(location) = 2 AND capacity IS NOT NULL) r ON k.state = r.state) s
LEFT JOIN (VALUES {', '.join(f"('{s}', {gw}::DOUBLE)" for s, gw, _ in C.STATE_GRID)}) k(ks, gw) ON state = ks
LEFT JOIN (SELECT location AS rs, max(CAST(capacity AS DOUBLE) / 1000) AS gw FROM v_capacity WHERE length(location) = 2 GROUP BY location) r ON state = rs
"""


@query("capacity_by_state", "SELECT state, solar_gw FROM state_caps WHERE solar_gw > 0", ["solar_gw"])
def _(t):
    return D.capacity_by_state(t.v_capacity, None)


@query("impact_by_state", f"""
SELECT state, solar_gw, 1000 AS exposed_devices, 10.0::DOUBLE AS exposed_capacity_mw, 0.01::DOUBLE AS exposed_capacity_gw,
       pct AS pct_of_grid, pct > 2.0 AS destabilization_risk, {_LABEL} AS risk_label
FROM (SELECT *, 0.01::DOUBLE / solar_gw * 100 AS pct FROM state_caps WHERE solar_gw > 0) s
""", ["solar_gw", "exposed_capacity_mw", "exposed_capacity_gw", "pct_of_grid"])
def _(t):
    return D.impact_by_state(D.capacity_by_state(t.v_capacity, None), digits=False)
