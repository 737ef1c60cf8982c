"""Passive device observations → flat devices → device risk scores → fleet rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions import matching as M
from gridrisk.functions.geo import critical_regions, is_critical_region, region_capacity
from gridrisk.functions.numeric import as_count, half_even
from gridrisk.functions.text import contains_any, date_prefix
from gridrisk.operators.containment import vendor_risks
from gridrisk.operators.parcels import first_per_key


def flatten_device(observations: DataFrame, fallback: bool = False) -> DataFrame:
    """Nested observation → flat device record of 28 fields plus ``ingest_seq``.

    ``fallback`` uses the searched vendor when none is identified.
    """
    o = F.col

    def blank(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    ports = F.coalesce(o("ports"), F.array(o("port")))
    return observations.select(
        o("seq").alias("ingest_seq"),
        o("ip_str").alias("ip"),
        "port",
        F.coalesce("transport", F.lit("tcp")).alias("transport"),
        M.identify_vendor(
            o("data"), o("product"), o("http.title"), o("http.html"),
            fallback=o("query_vendor") if fallback else None,
        ).alias("vendor"),
        "query_vendor",
        blank(o("product")).alias("product"),
        blank(o("os")).alias("os"),
        blank(o("location.country_code")).alias("country"),
        blank(o("location.country_name")).alias("country_name"),
        blank(o("location.region_code")).alias("region"),
        blank(o("location.city")).alias("city"),
        o("location.latitude").alias("lat"),
        o("location.longitude").alias("lon"),
        blank(o("org")).alias("org"),
        blank(o("isp")).alias("isp"),
        blank(o("asn")).alias("asn"),
        F.coalesce("hostnames", F.array().cast("array<string>")).alias("hostnames"),
        blank(o("http.title")).alias("http_title"),
        o("http.status").alias("http_status"),
        o("ssl").isNotNull().alias("has_tls"),
        blank(o("ssl.cert.subject.CN")).alias("tls_cert_subject"),
        ports.alias("open_ports"),
        F.coalesce(F.array_contains(ports, C.MODBUS_PORT), F.lit(False)).alias("has_modbus"),
        F.coalesce(F.array_contains(ports, C.MQTT_PORT), F.lit(False)).alias("has_mqtt"),
        M.default_credentials(o("data")).alias("default_creds_indicator"),
        M.firmware_version(o("data"), o("http.headers"), o("http.html")).alias("firmware_version"),
        blank(date_prefix(o("timestamp"))).alias("last_seen"),
        blank(o("observation_id")).alias("observation_id"),
    )


def dedup_device(devices: DataFrame) -> DataFrame:
    """First record of each (ip, port) in arrival order."""
    return first_per_key(devices, ["ip", "port"], F.col("ingest_seq").asc())


def union_query_results(*results: DataFrame) -> DataFrame:
    """Concatenate rule runs; the run number comes before the arrival order inside a run."""
    out = None
    for run, rows in enumerate(results):
        rows = rows.withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out


def rule_match_banners(df: DataFrame, text: Column, title: Column, ports: Column) -> DataFrame:
    """One row per observation and matching built-in vendor rule; ``containment.matched_rules`` takes rules from a table."""
    return df.withColumn("_hit", F.explode(M.matched_banner_rules(text, title, ports))).select(
        *df.columns, F.col("_hit.vendor").alias("rule_vendor"), F.col("_hit.rule").alias("rule")
    )


def cve_component(vendor: Column, firmware: Column, whole_word: bool = False) -> Column:
    """Known-firmware risk first, then the vendor's worst CVE; unknown vendors get 0.3."""
    key = M.vendor_key(vendor, whole_word=whole_word)
    return F.coalesce(M.firmware_risk(key, firmware), M.worst_cve_risk(key), F.lit(0.3))


def firmware_age(firmware: Column) -> Column:
    major = F.regexp_extract(firmware, r"(\d+)\.(\d+)", 1).try_cast("bigint")
    return (
        F.when(F.coalesce(firmware, F.lit("")) == "", F.lit(0.5))
        .when(contains_any(firmware, C.OLD_FIRMWARE_HINTS), F.lit(0.9))
        .when(major.isNull(), F.lit(0.5))
        .when(major <= 1, F.lit(0.8))
        .when(major <= 2, F.lit(0.5))
        .otherwise(F.lit(0.2))
    )


def matched_cves(vendor: Column) -> Column:
    return M.vendor_cves(M.vendor_key(vendor))


def severity(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("CRITICAL"))
        .when(score >= 60, F.lit("HIGH"))
        .when(score >= 40, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def score_devices(devices: DataFrame, dictionary: dict[str, DataFrame] | None = None) -> DataFrame:
    """Risk score 0–100, severity, component points and matched CVEs.

    ``dictionary`` has the tables of a landed vendor dictionary; without one the built-in rules
    score, as expressions. The weighted parts are added in a fixed order, because half-even rounding
    sees the last bit.
    """
    if dictionary is not None:
        known = vendor_risks(devices, dictionary).drop("vendor_key", "firmware_risk")
        return _scored(known, F.col("cve_component"), F.col("matched_cves")).drop("cve_component")
    return _scored(devices, cve_component(F.col("vendor"), F.col("firmware_version")), matched_cves(F.col("vendor")))


def _scored(devices: DataFrame, cve_part: Column, cves: Column) -> DataFrame:
    industrial = F.coalesce(F.col("has_modbus"), F.lit(False)) | F.coalesce(F.col("has_mqtt"), F.lit(False))
    parts = {
        "cve": cve_part,
        "default_creds": F.when(F.col("default_creds_indicator"), F.lit(1.0)).otherwise(F.lit(0.0)),
        "no_tls": F.when(F.col("has_tls"), F.lit(0.0)).otherwise(F.lit(1.0)),
        "industrial_protocol": F.when(industrial, F.lit(1.0)).otherwise(F.lit(0.0)),
        "firmware_age": firmware_age(F.col("firmware_version")),
        "geo": F.when(is_critical_region(F.col("country")), F.lit(1.0)).otherwise(F.lit(0.3)),
    }
    weights = {
        "cve": 0.30, "default_creds": 0.25, "no_tls": 0.15,
        "industrial_protocol": 0.15, "firmware_age": 0.10, "geo": 0.05,
    }
    points = {"cve": 30, "default_creds": 25, "no_tls": 15, "industrial_protocol": 15, "firmware_age": 10, "geo": 5}
    staged = devices.withColumn("_p", F.struct(*[value.alias(name) for name, value in parts.items()]))
    raw = F.lit(0.0)
    for name, weight in weights.items():
        raw = raw + F.lit(weight) * F.col(f"_p.{name}")
    scored = staged.withColumn("risk_score", F.least(F.rint(raw * 100), F.lit(100.0)).cast("bigint"))
    components = F.struct(*[half_even(F.col(f"_p.{n}") * p, 1).alias(n) for n, p in points.items()])
    return scored.withColumns(
        {
            "risk_severity": severity(F.col("risk_score")),
            "risk_components": components,
            "matched_cves": cves,
        }
    ).drop("_p")


def exposure(devices: Column, capacity_gw: Column, digits: bool = True) -> dict[str, Column]:
    """Impact columns of a number of exposed devices against a capacity."""
    mw = devices * F.lit(C.AVG_INVERTER_KW) / 1000
    gw = mw / 1000
    pct = F.when(capacity_gw > 0, gw / capacity_gw * 100).otherwise(F.lit(0.0))
    return {
        "exposed_capacity_mw": half_even(mw, 2 if digits else None),
        "exposed_capacity_gw": half_even(gw, 3 if digits else None),
        "pct_of_grid": half_even(pct, 3 if digits else None),
        "destabilization_risk": pct > C.DESTABILIZATION_PCT,
        "risk_label": F.when(pct > C.DESTABILIZATION_PCT, F.lit("CRITICAL"))
        .when(pct > C.HIGH_EXPOSURE_PCT, F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM")),
    }


def exposure_impact(df: DataFrame, devices: str, capacity_gw: str, digits: bool = True) -> DataFrame:
    return df.withColumns(exposure(F.col(devices), F.col(capacity_gw), digits))


def join_region_capacity(df: DataFrame, code: str = "country") -> DataFrame:
    return df.withColumn("solar_gw", region_capacity(F.col(code)))


def _named(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def fleet_by_country(scored: DataFrame, digits: bool = True) -> DataFrame:
    """Country rollup with a vendor → devices map.

    Devices are counted per (country, vendor) first; the map then has one entry per vendor name.
    """
    pairs = (
        scored.groupBy(_named("country", "XX").alias("country"), _named("vendor", "Unknown").alias("vendor"))
        .agg(
            F.count(F.lit(1)).alias("devices"),
            as_count(F.col("risk_severity") == "CRITICAL").alias("critical"),
            as_count(F.col("default_creds_indicator")).alias("creds"),
            as_count(~F.coalesce(F.col("has_tls"), F.lit(False))).alias("no_tls"),
            F.sum("risk_score").alias("score_sum"),
        )
    )
    rolled = pairs.groupBy("country").agg(
        F.sum("devices").alias("total_devices"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("vendor", "devices")))).alias("vendors"),
        F.sum("critical").alias("critical_devices"),
        F.sum("creds").alias("default_creds_devices"),
        F.sum("no_tls").alias("no_tls_devices"),
        (F.sum("score_sum") / F.sum("devices")).alias("mean_score"),
    )
    full = exposure_impact(join_region_capacity(rolled), "total_devices", "solar_gw", digits)
    return full.withColumn("avg_risk_score", half_even(F.col("mean_score"), 1 if digits else None)).drop("mean_score")


def fleet_by_vendor(scored: DataFrame, digits: bool = True) -> DataFrame:
    """Vendor rollup; the country list is over country codes, counted before it is collected."""
    pairs = (
        scored.groupBy(_named("vendor", "Unknown").alias("vendor"), F.coalesce("country", F.lit("XX")).alias("country"))
        .agg(
            F.count(F.lit(1)).alias("devices"),
            as_count(F.col("risk_severity") == "CRITICAL").alias("critical"),
            F.sum("risk_score").alias("score_sum"),
        )
    )
    rolled = pairs.groupBy("vendor").agg(
        F.sum("devices").alias("total_devices"),
        F.array_sort(F.collect_list("country")).alias("countries"),
        F.sum("critical").alias("critical_devices"),
        F.sum("score_sum").alias("score_sum"),
    )
    places = 1 if digits else None
    return rolled.select(
        "vendor",
        "total_devices",
        "countries",
        half_even(F.col("total_devices") * C.AVG_INVERTER_KW / 1000, 2 if digits else None).alias("exposed_capacity_mw"),
        "critical_devices",
        half_even(F.col("critical_devices") / F.col("total_devices") * 100, places).alias("critical_pct"),
        half_even(F.col("score_sum") / F.col("total_devices"), places).alias("avg_risk_score"),
    )


def fleet_global(scored: DataFrame, europe_only: bool = False, digits: bool = True) -> DataFrame:
    """One row over the whole fleet.

    All devices count against Europe's capacity unless ``europe_only`` is set. The list of
    countries at risk comes from the country rollup.
    """
    by_country = fleet_by_country(scored)
    at_risk = by_country.filter("destabilization_risk").agg(
        F.array_sort(F.collect_list("country")).alias("c")
    )
    counted = F.lit(1)
    if europe_only:
        counted = F.when(F.col("country").isin([c for c, _, _ in C.EUROPE_GRID]), F.lit(1))
    totals = scored.agg(
        F.count(F.lit(1)).alias("total_devices_found"),
        F.count(counted).alias("europe_devices"),
        as_count(F.col("risk_severity") == "CRITICAL").alias("total_critical_devices"),
        as_count(F.col("default_creds_indicator")).alias("total_default_creds"),
        as_count(~F.coalesce(F.col("has_tls"), F.lit(False))).alias("total_no_tls"),
    )
    mw = F.col("total_devices_found") * C.AVG_INVERTER_KW / 1000
    pct = F.col("europe_devices") * C.AVG_INVERTER_KW / 1000 / 1000 / C.EUROPE_TOTAL_GW * 100
    return totals.select(
        "total_devices_found",
        half_even(mw, 2 if digits else None).alias("total_exposed_capacity_mw"),
        F.lit(C.EUROPE_TOTAL_GW).alias("eu_solar_gw"),
        F.lit(C.EUROPE_TOTAL_GW * C.DESTABILIZATION_PCT / 100).alias("eu_destabilization_threshold_gw"),
        half_even(pct, 3 if digits else None).alias("eu_pct_of_grid"),
        (pct > C.DESTABILIZATION_PCT).alias("eu_destabilization_risk"),
        at_risk.scalar().alias("countries_at_risk"),
        "total_critical_devices",
        "total_default_creds",
        "total_no_tls",
        F.lit(C.AVG_INVERTER_KW).alias("avg_inverter_kw_assumed"),
    )


def capacity_by_state(records: DataFrame, digits: int | None = 2) -> DataFrame:
    """Greater of the known capacity and the largest reported one, per two-letter code."""
    reported = (
        records.filter(F.length("location") == 2)
        .select("location", (F.col("capacity").try_cast("double") / 1000).alias("gw"))
        .filter(F.coalesce(F.col("gw"), F.lit(0.0)) != 0)
        .groupBy("location")
        .agg(half_even(F.max("gw"), digits).alias("reported_gw"))
    )
    known = records.sparkSession.createDataFrame(
        [(c, gw) for c, gw, _ in C.STATE_GRID], "location string, known_gw double"
    )
    return (
        known.join(reported, "location", "full_outer")
        .select(
            F.col("location").alias("state"),
            F.greatest("known_gw", "reported_gw").alias("solar_gw"),
        )
        .filter("solar_gw > 0")
    )


def impact_by_state(capacity: DataFrame, devices: int = 1000, digits: bool = True) -> DataFrame:
    counted = capacity.withColumn("exposed_devices", F.lit(devices))
    return exposure_impact(counted, "exposed_devices", "solar_gw", digits).orderBy(F.desc("solar_gw"), "state")


def device_counters(devices: DataFrame) -> DataFrame:
    """The four flag counts and the ten most frequent vendors and countries: ``kind, name, devices``."""

    def top(column: str) -> DataFrame:
        return (
            devices.groupBy(F.coalesce(column, F.lit("")).alias("name"))
            .agg(F.count(F.lit(1)).alias("devices"))
            .orderBy(F.desc("devices"), "name")
            .limit(10)
            .select(F.lit(column).alias("kind"), "name", "devices")
        )

    flags = devices.agg(
        as_count(F.col("default_creds_indicator")).alias("default_creds"),
        as_count(~F.col("has_tls")).alias("no_tls"),
        as_count(F.col("has_modbus")).alias("modbus"),
        as_count(F.col("has_mqtt")).alias("mqtt"),
    ).unpivot([], ["default_creds", "no_tls", "modbus", "mqtt"], "name", "devices")
    return top("vendor").unionByName(top("country")).unionByName(
        flags.select(F.lit("flag").alias("kind"), "name", "devices")
    )


def severity_distribution(scored: DataFrame) -> DataFrame:
    """Count per severity class in fixed order; empty classes stay with zero."""
    counts = scored.groupBy("risk_severity").agg(F.count(F.lit(1)).alias("devices"))
    classes = scored.sparkSession.createDataFrame(
        list(enumerate(C.SEVERITY_ORDER)), "position int, risk_severity string"
    )
    return classes.join(counts, "risk_severity", "left").fillna(0, ["devices"]).orderBy("position")


def top_devices(scored: DataFrame, n: int = 10) -> DataFrame:
    """Highest scores; ties in arrival order."""
    return scored.orderBy(F.desc("risk_score"), F.asc("ingest_seq")).limit(n)


def top_countries(by_country: DataFrame, n: int = 15) -> DataFrame:
    return by_country.orderBy(F.desc("total_devices"), "country").limit(n)


def at_risk_countries(by_country: DataFrame) -> DataFrame:
    return by_country.filter("destabilization_risk").orderBy(F.desc("pct_of_grid"), "country")


def vendor_breakdown(by_vendor: DataFrame) -> DataFrame:
    return by_vendor.orderBy(F.desc("total_devices"), "vendor")


def critical_region_devices(devices: DataFrame) -> DataFrame:
    """Devices per grid-critical region: the union of critical countries and critical states."""
    regions = devices.sparkSession.createDataFrame([(c,) for c in critical_regions()], "country string")
    counts = devices.groupBy("country").agg(F.count(F.lit(1)).alias("devices"))
    return regions.join(counts, "country", "left").fillna(0, ["devices"])
