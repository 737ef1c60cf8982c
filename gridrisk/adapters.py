"""Domain tables derived from the star-schema sample tables.

The texts are portable SQL: the same text runs on Spark and on a checking engine, so both start
from identical values. ``{name}`` stands for a sample table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}


def _five_digits(number: str) -> str:
    """The number as text of at least five digits; longer numbers stay whole, so ids stay apart."""
    return f"(CASE WHEN {number} < 100000 THEN lpad(CAST({number} AS STRING), 5, '0') ELSE CAST({number} AS STRING) END)"


#: One id per order: five digits like a postal code, then one or more where there are more than 100,000 orders.
_COMMUNITY_ID = (
    "(lpad(CAST((o_orderkey * 37) % 100000 AS STRING), 5, '0') || CASE WHEN o_orderkey < 100000 THEN '' "
    "ELSE CAST(CAST(floor(o_orderkey / 100000) AS BIGINT) AS STRING) END)"
)

VIEWS["v_parcels"] = """
SELECT c_custkey AS record_id,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_name END AS property_address,
       n_name AS city, substring(n_name, 1, 2) AS state,
       CAST(90000 + c_custkey % 60 AS STRING) AS zip_code,
       lpad(CAST(c_custkey % 97 AS STRING), 4, '0') AS zip4,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lpad(CAST(6000 + c_nationkey AS STRING), 5, '0') END AS fips_code,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 30 AS STRING) END AS census_key,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1000 + c_custkey % 30 AS STRING) END AS census_key_decennial,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(30 + c_custkey % 15 AS DOUBLE) END AS latitude,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(-120 + c_custkey % 40 AS DOUBLE) END AS longitude,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Single Family RESIDENTIAL'
            WHEN c_mktsegment = 'BUILDING' THEN 'Residential Condo' ELSE 'Commercial' END AS land_use,
       c_acctbal * 100 AS total_assessed_value,
       CAST(2020 + c_custkey % 5 AS INT) AS assessment_year,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal * 90 END AS sales_price,
       CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE CAST(c_custkey % 9000 AS DOUBLE) END AS lot_size,
       'SF' AS lot_size_unit,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(1940 + c_custkey % 80 AS INT) END AS year_built,
       CAST(c_custkey % 11 AS INT) AS rooms, CAST(c_custkey % 6 AS INT) AS bedrooms,
       CAST(c_custkey % 5 AS DOUBLE) / 2 AS baths, CAST(c_custkey % 2 AS DOUBLE) AS partial_baths,
       CAST(1 + c_custkey % 3 AS INT) AS stories,
       CAST(1 + c_custkey % 2 AS INT) AS number_of_buildings, CAST(c_custkey % 4 AS INT) AS number_of_units,
       CAST(c_custkey % 3 AS INT) AS garage_cars,
       CASE WHEN c_custkey % 8 = 0 THEN 'Y' ELSE 'N' END AS has_security_alarm
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

VIEWS["v_avm"] = """
SELECT o_orderkey AS record_id_avm, c_name AS address, n_name AS city,
       substring(n_name, 1, 2) AS state, CAST(90000 + c_custkey % 60 AS STRING) AS zip_code,
       o_totalprice * 10 AS final_value, o_totalprice * 11 AS high_value, o_totalprice * 9 AS low_value,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS valuation_date
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

# Every customer appears twice; a third of them carry no ZIP+4 and so match no parcel.
VIEWS["v_geo"] = """
SELECT c_custkey + 100000000 * k AS record_id_geo, substring(n_name, 1, 2) AS state,
       CAST(90000 + c_custkey % 60 AS STRING) AS zip_code,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 97 AS STRING), 4, '0') END AS zip4,
       lpad(CAST(6000 + c_nationkey AS STRING), 5, '0') AS geo_fips_code,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 30 AS STRING) END AS geo_census_key,
       CAST(1000 + c_custkey % 30 AS STRING) AS geo_census_key_decennial,
       CAST(30 + k AS DOUBLE) AS geo_latitude, CAST(-100 - k AS DOUBLE) AS geo_longitude
FROM (SELECT c_custkey, c_nationkey, CAST(1 AS BIGINT) AS k FROM {customer}
      UNION ALL SELECT c_custkey, c_nationkey, CAST(2 AS BIGINT) AS k FROM {customer}) c
JOIN {nation} ON c_nationkey = n_nationkey
"""

VIEWS["v_cves"] = """
SELECT 'CVE-2024-' || """ + _five_digits("p_partkey") + """ AS cve_id, 'NVD' AS source,
       '20' || CAST(15 + p_partkey % 10 AS STRING) || '-06-01' AS published_date,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(30 + p_partkey % 71 AS DOUBLE) / 10 END AS cvss_score,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 71 >= 60 THEN 'CRITICAL'
            WHEN p_partkey % 71 >= 40 THEN 'HIGH' ELSE 'MEDIUM' END AS cvss_severity,
       CAST(CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS INT) AS cisa_kev,
       CASE WHEN p_partkey % 4 = 0 THEN 'Flaw in SMA ' || p_name
            WHEN p_partkey % 4 = 1 THEN 'smart ' || p_name ELSE p_name END AS description
FROM {part}
"""

VIEWS["v_products"] = """
SELECT 'CVE-2024-' || """ + _five_digits("l_partkey") + """ AS cve_id,
       CASE l_suppkey % 8 WHEN 0 THEN 'growatt' WHEN 1 THEN 'sungrowpower' WHEN 2 THEN 'sma'
            WHEN 3 THEN 'linux' WHEN 4 THEN 'fusionsolar' WHEN 5 THEN NULL WHEN 6 THEN 'acme_corp'
            ELSE 'enphase' END AS vendor,
       'product ' || CAST(l_linenumber AS STRING) AS product,
       'cpe:2.3:o:v:' || CAST(l_linenumber AS STRING) || ':' || CAST(l_suppkey % 5 AS STRING) AS cpe_uri,
       CASE WHEN l_linenumber % 2 = 0 THEN '1.' || CAST(l_suppkey % 3 AS STRING) END AS version_start_including,
       CAST(NULL AS STRING) AS version_start_excluding,
       CASE WHEN l_suppkey % 2 = 0 THEN '9.' || CAST(l_linenumber AS STRING) END AS version_end_including,
       CAST(NULL AS STRING) AS version_end_excluding,
       CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS INT) AS is_vulnerable
FROM {lineitem}
"""

VIEWS["v_devices"] = """
SELECT '10.0.' || CAST(o_custkey % 250 AS STRING) || '.' || CAST(o_orderkey % 90 AS STRING) AS ip,
       CAST(CASE o_orderkey % 3 WHEN 0 THEN 80 WHEN 1 THEN 502 ELSE 1883 END AS INT) AS port,
       CASE o_orderkey % 6 WHEN 0 THEN 'Growatt' WHEN 1 THEN 'Sungrow' WHEN 2 THEN 'SMA'
            WHEN 3 THEN 'SolarView' WHEN 4 THEN 'Unknown' ELSE NULL END AS vendor,
       CASE o_custkey % 7 WHEN 0 THEN 'DE' WHEN 1 THEN 'IT' WHEN 2 THEN 'JP' WHEN 3 THEN 'CA'
            WHEN 4 THEN 'US' WHEN 5 THEN '' ELSE NULL END AS country,
       o_orderstatus = 'F' AS has_tls, o_orderkey % 3 = 1 AS has_modbus, o_orderkey % 3 = 2 AS has_mqtt,
       o_orderkey % 10 = 0 AS default_creds_indicator,
       CASE o_custkey % 6 WHEN 0 THEN '3.2.1' WHEN 1 THEN 'v6.0' WHEN 2 THEN '4.5.0'
            WHEN 3 THEN 'WiNet-S v1.3.2' WHEN 4 THEN '0.9' ELSE NULL END AS firmware_version,
       o_orderkey AS ingest_seq,
       CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE 25 + CAST(o_custkey % 200 AS DOUBLE) / 10 END AS lat,
       CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE -120 + CAST(o_custkey % 300 AS DOUBLE) / 10 END AS lon
FROM {orders}
"""

VIEWS["v_acs"] = """
SELECT """ + _COMMUNITY_ID + """ AS geo_id,
       'ZCTA5 ' || """ + _COMMUNITY_ID + """ AS name,
       CAST(o_orderkey % 500 AS DOUBLE) AS total_housing_units,
       CAST(o_orderkey % 450 AS DOUBLE) AS occupied_units,
       CAST(o_orderkey % 300 AS DOUBLE) AS owner_occupied_units,
       CAST(o_orderkey % 150 AS DOUBLE) AS renter_occupied_units,
       CAST(o_orderkey % 350 AS DOUBLE) AS single_family_detached_units,
       CAST(o_orderkey % 90 AS DOUBLE) AS single_family_attached_units,
       CASE WHEN o_orderkey % 13 = 0 THEN CAST(-666666666 AS DOUBLE) ELSE o_totalprice * 8 END AS median_home_value,
       CASE WHEN o_orderkey % 14 = 0 THEN CAST(-666666666 AS DOUBLE) ELSE o_totalprice END AS median_household_income,
       CASE WHEN o_orderkey % 50 = 0 THEN CAST(-666666666 AS DOUBLE)
            ELSE CAST(1940 + o_orderkey % 80 AS DOUBLE) END AS median_year_built,
       CAST(o_orderkey % 1500 AS DOUBLE) AS total_population
FROM {orders}
"""

# One centroid per community id, with gaps so that the inner join drops some.
VIEWS["v_centroids"] = """
SELECT geo_id, lat, lon FROM (
  SELECT geo_id, 25 + CAST(CAST(geo_id AS BIGINT) % 200 AS DOUBLE) / 10 AS lat,
         CASE WHEN CAST(geo_id AS BIGINT) % 19 = 0 THEN NULL
              ELSE -120 + CAST(CAST(geo_id AS BIGINT) % 300 AS DOUBLE) / 10 END AS lon
  FROM (SELECT DISTINCT """ + _COMMUNITY_ID + """ AS geo_id FROM {orders}) d
) g WHERE lon IS NOT NULL
"""

# Each part is found by two keyword searches; the second page shows a changed record.
VIEWS["v_cve_hits"] = """
SELECT p_partkey * 2 + h AS seq, CASE h WHEN 0 THEN 'solar inverter' ELSE 'photovoltaic' END AS keyword,
       p_partkey, h, p_name,
       'CVE-2024-' || """ + _five_digits("p_partkey") + """ AS cve_id,
       CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '20' || CAST(15 + p_partkey % 10 AS STRING) || '-06-01T10:00:00.000' END AS published,
       '2024-0' || CAST(1 + h AS STRING) || '-02T03:04:05.000' AS last_modified,
       CASE h WHEN 0 THEN 'Analyzed' ELSE 'Modified' END AS vuln_status,
       CASE WHEN p_partkey % 5 = 0 THEN 'es' ELSE 'en' END AS lang,
       '  ' || CASE p_partkey % 7 WHEN 0 THEN 'Flaw in SMA and Enphase ' WHEN 1 THEN 'Growatt cloud '
                    WHEN 2 THEN 'sungrow dongle ' ELSE '' END || p_name || ' ' AS text_value,
       CAST(30 + p_partkey % 71 AS DOUBLE) / 10 AS score,
       CASE p_partkey % 4 WHEN 0 THEN '3.1' WHEN 1 THEN '3.0' WHEN 2 THEN '2.0' ELSE NULL END AS version,
       CASE WHEN p_partkey % 71 >= 60 THEN 'CRITICAL' WHEN p_partkey % 71 >= 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       p_size
FROM (SELECT p_partkey, p_name, p_size, CAST(0 AS BIGINT) AS h FROM {part}
      UNION ALL SELECT p_partkey, p_name, p_size, CAST(1 AS BIGINT) AS h FROM {part}) p
"""

# Catalogue rows for known parts, and for suppliers that no search has found.
VIEWS["v_kev"] = """
SELECT CASE WHEN k = 0 THEN ' CVE-2024-' || """ + _five_digits("id") + """ || ' '
            ELSE 'CVE-2023-' || """ + _five_digits("id") + """ END AS cveID,
       CASE id % 4 WHEN 0 THEN 'Growatt' WHEN 1 THEN 'Acme' WHEN 2 THEN NULL ELSE 'Initech' END AS vendorProject,
       'product ' || CAST(id % 9 AS STRING) AS product,
       CASE WHEN id % 3 = 0 THEN 'Weak SOLAR gateway ' ELSE 'Weak gateway ' END || CAST(rev AS STRING) AS shortDescription,
       'patch' AS requiredAction, '2024-03-0' || CAST(1 + rev AS STRING) AS dateAdded,
       '2024-04-01' AS dueDate, CASE WHEN rev = 0 THEN 'Unknown' ELSE 'Known' END AS knownRansomwareCampaignUse,
       rev * 100000000 + k * 10000000 + id AS seq
FROM (SELECT s_suppkey AS id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS rev FROM {supplier}
      UNION ALL SELECT s_suppkey AS id, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS rev FROM {supplier}
      UNION ALL SELECT s_suppkey AS id, CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS rev FROM {supplier}) s
"""

# Web observations: the page is the banner source, the search run is the arrival order.
VIEWS["v_observed"] = """
SELECT page_id AS seq,
       CASE page_id % 3 WHEN 0 THEN 'Growatt' WHEN 1 THEN 'SMA' ELSE 'Generic_Solar' END AS query_vendor,
       '192.0.2.' || CAST(page_id % 200 AS STRING) AS ip_str,
       CAST(CASE page_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 502 ELSE 8899 END AS INT) AS port,
       'Server build ' || url || CASE page_id % 5 WHEN 0 THEN ' Firmware: v3.2.' || CAST(page_id % 7 AS STRING)
            WHEN 1 THEN ' default password ' WHEN 2 THEN ' WiNet solar ' ELSE '' END AS data,
       CASE page_id % 6 WHEN 0 THEN 'SolarView Compact' WHEN 1 THEN 'Inverter' ELSE NULL END AS product,
       CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 'Sunny Webbox' ELSE 'PV Monitor' END AS title,
       CASE WHEN page_id % 3 = 0 THEN 'X-Version: 2.' || CAST(page_id % 10 AS STRING) ELSE NULL END AS headers,
       html,
       CASE WHEN page_id % 4 = 1 THEN 'cn.example' ELSE NULL END AS cert_cn,
       CASE page_id % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'IT' WHEN 2 THEN NULL ELSE 'US' END AS country_code,
       CASE WHEN page_id % 2 = 0 THEN '2024-05-06T07:08:09' ELSE NULL END AS seen_at
FROM {pages}
"""

VIEWS["v_capacity"] = """
SELECT CASE o_custkey % 12 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'FL' WHEN 3 THEN 'OH' WHEN 4 THEN 'US-TOTAL'
            WHEN 5 THEN '' WHEN 6 THEN 'NV' WHEN 7 THEN 'WA' WHEN 8 THEN 'NY' WHEN 9 THEN NULL WHEN 10 THEN 'GA' ELSE 'VA' END AS location,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 8) AS BIGINT) AS STRING) END AS capacity
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view_text(name: str) -> str:
    """The same view over tables that are already registered by name."""
    text = VIEWS[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def cve_pages(hits: DataFrame) -> DataFrame:
    """Search hits → landed page documents with the nested record of each CVE."""
    version, p = F.col("version"), F.col("p_partkey")

    def metric(wanted: str, own_severity: Column) -> Column:
        data = F.struct(
            version.alias("version"), F.concat(F.lit("V:"), version).alias("vectorString"),
            F.col("score").alias("baseScore"), F.col("severity").alias("baseSeverity"),
        )
        one = F.struct(F.lit("nvd@example").alias("source"), own_severity.alias("baseSeverity"), data.alias("cvssData"))
        return F.when(version == wanted, F.array(one))

    none = F.lit(None).cast("string")

    def match(kind: str, vulnerable: Column) -> Column:
        return F.struct(
            F.concat(F.lit("cpe:2.3:o:"), F.lit(kind), F.lit(":p"), (p % 9).cast("string"), F.lit(":*:x")).alias("criteria"),
            vulnerable.alias("vulnerable"),
            F.when(p % 2 == 0, F.lit("1.0")).alias("versionStartIncluding"),
            none.alias("versionStartExcluding"),
            none.alias("versionEndIncluding"),
            F.concat(F.lit("9."), F.col("p_size").cast("string")).alias("versionEndExcluding"),
        )

    unset = F.lit(None).cast("boolean")
    inner = F.struct(F.array(match("sma", p % 3 != 0)).alias("cpeMatch"))
    outer = F.struct(
        F.array(match("growatt", unset), F.struct(
            F.lit("cpe:short").alias("criteria"), F.lit(True).alias("vulnerable"),
            none.alias("versionStartIncluding"), none.alias("versionStartExcluding"),
            none.alias("versionEndIncluding"), none.alias("versionEndExcluding"),
        )).alias("cpeMatch"),
        F.array(inner).alias("nodes"),
    )
    reference = F.struct(
        F.concat(F.lit("https://ref.example/"), F.col("seq").cast("string")).alias("url"),
        F.lit("src").alias("source"),
        F.array(F.lit("Patch"), F.lit("Vendor Advisory")).alias("tags"),
    )
    blank = F.struct(F.lit("").alias("url"), F.lit("src").alias("source"), F.array(F.lit("x")).alias("tags"))
    cve = F.struct(
        F.col("cve_id").alias("id"),
        "published",
        F.col("last_modified").alias("lastModified"),
        F.col("vuln_status").alias("vulnStatus"),
        F.array(
            F.struct(F.lit("fr").alias("lang"), F.lit("texte").alias("value")),
            F.struct(F.col("lang").alias("lang"), F.col("text_value").alias("value")),
        ).alias("descriptions"),
        F.struct(
            metric("3.1", none).alias("cvssMetricV31"),
            metric("3.0", F.lit("")).alias("cvssMetricV30"),
            metric("2.0", F.lit("LEGACY")).alias("cvssMetricV2"),
        ).alias("metrics"),
        F.array(reference, blank).alias("references"),
        F.when(p % 2 == 0, F.array(F.struct(F.lit("w").alias("source")))).alias("weaknesses"),
        F.array(F.struct(F.array(outer).alias("nodes"))).alias("configurations"),
    )
    return hits.select("seq", "keyword", F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities"))


def observations(observed: DataFrame) -> DataFrame:
    """Flat observed rows → nested banner records."""
    subject = F.struct(F.struct(F.col("cert_cn").alias("CN")).alias("subject"))
    return observed.select(
        "seq", "query_vendor", "ip_str", "port", "data", "product",
        F.when(F.col("seq") % 2 == 0, F.array("port", F.lit(1883))).alias("ports"),
        F.col("seen_at").alias("timestamp"),
        F.concat(F.lit("obs-"), F.col("seq").cast("string")).alias("observation_id"),
        F.struct("title", F.lit(200).alias("status"), "html", "headers").alias("http"),
        F.when(F.col("cert_cn").isNotNull(), F.struct(subject.alias("cert"))).alias("ssl"),
        F.struct("country_code").alias("location"),
    )
