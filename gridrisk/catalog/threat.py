"""Queries over vulnerabilities, products and vendor priors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gridrisk import adapters, constants as C
from gridrisk.catalog.registry import STEPS, query, sql_case, sql_contains_any, sql_list
from gridrisk.functions.matching import matched_keywords
from gridrisk.functions.text import date_prefix, is_relevant_text
from gridrisk.operators import threat as T
from gridrisk.operators import vulnerabilities as V
from gridrisk.plans import jobs as J
from gridrisk.session import scratch_path
from gridrisk.sources import readers
from gridrisk.sources.writers import write_table

_WORDS = r"\b(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in C.RELEVANT_TERMS) + r")\b"


def _relevant(x: str) -> str:
    return f"regexp_matches(lower(coalesce({x}, '')), '{_WORDS}')"


# str.title(): a letter after a non-letter is upper-cased. Sample vendors use '_' between words.
_TITLE = "array_to_string(list_transform(string_split(vendor, '_'), lambda w: upper(w[1]) || w[2:]), '_')"
_CANONICAL = sql_case([(f"vendor = '{raw}'", f"'{name}'") for raw, name in C.VENDOR_ALLOWLIST.items()], _TITLE)

STEPS["pr_merged"] = """
SELECT p.* REPLACE (lower(trim(coalesce(p.vendor, ''))) AS vendor, trim(coalesce(p.product, '')) AS product),
       c.published_date, c.cvss_score, c.cvss_severity, c.cisa_kev, c.description, c.source
FROM v_products p LEFT JOIN v_cves c ON p.cve_id = c.cve_id
"""
STEPS["pr_vulnerable"] = f"""
SELECT * FROM pr_merged WHERE is_vulnerable = 1
  AND (vendor IN ({sql_list(list(C.VENDOR_ALLOWLIST))}) OR {_relevant('product')} OR {_relevant('description')})
  AND vendor NOT IN ({sql_list(C.VENDOR_DENYLIST)})
"""
STEPS["pr_vendor_only"] = f"""
SELECT * FROM pr_merged WHERE is_vulnerable = 1 AND vendor IN ({sql_list(list(C.VENDOR_ALLOWLIST))})
  AND vendor NOT IN ({sql_list(C.VENDOR_DENYLIST)})
"""
STEPS["pr_curated"] = f"""
SELECT DISTINCT cve_id, vendor_canonical, product, cpe_uri, version_start_including, version_start_excluding,
       version_end_including, version_end_excluding, cvss_score, cvss_severity, cisa_kev, published_date, description,
       coalesce(cvss_score, 0) >= 9 AS critical_flag, coalesce(cvss_score, 0) >= 7 AS high_flag,
       coalesce(cvss_score, 5.0) / 10.0 + coalesce(cisa_kev, 0) * 0.5
         + CASE WHEN coalesce(cvss_score, 0) >= 9 THEN 0.25 ELSE 0 END AS vuln_weight
FROM (SELECT *, {_CANONICAL} AS vendor_canonical FROM pr_vulnerable) v
"""
STEPS["vendor_prior_rows"] = """
SELECT *, 35 * (coalesce(max_cvss, 0) / 10.0) + 25 * (critical_cve_count / cve_count)
          + 20 * (kev_cve_count / cve_count) + 20 * (coalesce(avg_cvss, 0) / 10.0) AS vendor_risk_score
FROM (
SELECT vendor_canonical AS vendor, count(DISTINCT cve_id) AS cve_count, count(DISTINCT product) AS product_count,
       count(DISTINCT CASE WHEN critical_flag THEN cve_id END) AS critical_cve_count,
       count(DISTINCT CASE WHEN high_flag THEN cve_id END) AS high_or_worse_count,
       count(DISTINCT CASE WHEN cisa_kev = 1 THEN cve_id END) AS kev_cve_count,
       avg(cvss_score) AS avg_cvss, max(cvss_score) AS max_cvss, avg(vuln_weight) AS avg_vuln_weight
FROM pr_curated GROUP BY vendor_canonical) v
"""
_PRESSURE = """100 * (0.35 * (max_cvss / 10.0) + 0.25 * (critical / cves) + 0.20 * ({kev} / cves) + 0.20 * (avg_cvss / 10.0))"""


def _corpus_sql(rows: str, vendor: str) -> str:
    return f"""
SELECT count(DISTINCT cve_id) AS cves, count(DISTINCT CASE WHEN coalesce(cvss_score, 0) >= 9 THEN cve_id END) AS critical,
       count(DISTINCT CASE WHEN cisa_kev = 1 THEN cve_id END) AS kev, CAST(sum(coalesce(cisa_kev, 0)) AS BIGINT) AS kev_rows,
       count(DISTINCT {vendor}) AS vendors, avg(coalesce(cvss_score, 0)) AS avg_cvss, max(coalesce(cvss_score, 0)) AS max_cvss
FROM {rows}
"""


STEPS["global_corpus"] = _corpus_sql("pr_curated", "vendor_canonical")
STEPS["vendor_corpus"] = _corpus_sql("pr_vendor_only", "vendor")
STEPS["global_prior_row"] = f"""
SELECT cves AS solar_cve_count, critical AS solar_critical_cve_count, kev AS solar_kev_cve_count,
       vendors AS solar_vendor_count, avg_cvss AS solar_avg_cvss, max_cvss AS solar_max_cvss,
       (SELECT avg(vendor_risk_score) FROM vendor_prior_rows) AS solar_avg_vendor_risk,
       {_PRESSURE.format(kev='kev')} AS solar_cyber_pressure_score
FROM global_corpus
"""
STEPS["base_row"] = f"""
SELECT {_PRESSURE.format(kev='kev')} AS base_pressure, cves AS solar_cve_count, critical AS solar_critical_cve_count,
       kev AS solar_kev_cve_count, vendors AS solar_vendor_count, avg_cvss AS solar_avg_cvss, max_cvss AS solar_max_cvss
FROM vendor_corpus
"""

CURATED_COLUMNS = [
    "cve_id", "vendor_canonical", "product", "cpe_uri", "version_start_including", "version_end_including",
    "cvss_score", "cvss_severity", "cisa_kev", "published_date", "description", "critical_flag", "high_flag", "vuln_weight",
]


def merged(t):
    return T.join_products_cves(T.clean_products(t.v_products), t.v_cves)


def curated(t):
    return T.curate(t.v_products, t.v_cves)


def curated_table(t):
    """Curated products as a written table, for results that read them several times."""
    return write_table(curated(t), scratch_path(t.spark, "curated"))


def priors(t):
    return T.vendor_priors(curated(t), None)


# --- curation ------------------------------------------------------------------------------
@query("join_products_cves", """
SELECT vendor, product, count(*) AS n, count(cvss_score) AS scored, sum(cvss_score) AS score_sum
FROM pr_merged GROUP BY vendor, product
""", ["score_sum"])
def _(t):
    return merged(t).groupBy("vendor", "product").agg(
        F.count(F.lit(1)).alias("n"), F.count("cvss_score").alias("scored"), F.sum("cvss_score").alias("score_sum")
    )


@query("is_relevant_text", f"SELECT doc_id, {_relevant('text')} AS relevant FROM documents")
def _(t):
    return t.documents.select("doc_id", is_relevant_text(F.col("text"), C.RELEVANT_TERMS).alias("relevant"))


@query("vendor_canonical", f"SELECT DISTINCT vendor, {_CANONICAL} AS vendor_canonical FROM pr_merged")
def _(t):
    return T.clean_products(t.v_products).select("vendor").distinct().withColumn(
        "vendor_canonical", T.vendor_canonical(F.col("vendor"))
    )


@query("filter_vulnerable_solar", "SELECT cve_id, vendor, product, count(*) AS n FROM pr_vulnerable GROUP BY ALL")
def _(t):
    return T.filter_vulnerable(merged(t)).groupBy("cve_id", "vendor", "product").agg(F.count(F.lit(1)).alias("n"))


@query("filter_vendor_only", "SELECT cve_id, vendor, product, count(*) AS n FROM pr_vendor_only GROUP BY ALL")
def _(t):
    return T.filter_vendor_only(merged(t)).groupBy("cve_id", "vendor", "product").agg(F.count(F.lit(1)).alias("n"))


@query("severity_flags", """
SELECT cve_id, coalesce(cvss_score, 0) >= 9 AS critical_flag, coalesce(cvss_score, 0) >= 7 AS high_flag,
       coalesce(cvss_score, 5.0) / 10.0 + coalesce(cisa_kev, 0) * 0.5
         + CASE WHEN coalesce(cvss_score, 0) >= 9 THEN 0.25 ELSE 0 END AS vuln_weight FROM v_cves
""", ["vuln_weight"])
def _(t):
    return T.severity_flags(t.v_cves).select("cve_id", "critical_flag", "high_flag", "vuln_weight")


@query("dedup_products", f"SELECT DISTINCT {', '.join(T.PRODUCT_KEY)} FROM pr_curated")
def _(t):
    relevant = T.filter_vulnerable(merged(t))
    return T.dedup_products(relevant.withColumn("vendor_canonical", T.vendor_canonical(F.col("vendor"))))


@query("curated_products", f"SELECT {', '.join(CURATED_COLUMNS)} FROM pr_curated", ["cvss_score", "vuln_weight"])
def _(t):
    return curated(t).select(*CURATED_COLUMNS)


@query("sort_curated", "SELECT vendor_canonical, cve_id, product, cvss_score FROM pr_curated", ["cvss_score"])
def _(t):
    return T.sort_curated(curated(t)).select("vendor_canonical", "cve_id", "product", "cvss_score")


# --- priors --------------------------------------------------------------------------------
_PRIOR_DOUBLES = ["avg_cvss", "max_cvss", "avg_vuln_weight", "vendor_risk_score"]


@query("vendor_priors", "SELECT * FROM vendor_prior_rows", _PRIOR_DOUBLES)
def _(t):
    return priors(t)


@query("sort_vendor_priors", "SELECT vendor, cve_count, avg_vuln_weight FROM vendor_prior_rows", ["avg_vuln_weight"])
def _(t):
    return T.sort_vendor_priors(priors(t)).select("vendor", "cve_count", "avg_vuln_weight")


@query("vendor_ranking", """
SELECT vendor, vendor_risk_score, cve_count, avg_cvss, critical_cve_count FROM vendor_prior_rows
""", ["vendor_risk_score", "avg_cvss"])
def _(t):
    return T.vendor_ranking(priors(t)).select("vendor", "vendor_risk_score", "cve_count", "avg_cvss", "critical_cve_count")


@query("vendor_band", """
SELECT vendor, CASE WHEN vendor_risk_score >= 60 THEN 'high' WHEN vendor_risk_score >= 40 THEN 'medium' ELSE 'low' END AS band
FROM vendor_prior_rows
""")
def _(t):
    return priors(t).select("vendor", T.vendor_band(F.col("vendor_risk_score")).alias("band"))


STEPS["vendor_alt_rows"] = """
SELECT *, 0.40 * (max_cvss_score / 10.0) + 0.25 * (critical_cve_count / cve_count) + 0.20 * (kev_count / cve_count)
          + 0.15 * avg_vuln_weight AS vendor_risk_prior
FROM (
SELECT vendor_canonical AS vendor, count(DISTINCT cve_id) AS cve_count, count(DISTINCT product) AS product_count,
       count(DISTINCT CASE WHEN critical_flag THEN cve_id END) AS critical_cve_count,
       count(DISTINCT CASE WHEN high_flag THEN cve_id END) AS high_or_worse_count,
       CAST(sum(coalesce(cisa_kev, 0)) AS BIGINT) AS kev_count,
       coalesce(max(cvss_score), 0) AS max_cvss_score, avg(vuln_weight) AS avg_vuln_weight
FROM pr_curated GROUP BY vendor_canonical) v
"""


@query("vendor_priors_alt", "SELECT * FROM vendor_alt_rows", ["max_cvss_score", "avg_vuln_weight", "vendor_risk_prior"])
def _(t):
    return T.vendor_priors_alt(curated(t), None)


@query("view_vendors", """
SELECT *, round_even(vendor_risk_prior * 100, 1) AS vendor_risk_score FROM vendor_alt_rows
""", ["max_cvss_score", "avg_vuln_weight", "vendor_risk_prior"])
def _(t):
    return T.view_vendors(T.vendor_priors_alt(curated(t), None))


_GLOBAL_DOUBLES = ["solar_avg_cvss", "solar_max_cvss", "solar_avg_vendor_risk", "solar_cyber_pressure_score"]


@query("global_priors", "SELECT * FROM global_prior_row", _GLOBAL_DOUBLES)
def _(t):
    rows = curated_table(t)
    return T.global_priors(rows, T.vendor_priors(rows, None), None, None)


@query("base_pressure", "SELECT * FROM base_row", ["base_pressure", "solar_avg_cvss", "solar_max_cvss"])
def _(t):
    return T.base_pressure(t.v_products, t.v_cves, None, None)


@query("base_pressure_kev_rows", f"""
SELECT {_PRESSURE.format(kev='kev_rows')} AS base_pressure, kev_rows AS solar_kev_cve_count FROM vendor_corpus
""", ["base_pressure"])
def _(t):
    return T.base_pressure(t.v_products, t.v_cves, None, None, count_kev_rows=True).select("base_pressure", "solar_kev_cve_count")


@query("top_vendors", """
SELECT vendor, count(DISTINCT cve_id) AS cve_count FROM v_products WHERE vendor IS NOT NULL AND vendor <> ''
GROUP BY vendor ORDER BY cve_count DESC, vendor LIMIT 15
""")
def _(t):
    return V.top_vendors(t.v_products)


@query("vendor_recent_count", """
SELECT vendor, count(DISTINCT CASE WHEN CAST(published_date AS DATE) BETWEEN DATE '2024-12-31' - 400 AND DATE '2024-12-31'
                              THEN p.cve_id END) AS vendor_recent_cve_count
FROM v_products p LEFT JOIN v_cves c ON p.cve_id = c.cve_id WHERE vendor IS NOT NULL AND vendor <> '' GROUP BY vendor
""")
def _(t):
    return V.vendor_recent_count(t.v_products, t.v_cves, F.lit("2024-12-31").cast("date"), 400)


@query("sort_cve_export", "SELECT cve_id, published_date, cvss_score, cisa_kev, description FROM v_cves", ["cvss_score"])
def _(t):
    return V.sort_cve_export(t.v_cves).select("cve_id", "published_date", "cvss_score", "cisa_kev", "description")


@query("sort_products", "SELECT cve_id, vendor, product, cpe_uri, is_vulnerable FROM v_products")
def _(t):
    return V.sort_products(t.v_products).select("cve_id", "vendor", "product", "cpe_uri", "is_vulnerable")


# --- parsing of landed records -------------------------------------------------------------
STEPS["h_flat"] = """
SELECT seq, keyword, cve_id, 'NVD' AS source, nullif(published, '') AS published,
       substring(nullif(published, ''), 1, 10) AS published_date, last_modified, substring(last_modified, 1, 10) AS last_modified_date,
       vuln_status, CASE WHEN lang = 'en' THEN trim(text_value) ELSE '' END AS description,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS has_cwe,
       version AS cvss_version, 'V:' || version AS cvss_vector, CASE WHEN version IS NOT NULL THEN 'nvd@example' END AS cvss_source,
       CASE WHEN version IS NOT NULL THEN score END AS cvss_score,
       CASE WHEN version = '2.0' THEN 'LEGACY' WHEN version IS NOT NULL THEN severity END AS cvss_severity
FROM v_cve_hits
"""
STEPS["h_last"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY seq DESC) AS rn FROM h_flat) h WHERE rn = 1"
STEPS["h_first"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY seq) AS rn FROM v_cve_hits) h WHERE rn = 1"


def found(t):
    """The sample's hits, dealt out first: their records take far more work than the few file splits they come from."""
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism)
    return t.v_cve_hits.repartition(parts)


def hits(t):
    """Parsed records: the page documents are serialised and parsed again from their text."""
    pages = adapters.cve_pages(found(t)).select(F.to_json(F.struct("*")).alias("page"))
    schema = readers.S.CVE_PAGE_SCHEMA
    return readers.explode_cve_pages(pages.select(F.from_json("page", schema).alias("p")).select("p.*"))


def records(t):
    """The nested records themselves, for operators that need no reader."""
    return readers.explode_cve_pages(adapters.cve_pages(found(t)))


def flat(t):
    return V.flatten_cves(records(t))


@query("ts_date_prefix", "SELECT seq, published, published_date, last_modified_date FROM h_flat")
def _(t):
    return t.v_cve_hits.select(
        "seq", F.nullif("published", F.lit("")).alias("published"), date_prefix(F.col("published")).alias("published_date"),
        date_prefix(F.col("last_modified")).alias("last_modified_date"),
    )


@query("desc_english", "SELECT seq, description FROM h_flat")
def _(t):
    return records(t).select("seq", V.first_english(F.col("cve.descriptions")).alias("description"))


_CVSS = ["cvss_version", "cvss_vector", "cvss_source", "cvss_score", "cvss_severity"]


@query("cvss_pick", f"SELECT seq, {', '.join(_CVSS)} FROM h_flat", ["cvss_score"])
def _(t):
    return records(t).select("seq", V.cvss_pick(F.col("cve.metrics")).alias("m")).select("seq", "m.*")


STEPS["h_v3"] = """
SELECT seq, cve_id, p_partkey, CASE WHEN version IN ('3.1', '3.0') THEN score END AS cvss_v3_score,
       CASE WHEN version IN ('3.1', '3.0') THEN severity END AS cvss_v3_severity,
       CASE WHEN lang = 'en' THEN trim(text_value) ELSE '' END AS description
FROM h_first
"""


@query("cvss_pick_v3", "SELECT cve_id, cvss_v3_score, cvss_v3_severity FROM h_v3", ["cvss_v3_score"])
def _(t):
    first = V.dedup_cve_first(V.only(records(t), "metrics"))
    return first.select("cve_id", V.cvss_pick_v3(F.col("cve.metrics")).alias("m")).select("cve_id", "m.*")


@query("has_cwe", "SELECT seq, has_cwe FROM h_flat")
def _(t):
    return records(t).select("seq", V.has_cwe(F.col("cve.weaknesses")).alias("has_cwe"))


@query("cpe_parse", """
SELECT cve_id, cpe_uri, CASE WHEN len(s) >= 6 THEN nullif(s[4], '') END AS cpe_vendor,
       CASE WHEN len(s) >= 6 THEN nullif(s[5], '') END AS cpe_product
FROM (SELECT cve_id, cpe_uri, string_split(cpe_uri, ':') AS s FROM v_products) p
""")
def _(t):
    return t.v_products.select("cve_id", "cpe_uri", V.cpe_parse(F.col("cpe_uri")).alias("c")).select(
        "cve_id", "cpe_uri", F.col("c.vendor").alias("cpe_vendor"), F.col("c.product").alias("cpe_product")
    )


STEPS["h_products"] = """
SELECT cve_id, 'growatt' AS vendor, 'p' || CAST(p_partkey % 9 AS STRING) AS product, 1 AS is_vulnerable, p_partkey, p_size,
       'cpe:2.3:o:growatt:p' || CAST(p_partkey % 9 AS STRING) || ':*:x' AS cpe_uri FROM h_first
UNION ALL
SELECT cve_id, 'sma', 'p' || CAST(p_partkey % 9 AS STRING), CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END, p_partkey, p_size,
       'cpe:2.3:o:sma:p' || CAST(p_partkey % 9 AS STRING) || ':*:x' FROM h_first
UNION ALL
SELECT cve_id, NULL, NULL, 1, NULL, NULL, 'cpe:short' FROM h_first
"""


@query("explode_products", """
SELECT cve_id, vendor, product, cpe_uri, CASE WHEN p_partkey % 2 = 0 THEN '1.0' END AS version_start_including,
       '9.' || CAST(p_size AS STRING) AS version_end_excluding, CAST(is_vulnerable AS INT) AS is_vulnerable FROM h_products
""")
def _(t):
    return V.explode_products(V.dedup_cve_first(V.only(hits(t), "configurations"))).select(
        "cve_id", "vendor", "product", "cpe_uri", "version_start_including", "version_end_excluding", "is_vulnerable"
    )


@query("unparsed_nodes", "SELECT CAST(0 AS BIGINT) AS too_deep, count(*) AS hits FROM v_cve_hits")
def _(t):
    rows = write_table(V.only(hits(t), "configurations"), scratch_path(t.spark, "hits"))
    return V.unparsed_nodes(rows).withColumn("hits", rows.agg(F.count(F.lit(1))).scalar())


@query("explode_references", """
SELECT cve_id, 'https://ref.example/' || CAST(seq AS STRING) AS url, 'src' AS source, 'Patch,Vendor Advisory' AS tags FROM h_first
""")
def _(t):
    return V.explode_references(V.dedup_cve_first(V.only(records(t), "references")))


@query("sort_references", """
SELECT cve_id, 'https://ref.example/' || CAST(seq AS STRING) AS url FROM h_first
""")
def _(t):
    return V.sort_references(V.explode_references(V.dedup_cve_first(V.only(records(t), "references")))).select("cve_id", "url")


@query("dedup_cve_first", "SELECT cve_id, seq FROM h_first")
def _(t):
    return V.dedup_cve_first(records(t)).select("cve_id", "seq")


@query("dedup_cve_last", "SELECT cve_id, seq, vuln_status, last_modified_date FROM h_last")
def _(t):
    return V.dedup_cve_last(flat(t)).select("cve_id", "seq", "vuln_status", "last_modified_date")


@query("keyword_hits", "SELECT cve_id, keyword FROM v_cve_hits")
def _(t):
    return V.keyword_hits(records(t))


@query("vendor_keyword_array", f"""
SELECT cve_id, coalesce(array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(description), '{v}') THEN '{v}' END" for v in C.ALERT_VENDORS)}], lambda x: x IS NOT NULL), ','), '') AS vendors
FROM h_v3
""")
def _(t):
    first = V.dedup_cve_first(V.only(records(t), "descriptions"))
    text = V.first_english(F.col("cve.descriptions"))
    return first.select("cve_id", F.array_join(matched_keywords(text, C.ALERT_VENDORS), ",").alias("vendors"))


# --- exploited-vulnerability catalogue -----------------------------------------------------
_KEV_TEXT = "lower(coalesce(vendorProject, '') || ' ' || coalesce(product, '') || ' ' || coalesce(shortDescription, '') || ' ' || coalesce(requiredAction, ''))"
STEPS["k_rows"] = f"SELECT *, trim(cveID) AS cve_id, {sql_contains_any(_KEV_TEXT, C.KEV_TERMS)} AS relevant FROM v_kev"
STEPS["k_last"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY seq DESC) AS rn FROM k_rows) k WHERE rn = 1"
STEPS["k_entry"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY seq) AS rn FROM k_rows WHERE relevant) k WHERE rn = 1"


@query("kev_relevant", "SELECT seq, relevant FROM k_rows")
def _(t):
    return t.v_kev.select(
        "seq",
        V.kev_relevant(F.col("vendorProject"), F.col("product"), F.col("shortDescription"), F.col("requiredAction")).alias("relevant"),
    )


STEPS["merged_kev"] = """
SELECT coalesce(h.cve_id, k.cve_id) AS cve_id, CASE WHEN h.cve_id IS NULL THEN 'CISA_KEV' ELSE h.source END AS source,
       CASE WHEN h.cve_id IS NULL THEN e.shortDescription ELSE h.description END AS description, h.published_date, h.cvss_score,
       CAST(CASE WHEN k.cve_id IS NULL THEN 0 ELSE 1 END AS INT) AS cisa_kev, k.vendorProject AS kev_vendor_project,
       k.dateAdded AS kev_date_added, k.knownRansomwareCampaignUse AS known_ransomware_use,
       CAST(CASE WHEN h.cve_id IS NULL THEN 0 ELSE h.has_cwe END AS INT) AS has_cwe
FROM h_last h FULL OUTER JOIN k_last k ON h.cve_id = k.cve_id LEFT JOIN k_entry e ON k.cve_id = e.cve_id
WHERE h.cve_id IS NOT NULL OR e.cve_id IS NOT NULL
"""
_MERGED = [
    "cve_id", "source", "description", "published_date", "cvss_score", "cisa_kev", "kev_vendor_project",
    "kev_date_added", "known_ransomware_use", "has_cwe",
]


def merged_kev(t):
    return V.merge_kev(V.dedup_cve_last(flat(t)), t.v_kev)


@query("merge_kev", f"SELECT {', '.join(_MERGED)} FROM merged_kev", ["cvss_score"])
def _(t):
    return merged_kev(t).select(*_MERGED)


@query("join_kev_flag", "SELECT cve_id, cve_id IN (SELECT cve_id FROM k_rows) AS in_kev FROM v_cves")
def _(t):
    return V.join_kev_flag(t.v_cves, t.v_kev.withColumn("cveID", F.trim("cveID"))).select("cve_id", "in_kev")


STEPS["pressure_rows"] = f"""
SELECT vendor, cve_count, coalesce(max_cvss, 0.0) AS max_cvss, coalesce(mean_cvss, 0.0) AS mean_cvss, critical_cve_count, kev_count,
       0.4 * (coalesce(max_cvss, 0) / 10) + 0.3 * (coalesce(mean_cvss, 0) / 10)
       + 0.2 * coalesce(critical_cve_count / nullif(cve_count, 0), 0) + 0.1 * coalesce(kev_count / nullif(cve_count, 0), 0) AS cyber_pressure_score
FROM (
SELECT v.vendor, count(h.cve_id) AS cve_count, max(cvss_v3_score) AS max_cvss, avg(cvss_v3_score) AS mean_cvss,
       count(*) FILTER (WHERE cvss_v3_score >= 9) AS critical_cve_count,
       count(*) FILTER (WHERE h.cve_id IN (SELECT cve_id FROM k_rows)) AS kev_count
FROM (VALUES {', '.join(f"('{v}')" for v in C.ALERT_VENDORS)}) v(vendor) LEFT JOIN h_v3 h ON contains(lower(h.description), v.vendor)
GROUP BY v.vendor) p
"""


def v3_rows(t):
    first = V.dedup_cve_first(V.only(records(t), "descriptions", "metrics")).select(
        "cve_id",
        V.first_english(F.col("cve.descriptions")).alias("description"),
        V.cvss_pick_v3(F.col("cve.metrics")).alias("m"),
    ).select("cve_id", "description", "m.*")
    flagged = V.join_kev_flag(first, t.v_kev.withColumn("cveID", F.trim("cveID")))
    return write_table(T.tag_vendors(flagged), scratch_path(t.spark, "tagged"))


@query("vendor_pressure_text", "SELECT * FROM pressure_rows", ["max_cvss", "mean_cvss", "cyber_pressure_score"])
def _(t):
    return T.vendor_pressure_text(v3_rows(t), digits=None)


@query("upsert_cves", """
SELECT cve_id, seq, vuln_status, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY seq DESC) AS rn, min(seq) OVER (PARTITION BY cve_id) AS created_at
  FROM h_flat) h WHERE rn = 1
""")
def _(t):
    rows = flat(t).withColumn("created_at", F.col("seq"))
    current, incoming = rows.filter("keyword = 'solar inverter'"), rows.filter("keyword = 'photovoltaic'")
    return V.upsert_cves(current, incoming).select("cve_id", "seq", "vuln_status", "created_at")


@query("sync_summary", """
SELECT 'cves' AS metric, count(*) AS value FROM merged_kev
UNION ALL SELECT 'kev_cves', count(*) FROM merged_kev WHERE cisa_kev = 1
UNION ALL SELECT 'affected_products', count(*) FROM h_products
UNION ALL SELECT 'references', count(*) FROM h_first
UNION ALL SELECT 'keywords', count(DISTINCT keyword) FROM v_cve_hits
UNION ALL SELECT 'vendor: ' || vendor, count(DISTINCT cve_id) FROM h_products WHERE vendor IS NOT NULL GROUP BY vendor
""")
def _(t):
    rows = write_table(V.only(hits(t), "configurations", "references"), scratch_path(t.spark, "hits"))
    first = write_table(V.dedup_cve_first(rows), scratch_path(t.spark, "first"))
    return V.sync_summary(merged_kev(t), V.explode_products(first), V.explode_references(first), rows)


@query("sync_job", f"""
SELECT m.cve_id, m.source, m.description, m.cisa_kev, m.kev_date_added, m.has_cwe, CASE WHEN m.source = 'NVD' THEN h.vuln_status END AS vuln_status
FROM merged_kev m LEFT JOIN h_last h ON m.cve_id = h.cve_id
""")
def _(t):
    """Two runs: the first keyword with the catalogue's first state, then both with the whole catalogue."""
    base = scratch_path(t.spark, "sync")
    early = t.v_kev.filter("seq < 100000000")
    J.sync_job(records(t).filter("keyword = 'solar inverter'"), early, base, buckets=16)
    return J.sync_job(records(t), t.v_kev, base).select(
        "cve_id", "source", "description", "cisa_kev", "kev_date_added", "has_cwe", "vuln_status"
    )
