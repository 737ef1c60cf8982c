"""Landed vulnerability records → flat tables, KEV merge and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.text import contains_any, date_prefix, empty_to_null
from gridrisk.operators.parcels import first_per_key
from gridrisk.session import scratch_path
from gridrisk.sources.schemas import CPE_MATCH
from gridrisk.sources.writers import write_table


def first_english(descriptions: Column) -> Column:
    """First English description, trimmed, else ''."""
    english = F.filter(descriptions, lambda d: d["lang"] == "en")
    return F.coalesce(F.trim(F.get(english, F.lit(0))["value"]), F.lit(""))


def _metric(items: Column) -> Column:
    m = F.get(items, F.lit(0))
    data = m["cvssData"]
    return F.when(
        m.isNotNull(),
        F.struct(
            data["version"].alias("cvss_version"),
            data["vectorString"].alias("cvss_vector"),
            m["source"].alias("cvss_source"),
            data["baseScore"].alias("cvss_score"),
            F.coalesce(empty_to_null(m["baseSeverity"]), data["baseSeverity"]).alias("cvss_severity"),
        ),
    )


def cvss_pick(metrics: Column) -> Column:
    """Metric struct of the first non-empty list among v3.1, v3.0 and v2."""
    return F.coalesce(
        _metric(metrics["cvssMetricV31"]), _metric(metrics["cvssMetricV30"]), _metric(metrics["cvssMetricV2"])
    )


def cvss_pick_v3(metrics: Column) -> Column:
    """Score and severity of v3.1 then v3.0 only; severity comes from the data part."""

    def pick(items: Column) -> Column:
        m = F.get(items, F.lit(0))
        return F.when(
            m.isNotNull(),
            F.struct(
                m["cvssData"]["baseScore"].alias("cvss_v3_score"),
                m["cvssData"]["baseSeverity"].alias("cvss_v3_severity"),
            ),
        )

    return F.coalesce(pick(metrics["cvssMetricV31"]), pick(metrics["cvssMetricV30"]))


def has_cwe(weaknesses: Column) -> Column:
    return F.when(F.coalesce(F.size(weaknesses), F.lit(0)) > 0, F.lit(1)).otherwise(F.lit(0))


def cpe_parse(criteria: Column) -> Column:
    """Struct of vendor and product; fewer than six parts gives nulls."""
    parts = F.split(criteria, ":")
    enough = F.size(parts) >= 6
    return F.struct(
        F.when(enough, empty_to_null(F.get(parts, F.lit(3)))).alias("vendor"),
        F.when(enough, empty_to_null(F.get(parts, F.lit(4)))).alias("product"),
    )


def flatten_cves(hits: DataFrame) -> DataFrame:
    """One flat ``cves`` row per hit ``(seq, keyword, cve)``."""
    c = F.col("cve")
    return (
        hits.select(
            "seq",
            "keyword",
            c["id"].alias("cve_id"),
            F.lit("NVD").alias("source"),
            empty_to_null(c["published"]).alias("published"),
            date_prefix(c["published"]).alias("published_date"),
            empty_to_null(c["lastModified"]).alias("last_modified"),
            date_prefix(c["lastModified"]).alias("last_modified_date"),
            c["vulnStatus"].alias("vuln_status"),
            first_english(c["descriptions"]).alias("description"),
            cvss_pick(c["metrics"]).alias("m"),
            has_cwe(c["weaknesses"]).alias("has_cwe"),
        )
        .select("*", "m.*")
        .drop("m")
    )


def dedup_cve_last(flat: DataFrame) -> DataFrame:
    """The last hit of each CVE, as an upsert in arrival order leaves it."""
    return first_per_key(flat, "cve_id", F.col("seq").desc())


def dedup_cve_first(hits: DataFrame) -> DataFrame:
    """The first hit of each CVE; references and products come from it."""
    return first_per_key(hits.withColumn("cve_id", F.col("cve.id")), "cve_id", F.col("seq").asc())


def only(hits: DataFrame, *fields: str) -> DataFrame:
    """Hits whose records have their id and the named fields alone, so that a sort does not carry the rest."""
    return hits.select("seq", "keyword", F.struct(*[F.col(f"cve.{f}").alias(f) for f in ("id", *fields)]).alias("cve"))


def keyword_hits(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("cve.id").alias("cve_id"), "keyword")


def _configurations(hits: DataFrame) -> Column:
    """The configurations as JSON text, whether landed as text or already parsed."""
    kind = dict(hits.select(F.col("cve.configurations").alias("c")).dtypes)["c"]
    return F.col("cve.configurations") if kind == "string" else F.to_json("cve.configurations")


#: Depths of nodes that one pass unfolds before what is left is written.
DEPTHS = 4


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def configuration_matches(trees: DataFrame) -> DataFrame:
    """``trees`` (its other columns, and ``tree``: JSON text) → one row for every match, however deep: ``match`` as JSON text.

    A node's matches are in its ``cpeMatch``, further nodes in ``children`` and ``nodes``. Each pass
    unfolds some depths in one go, in which a match found early travels along, and writes what it
    found and what is still folded; the passes end when nothing is. They work on variant values, so
    a text is parsed once.
    """
    spark = trees.sparkSession
    keep = [c for c in trees.columns if c != "tree"]
    none = F.array().cast("array<variant>")

    def listed(value: Column) -> Column:
        """The elements of a list, or the one node that stands in its place."""
        single = F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value))
        return F.coalesce(_array(value), single, none)

    def below(node: Column) -> Column:
        inner = [listed(F.try_variant_get(node, f"$.{c}", "variant")) for c in ("children", "nodes")]
        return F.concat(F.coalesce(_array(node), none), *inner)

    def unfolded(node: Column) -> Column:
        matches = F.coalesce(F.try_variant_get(node, "$.cpeMatch", "array<variant>"), none)
        return F.concat(
            F.transform(matches, lambda m: F.struct(F.lit(True).alias("found"), m.alias("value"))),
            F.transform(below(node), lambda n: F.struct(F.lit(False).alias("found"), n.alias("value"))),
        )

    nodes = trees.where("tree IS NOT NULL AND tree <> ''").select(
        *keep, F.struct(F.lit(False).alias("found"), F.parse_json("tree").alias("value")).alias("_node")
    )
    found = []
    while True:
        for _ in range(DEPTHS):
            node = F.col("_node")
            nodes = nodes.select(*keep, F.explode(F.when(node["found"], F.array(node)).otherwise(unfolded(node["value"]))).alias("_node"))
        match, node = F.when(F.col("_node.found"), F.to_json("_node.value")), F.when(~F.col("_node.found"), F.col("_node.value"))
        rows = nodes.select(*keep, match.alias("match"), node.alias("node"))
        done = write_table(rows, scratch_path(spark, "configuration-nodes"))
        found.append(done.where("match IS NOT NULL").select(*keep, "match"))
        folded = done.where("node IS NOT NULL")
        if folded.isEmpty():
            return reduce(DataFrame.unionByName, found)
        nodes = folded.select(*keep, F.struct(F.lit(False).alias("found"), F.col("node").alias("value")).alias("_node"))


def explode_products(hits: DataFrame) -> DataFrame:
    """Affected products of every configuration node, nested nodes of any depth included."""
    trees = hits.select(F.col("cve.id").alias("cve_id"), _configurations(hits).alias("tree"))
    rows = configuration_matches(trees).select("cve_id", F.from_json("match", CPE_MATCH).alias("m"))
    criteria = F.coalesce(F.col("m.criteria"), F.lit(""))
    return rows.withColumn("cpe", cpe_parse(criteria)).select(
        "cve_id",
        "cpe.vendor",
        "cpe.product",
        criteria.alias("cpe_uri"),
        F.col("m.versionStartIncluding").alias("version_start_including"),
        F.col("m.versionStartExcluding").alias("version_start_excluding"),
        F.col("m.versionEndIncluding").alias("version_end_including"),
        F.col("m.versionEndExcluding").alias("version_end_excluding"),
        F.when(F.coalesce(F.col("m.vulnerable"), F.lit(True)), F.lit(1)).otherwise(F.lit(0)).alias("is_vulnerable"),
    )


def unparsed_nodes(hits: DataFrame) -> DataFrame:
    """Count of records of which fewer matches are found than their text has criteria (should be zero)."""
    text = _configurations(hits)
    criteria = F.coalesce(F.regexp_count(text, F.lit(r'"criteria"\s*:')), F.lit(0))
    numbered = write_table(
        hits.select(F.monotonically_increasing_id().alias("record"), criteria.alias("n"), text.alias("tree")),
        scratch_path(hits.sparkSession, "configurations"),
    )
    found = configuration_matches(numbered.select("record", "tree")).groupBy("record").agg(F.count(F.lit(1)).alias("found"))
    rows = numbered.join(found, "record", "left")
    return rows.select(F.count(F.when(F.coalesce("found", F.lit(0)) < F.col("n"), F.lit(1))).alias("too_deep"))


def explode_references(hits: DataFrame) -> DataFrame:
    return (
        hits.select(F.col("cve.id").alias("cve_id"), F.explode("cve.references").alias("r"))
        .select(
            "cve_id",
            F.col("r.url").alias("url"),
            F.coalesce(F.col("r.source"), F.lit("")).alias("source"),
            F.coalesce(F.array_join("r.tags", ","), F.lit("")).alias("tags"),
        )
        .filter(F.coalesce(F.col("url"), F.lit("")) != "")
    )


def kev_relevant(vendor: Column, product: Column, description: Column, action: Column) -> Column:
    """Any configured term as a substring of the four fields."""
    parts = [F.coalesce(c, F.lit("")) for c in (vendor, product, description, action)]
    return contains_any(F.lower(F.concat_ws(" ", *parts)), C.KEV_TERMS)


_KEV_FIELDS = {
    "kev_vendor_project": "vendorProject",
    "kev_product": "product",
    "kev_date_added": "dateAdded",
    "kev_required_action": "requiredAction",
    "kev_due_date": "dueDate",
    "known_ransomware_use": "knownRansomwareCampaignUse",
}


def latest_kev(kev: DataFrame) -> DataFrame:
    """One row per trimmed CVE id: the last catalogue row, and the description of the first relevant one.

    A CVE that no search has found enters at its first relevant row, and later rows then update it.
    """
    relevant = kev_relevant(
        F.col("vendorProject"), F.col("product"), F.col("shortDescription"), F.col("requiredAction")
    )
    keyed = kev.withColumn("cve_id", F.trim(F.coalesce(F.col("cveID"), F.lit("")))).filter(F.col("cve_id") != "")
    last = F.max_by(F.struct(*[F.col(source).alias(name) for name, source in _KEV_FIELDS.items()]), "seq")
    entry = F.min_by(F.coalesce("shortDescription", F.lit("")), F.when(relevant, F.col("seq")))
    return keyed.groupBy("cve_id").agg(
        last.alias("k"), F.when(F.max(relevant), entry).alias("entry_description")
    ).select("cve_id", "k.*", "entry_description")


def merge_kev(cves: DataFrame, kev: DataFrame) -> DataFrame:
    """Full outer merge of the exploited-vulnerability catalogue into ``cves``, new or stored.

    A known CVE takes the catalogue fields; an unknown one is added only when a row of it is
    relevant. The catalogue has one row per CVE, so no CVE can fan out. Catalogue fields that
    ``cves`` already carries from an earlier run stay where the catalogue has no row.
    """
    right = latest_kev(kev).select(
        "cve_id", F.lit(1).alias("in_kev"), "entry_description", *[F.col(c).alias(f"new_{c}") for c in _KEV_FIELDS]
    )
    merged = cves.withColumn("in_cves", F.lit(1)).join(right, "cve_id", "full_outer").filter(
        F.col("in_cves").isNotNull() | F.col("entry_description").isNotNull()
    )
    new, hit = F.col("in_cves").isNull(), F.col("in_kev").isNotNull()
    own = ("cve_id", "source", "description", "has_cwe", "cisa_kev", *_KEV_FIELDS)

    def old(column: str, kind: str) -> Column:
        return F.col(column) if column in cves.columns else F.lit(None).cast(kind)

    return merged.select(
        "cve_id",
        F.when(new, F.lit("CISA_KEV")).otherwise(F.col("source")).alias("source"),
        F.when(new, F.col("entry_description")).otherwise(F.col("description")).alias("description"),
        F.when(new, F.lit(0)).otherwise(F.col("has_cwe")).alias("has_cwe"),
        *[c for c in cves.columns if c not in own],
        F.when(hit, F.lit(1)).otherwise(F.coalesce(old("cisa_kev", "int"), F.lit(0))).alias("cisa_kev"),
        *[F.when(hit, F.col(f"new_{c}")).otherwise(old(c, "string")).alias(c) for c in _KEV_FIELDS],
    )


def join_kev_flag(cves: DataFrame, kev: DataFrame) -> DataFrame:
    """Boolean membership of ``cve_id`` in the catalogue."""
    ids = kev.select(F.col("cveID").alias("cve_id")).distinct().withColumn("in_kev", F.lit(True))
    return cves.join(ids, "cve_id", "left").withColumn("in_kev", F.coalesce("in_kev", F.lit(False)))


def upsert_cves(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """New snapshot: the latest version of each CVE, with the earliest ``created_at`` kept.

    Both inputs carry ``seq`` (arrival order) and ``created_at``. Columns that only one side has,
    such as the catalogue fields of a stored snapshot, are filled with null on the other side, and
    an old catalogue value outlives a version without one. One aggregation, one shuffle. Store the
    result as a new version (``SnapshotTable.rewrite``); nothing is updated in place.
    """
    both = current.unionByName(incoming, allowMissingColumns=True)
    kept = [c for c in ("cisa_kev", *_KEV_FIELDS) if c in both.columns]
    plain = [c for c in both.columns if c not in ("cve_id", "created_at", *kept)]
    # A row that only the catalogue knows was never listed by a search.
    arrival = F.coalesce("seq", F.lit(-1))
    return both.groupBy("cve_id").agg(
        F.max_by(F.struct(*plain), arrival).alias("v"),
        F.min("created_at").alias("created_at"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), arrival)).alias(c) for c in kept],
    ).select("cve_id", "v.*", *kept, "created_at").select(*both.columns)


def sort_cve_export(cves: DataFrame) -> DataFrame:
    return cves.orderBy(
        F.coalesce("cvss_score", F.lit(0.0)).desc(), F.col("published_date").desc_nulls_last(), F.col("cve_id").asc()
    )


def sort_products(products: DataFrame) -> DataFrame:
    return products.orderBy("cve_id", "vendor", "product")


def sort_references(references: DataFrame) -> DataFrame:
    return references.orderBy("cve_id", "url")


def top_vendors(products: DataFrame, n: int = 15) -> DataFrame:
    """Vendors with most CVEs. Pairs are made distinct first, so one busy vendor spreads out."""
    pairs = products.filter(F.coalesce(F.col("vendor"), F.lit("")) != "").select("vendor", "cve_id").distinct()
    return (
        pairs.groupBy("vendor").agg(F.count("cve_id").alias("cve_count")).orderBy(F.desc("cve_count"), "vendor").limit(n)
    )


def sync_summary(cves: DataFrame, products: DataFrame, references: DataFrame, hits: DataFrame | None = None,
                 vendors: int = 15) -> DataFrame:
    """``metric, value``: counted tables, searched keywords (of ``hits``), then the vendors with most CVEs."""
    counts = cves.agg(F.count(F.lit(1)).alias("cves"), F.count(F.when(F.col("cisa_kev") == 1, 1)).alias("kev_cves"))
    out = (
        counts.unpivot([], ["cves", "kev_cves"], "metric", "value")
        .unionByName(products.agg(F.lit("affected_products").alias("metric"), F.count(F.lit(1)).alias("value")))
        .unionByName(references.agg(F.lit("references").alias("metric"), F.count(F.lit(1)).alias("value")))
    )
    if hits is not None:
        words = hits.select("keyword").distinct()
        out = out.unionByName(words.agg(F.lit("keywords").alias("metric"), F.count(F.lit(1)).alias("value")))
    top = top_vendors(products, vendors)
    return out.unionByName(top.select(F.concat(F.lit("vendor: "), "vendor").alias("metric"), F.col("cve_count").alias("value")))


def ingest_counts(flat: DataFrame, merged: DataFrame) -> tuple[int, int, int]:
    """What a run's audit row counts: searched keywords, listed CVEs, exploited CVEs of the new snapshot."""
    seen = flat.agg(F.countDistinct("keyword"), F.countDistinct("cve_id")).first()
    known = merged.agg(F.count(F.when(F.col("cisa_kev") == 1, 1))).first()
    return seen[0], seen[1], known[0]


def changed_kev(kev: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``cve_id`` of the catalogue's entries that would change ``stored`` CVEs, or add one."""
    latest = latest_kev(kev)
    if stored is None or "cisa_kev" not in stored.columns:
        return latest.select("cve_id")
    old = stored.select("cve_id", "cisa_kev", *[F.col(c).alias(f"old_{c}") for c in _KEV_FIELDS], F.lit(1).alias("held"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in _KEV_FIELDS])
    known = F.coalesce(F.col("cisa_kev") == 1, F.lit(False)) & same
    met = latest.join(old, "cve_id", "left")
    return met.where((F.col("held").isNotNull() & ~known) | (F.col("held").isNull() & F.col("entry_description").isNotNull())).select("cve_id")


def vendor_recent_count(products: DataFrame, cves: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """CVEs of each vendor published in the last ``days`` days before ``as_of``."""
    recent = cves.filter(
        F.to_date("published_date").between(F.date_sub(as_of, days), as_of)
    ).select("cve_id")
    pairs = (
        products.filter(F.coalesce(F.col("vendor"), F.lit("")) != "")
        .select("vendor", "cve_id")
        .distinct()
        .join(recent.withColumn("is_recent", F.lit(True)), "cve_id", "left")
    )
    return pairs.groupBy("vendor").agg(F.count("is_recent").alias("vendor_recent_cve_count"))
