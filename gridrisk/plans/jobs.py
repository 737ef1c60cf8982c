"""The composed jobs: parcels → features, threat + census → scores, observations → fleet."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.operators import community, devices, parcels, threat, vulnerabilities
from gridrisk.session import scratch_path
from gridrisk.sources.snapshots import RunLog, SnapshotTable
from gridrisk.sources.writers import write_table


def community_features(parcel_rows: DataFrame, avm: DataFrame, geo: DataFrame,
                       state: str | None = None) -> dict[str, DataFrame]:
    """Enriched parcels and the ZIP, census and county feature tables.

    The enriched rows are written once; the three levels are aggregated from them in one pass.
    """
    spark = parcel_rows.sparkSession
    enriched = write_table(parcels.enrich_parcels(parcel_rows, avm, geo, state), scratch_path(spark, "parcels"))
    keys = {"by_census": "effective_census_key_decennial", "by_zip": "zip_code", "by_fips": "effective_fips_code"}
    levels = write_table(parcels.community_agg_levels(enriched, keys), scratch_path(spark, "levels"))
    tables = {
        name: levels.where(F.col("level") == name).drop("level").withColumnRenamed("geo_id", key) for name, key in keys.items()
    }
    return {"parcels": enriched, **tables}


def sync_job(hits: DataFrame, kev: DataFrame, root: str, notes: str = "full sync", buckets: int = 64) -> DataFrame:
    """One run of the vulnerability sync: listed records and the catalogue → the versioned tables below ``root``.

    ``hits`` are the rows of landed pages (``seq, keyword, cve``). The table ``cves`` is brought up
    to date: only buckets with a listed CVE, or with one that the catalogue changes, are written
    anew. ``products`` and ``references`` are refreshed whole. Each table switches with its commit,
    so readers see a table's old version or its new one. The run's audit row opens before anything
    is read and closes at the end, also of a run that fails. Returns the new snapshot.
    """
    spark = hits.sparkSession
    log = RunLog(spark, f"{root}/audit")
    run = log.open(notes)
    try:
        started = datetime.now(UTC)
        incoming = write_table(
            vulnerabilities.flatten_cves(hits).withColumn("created_at", F.lit(started)), scratch_path(spark, "incoming")
        )
        cves = SnapshotTable(spark, f"{root}/cves", "cve_id", buckets)

        def merged(current: DataFrame | None, inside: Callable[[DataFrame], DataFrame]) -> DataFrame:
            stored = incoming.limit(0) if current is None else current
            own = inside(kev.withColumn("cve_id", F.trim(F.coalesce("cveID", F.lit(""))))).drop("cve_id")
            rows = vulnerabilities.merge_kev(vulnerabilities.upsert_cves(stored, inside(incoming)), own)
            return rows.withColumn("created_at", F.coalesce("created_at", F.lit(started)))

        stored = None if cves.version() is None else cves.read()
        touched = incoming.select("cve_id").unionByName(vulnerabilities.changed_kev(kev, stored))
        cves.rewrite(touched, merged)
        snapshot = cves.read()
        # Products and references both read the first hits, without their other fields.
        kept = vulnerabilities.dedup_cve_first(vulnerabilities.only(hits, "configurations", "references"))
        first = write_table(kept, scratch_path(spark, "first"))
        tables = {"products": vulnerabilities.explode_products(first), "references": vulnerabilities.explode_references(first)}
        for name, rows in tables.items():
            table = SnapshotTable(spark, f"{root}/{name}", "cve_id", buckets)
            table.replace(rows)
            tables[name] = table.read()
        summary = vulnerabilities.sync_summary(snapshot, tables["products"], tables["references"], incoming)
        SnapshotTable(spark, f"{root}/summary", "metric", 1).replace(summary)
        log.close(run, notes, vulnerabilities.ingest_counts(incoming, snapshot))
    except BaseException:
        log.close(run, notes, failed=True)
        raise
    return snapshot


def threat_priors(products: DataFrame, cves: DataFrame) -> dict[str, DataFrame]:
    curated = threat.curate(products, cves)
    vendors = threat.vendor_priors(curated)
    return {"curated": curated, "vendors": vendors, "global": threat.global_priors(curated, vendors)}


def scores_v1(features: DataFrame, priors: DataFrame, key: str, digits: int | None = 2) -> DataFrame:
    return community.score_v1(features, priors, key, digits)


def scores_v2(acs: DataFrame, products: DataFrame, cves: DataFrame, digits: bool = True) -> DataFrame:
    """Census features, state-weighted pressure and the second score of inhabited communities."""
    places = 2 if digits else None
    base = threat.base_pressure(products, cves, digits=places, stat_digits=4 if digits else None)
    return community.score_v2(community.acs_features(acs), base, digits)


def fleet(observed: DataFrame) -> dict[str, DataFrame]:
    scored = devices.score_devices(devices.dedup_device(observed))
    return {
        "devices": scored,
        "by_country": devices.fleet_by_country(scored),
        "by_vendor": devices.fleet_by_vendor(scored),
        "global": devices.fleet_global(scored),
    }
