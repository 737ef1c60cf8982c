"""Vulnerability records, catalogue merge and parcels."""

import json

import pytest
from pyspark.sql import functions as F

from gridrisk.operators import lookup as L
from gridrisk.operators import parcels as P
from gridrisk.operators import vulnerabilities as V
from gridrisk.sources import readers as R
from gridrisk.sources.schemas import KEV_COLUMNS
from gridrisk.sources.snapshots import RunLog, SnapshotTable


def node(criteria, children=None, **extra):
    out = {"cpeMatch": [{"criteria": criteria, **extra}]}
    if children:
        out["nodes"] = children
    return out


def page(seq, cve_id, nodes=(), **fields):
    cve = {"id": cve_id, "configurations": [{"nodes": list(nodes)}], **fields}
    return json.dumps({"seq": seq, "keyword": "k", "vulnerabilities": [{"cve": cve}]})


def hits(spark, *pages, tmp=None):
    path = str(tmp / "pages")
    spark.createDataFrame([(p,) for p in pages], "value string").write.text(path)
    return R.read_cve_pages(spark, path)


def test_nested_nodes_are_all_found(spark, tmp_path):
    cpe = "cpe:2.3:o:v:p{}:*".format
    deep = node(cpe(1), [node(cpe(2), [node(cpe(3), [node(cpe(4))])])], vulnerable=False)
    rows = hits(spark, page(1, "A", [deep, node(cpe(5))]), page(2, "B", []), tmp=tmp_path)
    found = V.explode_products(rows)
    assert sorted(r["product"] for r in found.collect()) == ["p1", "p2", "p3", "p4", "p5"]
    assert {r["product"]: r.is_vulnerable for r in found.collect()}["p1"] == 0
    assert V.unparsed_nodes(rows).first().too_deep == 0


def test_nodes_nest_without_limit(spark, tmp_path):
    chain = node("cpe:2.3:o:v:p0:*")
    for i in range(1, 30):
        chain = node(f"cpe:2.3:o:v:p{i}:*", [chain, node(f"cpe:2.3:o:v:q{i}:*")])
    rows = hits(spark, page(1, "A", [chain, node("cpe:2.3:o:v:r:*")]), page(2, "B"), tmp=tmp_path)
    products = V.explode_products(rows)
    assert "Python" not in products._jdf.queryExecution().executedPlan().toString()
    names = [r["product"] for r in products.collect()]
    assert sorted(names) == sorted([f"p{i}" for i in range(30)] + [f"q{i}" for i in range(1, 30)] + ["r"])
    assert V.unparsed_nodes(rows).first().too_deep == 0


def test_fields_with_everything_missing(spark, tmp_path):
    row = V.flatten_cves(hits(spark, page(1, "A"), page(2, ""), tmp=tmp_path)).collect()
    assert len(row) == 1
    assert (row[0].description, row[0].has_cwe, row[0].cvss_score, row[0].published_date) == ("", 0, None, None)


def test_catalogue_merge(spark):
    cves = spark.createDataFrame(
        [("A", "NVD", "known", 1, 5.0), ("B", "NVD", "known", 0, None)],
        "cve_id string, source string, description string, has_cwe int, cvss_score double",
    )
    blank = dict.fromkeys(KEV_COLUMNS)
    rows = [
        (1, {**blank, "cveID": " A ", "dateAdded": "old"}),
        (2, {**blank, "cveID": "A", "dateAdded": "new"}),
        (3, {**blank, "cveID": "C", "shortDescription": "plain"}),
        (4, {**blank, "cveID": "C", "shortDescription": "a SOLAR thing", "dateAdded": "d4"}),
        (5, {**blank, "cveID": "C", "shortDescription": "plain", "dateAdded": "d5"}),
        (6, {**blank, "cveID": "D", "shortDescription": "plain"}),
        (7, {**blank, "cveID": ""}),
    ]
    kev = spark.createDataFrame(
        [(s, *[r[c] for c in KEV_COLUMNS]) for s, r in rows], "seq int, " + ", ".join(f"{c} string" for c in KEV_COLUMNS)
    )
    got = {r.cve_id: r for r in V.merge_kev(cves, kev).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"].cisa_kev, got["A"].kev_date_added, got["A"].description) == (1, "new", "known")
    assert (got["B"].cisa_kev, got["B"].has_cwe) == (0, 0)
    assert (got["C"].source, got["C"].description, got["C"].kev_date_added) == ("CISA_KEV", "a SOLAR thing", "d5")


def test_upsert_keeps_creation_and_takes_the_last(spark):
    shape = "cve_id string, seq int, status string, created_at int"
    now = spark.createDataFrame([("A", 1, "old", 10), ("B", 2, "old", 11)], shape)
    new = spark.createDataFrame([("A", 3, "mid", 20), ("A", 4, "new", 21), ("C", 5, "new", 22)], shape)
    out = {r.cve_id: (r.status, r.created_at) for r in V.upsert_cves(now, new).collect()}
    assert out == {"A": ("new", 10), "B": ("old", 11), "C": ("new", 22)}


def test_sync_runs_twice(spark, tmp_path):
    from gridrisk.plans.jobs import sync_job

    blank = dict.fromkeys(KEV_COLUMNS)

    def catalogue(*rows):
        shape = "seq int, " + ", ".join(f"{c} string" for c in KEV_COLUMNS)
        return spark.createDataFrame([(s, *[{**blank, **r}[c] for c in KEV_COLUMNS]) for s, r in rows], shape)

    def english(text):
        return [{"lang": "en", "value": text}]

    a, b = {"cveID": "A", "dateAdded": "d1"}, {"cveID": "K", "shortDescription": "solar", "dateAdded": "d2"}
    one = hits(spark, page(1, "A", [node("cpe:2.3:o:v:p:*")], descriptions=english("old")), tmp=tmp_path / "1")
    two = hits(spark, page(2, "A", descriptions=english("new")), page(3, "K", descriptions=english("found")), tmp=tmp_path / "2")
    root = str(tmp_path / "tables")
    sync_job(one, catalogue((1, a), (2, b)), root, "first", buckets=4)
    created = {r.cve_id: r.created_at for r in SnapshotTable(spark, f"{root}/cves", "cve_id").read().collect()}
    # The second catalogue has forgotten A; what the snapshot knows of it stays.
    out = {r.cve_id: r for r in sync_job(two, catalogue((1, b)), root, "second").collect()}
    assert set(out) == {"A", "K"}
    assert (out["A"].description, out["A"].cisa_kev, out["A"].kev_date_added) == ("new", 1, "d1")
    assert (out["K"].source, out["K"].description, out["K"].cisa_kev, out["K"].kev_date_added) == ("NVD", "found", 1, "d2")
    assert {i: r.created_at for i, r in out.items()} == created
    audit = {r.notes: r for r in RunLog(spark, f"{root}/audit").runs().collect()}
    assert set(audit) == {"first", "second"} and audit["second"].nvd_cve_count == 2
    assert all(r.status == "done" and r.started_at < r.completed_at for r in audit.values())
    summary = {r.metric: r.value for r in SnapshotTable(spark, f"{root}/summary", "metric").read(1).collect()}
    assert summary == {"cves": 2, "kev_cves": 2, "affected_products": 1, "references": 0, "keywords": 1, "vendor: v": 1}
    # A run that fails leaves its row and the tables as they were.
    broken = two.withColumn("cve", F.raise_error(F.lit("gone")))
    with pytest.raises(Exception):
        sync_job(broken, catalogue((1, b)), root, "third")
    audit = {r.notes: r.status for r in RunLog(spark, f"{root}/audit").runs().collect()}
    assert audit == {"first": "done", "second": "done", "third": "failed"}
    assert SnapshotTable(spark, f"{root}/cves", "cve_id").version() == 2


def test_snapshots_survive_a_killed_writer(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k", buckets=8)
    assert table.version() is None
    with pytest.raises(ValueError):
        table.read()
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int")
    assert table.replace(rows) == 1
    dies = rows.withColumn("v", F.when(F.col("k") == "k7", F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception):
        table.replace(dies)
    # What a dead writer left in a data folder is not read.
    (tmp_path / "t" / "data" / "dead" / "_bucket=1").mkdir(parents=True)
    assert table.version() == 1 and table.read().count() == 100
    one = spark.createDataFrame([("k7", -1), ("new", 5)], "k string, v int")

    def newest(current, inside):
        old = current.join(inside(one), "k", "left_anti")
        return old.unionByName(inside(one))

    before = table._commit_row().folders
    assert table.rewrite(one, newest) == 2
    after = table._commit_row().folders
    changed = {b for b in {*before, *after} if before.get(b) != after.get(b)}
    assert 1 <= len(changed) <= 2 and len(set(after.values())) == 2
    assert {r.k: r.v for r in table.read().collect()} == {f"k{i}": i for i in range(100)} | {"k7": -1, "new": 5}
    assert {r.k: r.v for r in table.read(1).collect()} == {f"k{i}": i for i in range(100)}
    assert table.rewrite(one.limit(0), newest) == 2
    # A bucket that becomes empty leaves the table, and so do all of them.
    assert table.rewrite(one, lambda current, inside: current.where("k <> 'k7' AND k <> 'new'")) == 3
    assert table.read().count() == 99
    table.replace(rows.limit(0))
    assert table.read().count() == 0 and table.read(3).count() == 99
    with pytest.raises(ValueError):
        table.rewrite(one, lambda current, inside: rows)


def test_blank_keys_join_and_rows_do_not_grow(spark):
    shape = (
        "record_id long, property_address string, city string, state string, zip_code string, zip4 string, fips_code string, "
        "census_key string, census_key_decennial string, latitude double, longitude double, land_use string, "
        "total_assessed_value double, year_built int, number_of_units int, garage_cars int"
    )
    empty = (None,) * 13
    parcels = spark.createDataFrame([(i, "1 Main St.", "X", "ca", "7001", *empty[2:]) for i in range(3)] + [(9, *empty, None, None)], shape)
    avm = spark.createDataFrame(
        [(1, "1 main st", "x", "CA", "07001", 10.0, 12.0, 8.0, None), (2, "1 MAIN ST", "x", "CA", "07001", 20.0, 22.0, 18.0, "2020-01-01"),
         (3, None, None, None, None, 5.0, 6.0, 4.0, "2020-01-01")],
        "record_id_avm long, address string, city string, state string, zip_code string, final_value double, high_value double, "
        "low_value double, valuation_date string",
    )
    geo = spark.createDataFrame(
        [(7, None, None, None, "06001", "ck", None, 1.0, 2.0)],
        "record_id_geo long, state string, zip_code string, zip4 string, geo_fips_code string, geo_census_key string, "
        "geo_census_key_decennial string, geo_latitude double, geo_longitude double",
    )
    out = {r.record_id: r for r in P.enrich_parcels(parcels, avm, geo).collect()}
    assert len(out) == 4
    assert out[0].final_value == 20.0 and not out[0].matched_geo
    assert out[9].final_value == 5.0 and out[9].effective_fips_code == "06001"
    assert P.enrich_parcels(parcels, avm, geo, state="ca").count() == 3


def test_address_split(spark):
    df = spark.createDataFrame([("123 Main St, Danville, ca 94528",), ("only",), ("a, b, 9x",)], "a string")
    got = [tuple(r) for r in df.select(L.address_split(F.col("a")).alias("s")).select("s.*").collect()]
    assert got == [("123 Main St", "Danville", "CA", "94528"), ("only", "", "", ""), ("a", "b", "", "")]


def test_first_hits_carry_only_named_fields(spark, tmp_path):
    rows = hits(spark, page(1, "A", [node("cpe:2.3:a:v:p:1")], references=[{"url": "u"}], vulnStatus="x"), tmp=tmp_path)
    first = V.dedup_cve_first(V.only(rows, "references"))
    assert first.schema["cve"].dataType.names == ["id", "references"]
    assert [(r.cve_id, r.url) for r in V.explode_references(first).collect()] == [("A", "u")]


def test_nodes_are_unfolded_in_one_scan_a_pass(spark, monkeypatch):
    """Four depths of a pass come from one read of the trees, not from one read a depth."""
    plans = []
    real = V.write_table
    monkeypatch.setattr(V, "write_table", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, path))
    deep = json.dumps([{"nodes": [node("a", [node("b", [node("c", [node("d", [node("e")])])])])]}])
    trees = spark.createDataFrame([(1, deep), (2, json.dumps(node("f"))), (3, None)], "record int, tree string")
    found = V.configuration_matches(trees).collect()
    assert sorted((r.record, json.loads(r.match)["criteria"]) for r in found) == [(1, c) for c in "abcde"] + [(2, "f")]
    assert len(plans) > 1 and all("Union" not in p for p in plans)
