"""Readers, sinks, scratch folder and the alert stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from gridrisk.operators.community import readiness_alert
from gridrisk.session import scratch_path, scratch_root
from gridrisk.sources import readers as R
from gridrisk.sources import writers as W
from gridrisk.streaming import alerts as A


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(scratch_root(spark) + "/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_header_matrix_goes_by_name(spark):
    rows = [(json.dumps([["b", "a"], ["1", "2"], ["3", "4"]]),), (json.dumps([["a", "z"], ["5", "6"]]),)]
    out = R.header_matrix(spark.createDataFrame(rows, "p string"), "p", {"a": "x", "b": "y"})
    assert sorted(((r.x, r.y) for r in out.collect()), key=str) == [("2", "1"), ("4", "3"), ("5", None)]


def test_csv_keeps_quotes_and_leading_zeros(spark, tmp_path):
    df = spark.createDataFrame([("007", 'say "hi", all'), ("7", None)], "k string, v string")
    W.write_csv(df, str(tmp_path / "c"))
    got = R.read_csv_strings(spark, str(tmp_path / "c"), ["k", "v"])
    assert sorted(tuple(r) for r in got.collect()) == sorted([("007", 'say "hi", all'), ("7", None)])


def test_gazetteer_columns_by_part(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_bytes("GEOID\tNAME\tINTPTLAT\tINTPTLONG      \n601\tPe\xf1a\t18.1\t-66.7  \n602\tX\t\t-1\n".encode("latin-1"))
    assert [tuple(r) for r in R.read_gazetteer(spark, str(path)).collect()] == [("00601", 18.1, -66.7)]


def test_device_array_file(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"ip": "a", "port": 1}, {"ip": "b", "port": 2}], indent=1))
    assert R.read_devices_json(spark, str(path), multi_line=True).count() == 2


def test_vendor_dictionary_keeps_order(spark):
    text = json.dumps(
        {
            "vendors": {"V": {"risk_level": "HIGH", "cves": {"C2": {"cvss": 7.5}, "C1": {"cvss": "HIGH"}}}, "W": {"risk_level": "LOW"}},
            "keyword_to_vendor_map": {"zz": "V", "aa": "W"},
        }
    )
    dims = R.vendor_dictionary(spark.createDataFrame([(text,)], "t string"), "t")
    assert [(r.position, r.cve_id, r.cvss) for r in dims["cves"].collect()] == [(0, "C2", "7.5"), (1, "C1", "HIGH")]
    assert [(r.position, r.keyword) for r in dims["keywords"].collect()] == [(0, "zz"), (1, "aa")]
    assert dims["vendors"].count() == 2 and dims["firmware"].count() == 0


def landed(path, name, *cves):
    path.mkdir(exist_ok=True)
    lines = []
    for cve_id, text, score in cves:
        metric = [{"cvssData": {"baseScore": score, "baseSeverity": "HIGH"}}]
        cve = {"id": cve_id, "descriptions": [{"lang": "en", "value": text}], "metrics": {"cvssMetricV31": metric}}
        lines.append(json.dumps({"seq": 1, "keyword": "k", "vulnerabilities": [{"cve": cve}]}))
    (path / name).write_text("\n".join(lines))


def test_stream_takes_only_new_files_and_matches_batch(spark, tmp_path):
    acs = spark.createDataFrame(
        [(f"{i:05d}", 100.0, float(i), float(i), 800000.0 if i % 2 else -666666666.0) for i in range(30)],
        "geo_id string, total_housing_units double, single_family_detached_units double, owner_occupied_units double, median_home_value double",
    )
    communities = readiness_alert(acs)
    pressure = spark.createDataFrame([("sma", 0.8), ("growatt", 0.5)], "vendor string, cyber_pressure_score double")
    pages, out, state = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        A.run_alert_stream(spark, str(pages), out, state, communities, pressure)
        return A.read_alerts(spark, out)

    landed(pages, "1.json", ("C1", "SMA flaw", 9.8), ("C2", "nobody", 9.9), ("C3", "growatt", 5.0))
    assert {r.cve_id for r in run().collect()} == {"C1"}
    landed(pages, "2.json", ("C1", "SMA flaw", 9.8), ("C4", "growatt and sma", 8.0))
    both = run()
    assert both.groupBy("cve_id").count().orderBy("cve_id").collect() == [("C1", 10), ("C4", 10)]

    batch = spark.createDataFrame(
        [("C1", "SMA flaw", 9.8), ("C2", "nobody", 9.9), ("C3", "growatt", 5.0), ("C4", "growatt and sma", 8.0)],
        "cve_id string, description string, cvss_v3_score double",
    )
    want = A.alerts(batch, communities, pressure)
    assert sorted(map(tuple, both.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    best = want.filter("cve_id = 'C4'").orderBy(F.desc("alert_score")).first()
    assert (best.geo_id, best.vendor_cyber_pressure, best.affected_vendors) == ("00029", 0.8, "growatt, sma")


def test_stream_takes_late_and_old_files(spark, tmp_path):
    communities = spark.createDataFrame([(f"{i:02d}", i / 20) for i in range(20)], "geo_id string, solar_readiness double")
    pressure = spark.createDataFrame([("sma", 0.8), ("growatt", 0.0)], "vendor string, cyber_pressure_score double")
    pages, out, state = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        A.run_alert_stream(spark, str(pages), out, state, communities, pressure, files_per_batch=1)
        rows = A.read_alerts(spark, out).collect()
        return sorted({r.cve_id for r in rows}), rows

    landed(pages, "now.json", ("C1", "SMA flaw", 9.8))
    assert run()[0] == ["C1"]
    for name, days in (("b.json", 10), ("a.json", 40), ("c.json", 400)):
        landed(pages, name, (f"D{days}", "SMA flaw", 9.0), ("C1", "SMA flaw", 9.8))
        past = time.time() - days * 86_400
        os.utime(pages / name, (past, past))
    assert run()[0] == ["C1", "D10", "D40", "D400"]
    landed(pages, "later.json", ("E1", "growatt", 9.0))
    ids, rows = run()
    assert ids == ["C1", "D10", "D40", "D400", "E1"] and len(rows) == 50
    assert len(run()[1]) == 50
    # With urgency 0 every community ties, and ids decide.
    assert sorted(r.geo_id for r in rows if r.cve_id == "E1") == [f"{i:02d}" for i in range(10)]
    assert sorted(r.geo_id for r in rows if r.cve_id == "C1") == [f"{i:02d}" for i in range(10, 20)]


def test_stream_keeps_first_sights_as_keyed_state(spark, tmp_path):
    """Batches read their own files alone, the state holds one mark a CVE, and the alerts are those of one batch job."""
    communities = spark.createDataFrame([(f"{i:02d}", i / 20) for i in range(20)], "geo_id string, solar_readiness double")
    pressure = spark.createDataFrame([("sma", 0.8)], "vendor string, cyber_pressure_score double")
    pages, out, state = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "state")
    marks, listed = [], {}
    for run in range(4):
        # One CVE of the run before comes again, and one is listed twice on a page.
        cves = [(f"C{run}", "SMA flaw", 9.0 + run / 10), (f"C{run - 1}", "SMA again", 9.9), (f"C{run}", "SMA twice", 9.8)]
        landed(pages, f"{run}.json", *cves)
        for cve_id, _, score in cves:
            listed.setdefault(cve_id, score)
        reports = [r for r in A.run_alert_stream(spark, str(pages), out, state, communities, pressure) if r["numInputRows"]]
        assert [r["numInputRows"] for r in reports] == [1]
        marks.append(reports[-1]["stateOperators"][0]["numRowsTotal"])
    assert marks == [2, 3, 4, 5]
    batch = spark.createDataFrame([(c, "SMA", s) for c, s in listed.items()], "cve_id string, description string, cvss_v3_score double")
    want = A.alerts(batch, communities, pressure)
    assert sorted(map(tuple, A.read_alerts(spark, out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # The same checkpoint once more: nothing new, nothing repeated.
    A.run_alert_stream(spark, str(pages), out, state, communities, pressure)
    assert A.read_alerts(spark, out).count() == want.count()


def test_csv_goes_by_name_and_keeps_line_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('b, a ,extra\n1,"two\nlines, ""q""",z\n2,,z\n')
    got = R.read_csv_strings(spark, str(path), ["a", "b", "gone"]).collect()
    assert [tuple(r) for r in got] == [('two\nlines, "q"', "1", None), (None, "2", None)]
    with pytest.raises(ValueError):
        R.read_csv_strings(spark, str(path), ["c"])
    df = spark.createDataFrame([("k", 'a\nb "c"\r\nd'), ("l", "e\n\nf")], "k string, description string")
    W.write_csv(df, str(tmp_path / "back"))
    back = R.read_csv_strings(spark, str(tmp_path / "back"), ["description", "k"])
    assert sorted((r.k, r.description) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_published_catalogue_columns(spark, tmp_path):
    path = tmp_path / "kev.csv"
    path.write_text(
        "cveID,vendorProject,product,vulnerabilityName,dateAdded,shortDescription,requiredAction,dueDate,"
        "knownRansomwareCampaignUse,notes\nC1,v,p,name,2024-01-01,text,act,2024-02-01,Known,n\n"
    )
    row = R.read_kev_csv(spark, str(path)).first()
    assert (row.shortDescription, row.requiredAction, row.dateAdded, row.dueDate) == ("text", "act", "2024-01-01", "2024-02-01")


def test_indented_documents(spark, tmp_path):
    folder = tmp_path / "pages"
    for word, ids in (("solar", ["A", "B"]), ("wind", ["A"])):
        (folder / f"keyword={word}").mkdir(parents=True)
        body = {"vulnerabilities": [{"cve": {"id": i}} for i in ids]}
        (folder / f"keyword={word}" / "page-1.json").write_text(json.dumps(body, indent=2))
    rows = R.read_cve_pages(spark, str(folder)).collect()
    assert sorted((r.keyword, r.cve.id) for r in rows) == [("solar", "A"), ("solar", "B"), ("wind", "A")]
    assert len({r.seq for r in rows}) == 3
    feed = {"vulnerabilities": [{"cveID": "C1", "product": "p"}, {"cveID": "C2"}]}
    (tmp_path / "kev.json").write_text(json.dumps(feed, indent=1))
    assert [(r.cveID, r.product) for r in R.read_kev_json(spark, str(tmp_path / "kev.json")).orderBy("seq").collect()] == [("C1", "p"), ("C2", None)]
    capacity = {"response": {"data": [{"location": "CA", "capacity": "3"}]}}
    (tmp_path / "cap.json").write_text(json.dumps(capacity, indent=1))
    assert R.read_capacity(spark, str(tmp_path / "cap.json")).collect() == [("CA", "3")]


@pytest.mark.parametrize("text", ['{"vulnerabilities": [', '{"other": 1}', "nothing"])
def test_unreadable_documents_fail(spark, tmp_path, text):
    (tmp_path / "kev.json").write_text(text)
    with pytest.raises(Exception):
        R.read_kev_json(spark, str(tmp_path / "kev.json")).collect()


def test_indented_device_lines_fail(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"ip": "a", "port": 1}, indent=1))
    with pytest.raises(Exception):
        R.read_devices_json(spark, str(tmp_path / "d.json")).collect()
    assert R.read_devices_json(spark, str(tmp_path / "d.json"), multi_line=True).count() == 1


def test_device_record_keeps_all_fields(spark, tmp_path):
    from gridrisk.operators.devices import flatten_device

    (tmp_path / "o.json").write_text(json.dumps({"seq": 1, "ip_str": "a", "port": 80, "location": {"latitude": 1.5, "longitude": 2.5}}))
    flat = flatten_device(R.read_observations_json(spark, str(tmp_path / "o.json")))
    W.write_json(flat, str(tmp_path / "flat"))
    back = R.read_devices_json(spark, str(tmp_path / "flat"))
    assert set(back.columns) == set(flat.columns)
    assert back.select(*flat.columns).collect() == flat.collect()


def test_top_zips_has_no_limit(spark):
    from gridrisk.operators.views import view_top_zips

    rows = spark.range(300).selectExpr("CAST(id AS STRING) AS geo_id", "CAST(id AS DOUBLE) AS community_risk_prior_score")
    assert view_top_zips(rows, 250).count() == 250


def test_large_page_files_are_read_by_lines(spark, tmp_path, monkeypatch):
    """Files of one document a line are split; others over many lines stay whole documents. The rows are the same."""
    folder = tmp_path / "pages"
    for word in ("solar", "wind", "tide", "gas"):
        (folder / f"keyword={word}").mkdir(parents=True)
    docs = [{"vulnerabilities": [{"cve": {"id": f"{i}-{k}"}} for k in range(3)]} for i in range(40)]
    (folder / "keyword=solar" / "1.json").write_text("\r\n".join(json.dumps(d) for d in docs) + "\r\n\r\n")
    (folder / "keyword=wind" / "1.json").write_text(json.dumps(docs[0], indent=1))
    (folder / "keyword=tide" / "1.json").write_text(json.dumps(docs[:5], indent=1))
    (folder / "keyword=gas" / "1.json").write_text("\n".join(json.dumps(docs[i : i + 2]) for i in (0, 2, 4)))

    def rows():
        return sorted((r.seq % R.PAGE_ROWS, r.seq, r.keyword, r.cve.id) for r in R.read_cve_pages(spark, str(folder)).collect())

    def in_order(found):
        return {w: [i for _, _, k, i in sorted(found, key=lambda r: r[1]) if k == w] for w in ("solar", "wind", "tide", "gas")}

    whole = rows()
    monkeypatch.setattr(R, "WHOLE_BYTES", 100)
    texts = R.landed_texts(spark.read.option("recursiveFileLookup", True), str(folder))
    assert texts.where("file_path LIKE '%solar%' AND trim(value) <> '\r'").count() >= 40
    lines = rows()
    want = {"solar": 40, "wind": 1, "tide": 5, "gas": 6}
    for found in (whole, lines):
        assert in_order(found) == {w: [f"{i}-{k}" for i in range(n) for k in range(3)] for w, n in want.items()}
        assert len({r[1] for r in found}) == len(found)
    (folder / "keyword=gas" / "2.json").write_text(json.dumps(docs[0]) + "\n" + "x" * 200)
    with pytest.raises(Exception):
        rows()


def test_published_pages_are_bounded(spark, monkeypatch):
    from gridrisk.catalog import files

    monkeypatch.setattr(files, "PAGE_RECORDS", 7)
    hits = spark.range(0, 100, 1, 3).selectExpr(
        "IF(id < 60, 'a', 'b') AS keyword", "array(named_struct('cve', named_struct('id', CAST(id AS STRING)))) AS vulnerabilities"
    )
    pages = files.published_pages(hits).collect()
    found = [(p.keyword, v["cve"]["id"]) for p in pages for v in json.loads(p.value)["vulnerabilities"]]
    assert sorted(found) == sorted(("a" if i < 60 else "b", str(i)) for i in range(100))
    assert max(len(json.loads(p.value)["vulnerabilities"]) for p in pages) == 7


def test_stream_reads_large_files_by_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "WHOLE_BYTES", 100)
    communities = spark.createDataFrame([(f"{i:02d}", i / 20) for i in range(20)], "geo_id string, solar_readiness double")
    pressure = spark.createDataFrame([("sma", 0.8)], "vendor string, cyber_pressure_score double")
    pages, out = tmp_path / "pages", str(tmp_path / "out")
    landed(pages, "1.json", *[(f"C{i}", "SMA flaw", 9.0) for i in range(20)], ("C0", "SMA again", 9.9))
    cve = {"id": "D", "descriptions": [{"lang": "en", "value": "SMA"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.5}}]}}
    (pages / "2.json").write_text(json.dumps({"vulnerabilities": [{"cve": cve}, {"cve": {**cve, "id": "C1"}}]}, indent=1))
    taken = []
    real = A.parse_cve_pages
    monkeypatch.setattr(A, "parse_cve_pages", lambda texts: taken.append(texts.count()) or real(texts))
    A.run_alert_stream(spark, str(pages), out, str(tmp_path / "state"), communities, pressure)
    assert sum(taken) > 21
    rows = A.read_alerts(spark, out).groupBy("cve_id").agg(F.count("*").alias("n"), F.max("alert_score").alias("s")).collect()
    assert {r.cve_id: r.n for r in rows} == {**{f"C{i}": 10 for i in range(20)}, "D": 10}
    assert len({r.s for r in rows if r.cve_id != "D"}) == 1
