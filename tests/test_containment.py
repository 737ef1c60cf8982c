"""Joins of texts with rules from tables, against plain Python."""

import random

from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions import matching as M
from gridrisk.operators import containment as K
from gridrisk.operators import devices as D


def test_contained_equals_brute_force(spark):
    pick = random.Random(4)
    word = lambda n: "".join(pick.choice("abé😀 ") for _ in range(n))
    texts = [(pick.choice("xy"), word(pick.randrange(12))) for _ in range(60)] + [("x", None), (None, "ab"), ("x", word(700))] * 2
    patterns = [(pick.choice("xyz"), word(pick.randrange(1, 5))) for _ in range(80)] + [("y", ""), ("x", None), (None, "a")] * 2
    got = K.contained(
        spark.createDataFrame([(*t, 1) for t in texts], "scope string, text string, pattern int"),
        spark.createDataFrame([(*p, 1) for p in patterns], "scope string, pattern string, text int"),
    )
    rows = [tuple(r) for r in got.collect()]
    want = {(s, t, p) for s, t in texts for z, p in patterns if s == z and None not in (s, t, p) and p in t}
    assert len(rows) == len(set(rows)) and set(rows) == want


DEVICES = "ingest_seq bigint, vendor string, firmware_version string"


def made_devices():
    pick = random.Random(9)
    names = [w for w, _ in C.VENDOR_KEYWORDS] + ["Unknown", "", None, "SUNGROW and growatt", "sma solarview"]
    versions = [v for _, v, _ in C.VENDOR_FIRMWARE] + ["", None, "1", "9.9", "v"]
    return [(i, pick.choice(names), pick.choice(versions)) for i in range(400)]


def test_present_rules_give_the_same_by_table(spark):
    devices = spark.createDataFrame(made_devices(), DEVICES)
    got = K.vendor_risks(devices, K.dictionary_tables(spark))
    key = M.vendor_key(F.col("vendor"))
    want = devices.select(
        *devices.columns,
        key.alias("vendor_key"),
        M.firmware_risk(key, F.col("firmware_version")).alias("firmware_risk"),
        D.cve_component(F.col("vendor"), F.col("firmware_version")).alias("cve_component"),
        D.matched_cves(F.col("vendor")).alias("matched_cves"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_device_scores_by_table_are_those_by_expression(spark):
    devices = spark.createDataFrame(made_devices(), DEVICES).select(
        "*", (F.col("ingest_seq") % 2 == 0).alias("has_tls"), (F.col("ingest_seq") % 3 == 0).alias("has_modbus"),
        F.lit(None).cast("boolean").alias("has_mqtt"), (F.col("ingest_seq") % 5 == 0).alias("default_creds_indicator"),
        F.lit("DE").alias("country"),
    )
    by_table = D.score_devices(devices, K.dictionary_tables(spark))
    want = D.score_devices(devices)
    assert set(by_table.columns) == set(want.columns)
    assert sorted(map(str, by_table.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_banner_rules_by_table(spark):
    pick = random.Random(2)
    words = sorted({w for _, _, a, b, _ in C.BANNER_RULES for w in [*a, *b]})
    rows = []
    for i in range(200):
        text = " ".join(pick.choice(words) for _ in range(pick.randrange(5))).upper()
        title = None if i % 9 == 0 else " ".join(pick.choice(words) for _ in range(pick.randrange(3)))
        rows.append((i, text, title, pick.choice([[80], [502, 80], [], None, [pick.choice([1883, 8080])]])))
    seen = spark.createDataFrame(rows, "seq bigint, body string, title string, ports array<int>")
    got = K.matched_rules(seen, "seq", K.banner_rule_table(spark), F.col("body"), F.col("title"), F.col("ports"))
    known = F.coalesce("ports", F.array().cast("array<int>"))
    want = D.rule_match_banners(seen, F.col("body"), F.col("title"), known).select("seq", "rule_vendor", "rule")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rules_of_ports_alone_and_of_nothing(spark):
    rules = [(0, "V", "ports", [], [], [502]), (1, "V", "all", [], [], []), (2, "W", "both", ["sun"], ["home"], [80, 443])]
    table = spark.createDataFrame(rules, "position int, vendor string, rule string, words array<string>, titles array<string>, ports array<int>")
    rows = [(1, "Sun", "Home", [80]), (2, "sun", "home", [502]), (3, None, None, None), (4, "sun", None, [443])]
    seen = spark.createDataFrame(rows, "seq bigint, body string, title string, ports array<int>")
    got = {(r.seq, r.rule) for r in K.matched_rules(seen, "seq", table, F.col("body"), F.col("title"), F.col("ports")).collect()}
    assert got == {(1, "all"), (2, "all"), (3, "all"), (4, "all"), (2, "ports"), (1, "both")}


def test_a_hundred_thousand_rules_without_a_nested_loop(spark):
    number = F.col("id").cast("string")
    keywords = spark.range(100_000).select(
        F.col("id").cast("int").alias("position"), F.concat(F.lit("maker"), number, F.lit(";")).alias("keyword"), F.concat(F.lit("V"), number).alias("vendor_key")
    )
    devices = spark.range(0, 200_000, 997).select("id", F.concat(F.lit("Unit by MAKER"), number, F.lit("; x")).alias("vendor"))
    got = K.vendor_keys(devices, keywords)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.id, r.vendor_key) for r in got.collect()} == {(i, f"V{i}" if i < 100_000 else None) for i in range(0, 200_000, 997)}


def test_few_patterns_are_sent_to_the_texts(spark, monkeypatch):
    """Both ways give the same; a few patterns cut no grams."""
    texts = spark.createDataFrame([("x", f"abc {i} déf"[: i % 11]) for i in range(50)] + [("y", "abc")], "scope string, text string")
    patterns = spark.createDataFrame([("x", "bc"), ("x", "dé"), ("x", ""), ("y", "c"), ("z", "a")], "scope string, pattern string")
    few = K.contained(texts, patterns)
    assert "Generate" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(K, "FEW", 0)
    many = K.contained(texts, patterns)
    assert "Generate" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_long_patterns_equal_brute_force(spark):
    pick = random.Random(7)
    word = lambda n: "".join(pick.choice("abé") for _ in range(n))
    texts = [("x", word(pick.randrange(900))) for _ in range(40)]
    inside = [t[i : i + pick.randrange(1, 90)] for _, t in texts for i in (0, 200, 250, len(t) // 2)]
    patterns = [("x", p) for p in [*inside, *[word(pick.randrange(80)) for _ in range(60)]]]
    got = K.contained(spark.createDataFrame(texts, "scope string, text string"), spark.createDataFrame(patterns, "scope string, pattern string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(s, t, p) for s, t in texts for _, p in patterns if p in t}


def test_numbered_names_meet_their_own_texts_alone(spark):
    """Names with short parts in common: candidates grow with the texts, not with texts times names."""
    name = F.format_string("supplier#%09d", "id")
    texts = spark.range(2_000).select(F.lit(0).alias("scope"), F.concat(F.lit("unit of "), name, F.lit(" (1)")).alias("text"), F.col("id").alias("digest"))
    rules = spark.range(2_000).select(F.lit(0).alias("scope"), name.alias("pattern"))
    assert K._candidates(texts, rules, [16], False).count() == 2_000
    assert K.contained(texts, rules).count() == 2_000


def test_a_large_dictionary_is_not_broadcast(spark, tmp_path, monkeypatch):
    """Files far smaller than their rows: no plan sends the dictionary to the driver."""
    monkeypatch.setattr(K, "SMALL", 50, raising=False)
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    write = getattr(K, "write_table", None)
    monkeypatch.setattr(K, "write_table", lambda df, path: write(planned(df), path), raising=False)
    number = F.col("id").cast("string")
    vendor = F.concat(F.lit("Maker"), F.format_string("%05d", "id"))
    place = F.lit(0).alias("position")
    rules = {
        "vendors": [vendor.alias("vendor_key"), F.lit("HIGH").alias("risk_level")],
        "cves": [vendor.alias("vendor_key"), place, F.concat(F.lit("CVE-"), number).alias("cve_id"), F.lit("9.8").alias("cvss")],
        "firmware": [vendor.alias("vendor_key"), place, F.concat(F.lit("fw "), number).alias("firmware"), F.lit("PATCHED").alias("status")],
        "keywords": [place, F.lower(vendor).alias("keyword"), vendor.alias("vendor_key")],
    }
    for name, columns in rules.items():
        spark.range(3_000).select(*columns).write.parquet(f"{tmp_path}/{name}")
    units = spark.range(6_000).select(
        "id", F.concat(F.lit("A "), F.format_string("MAKER%05d", F.col("id") % 4_000)).alias("vendor"), F.concat(F.lit("FW "), (F.col("id") % 200).cast("string")).alias("firmware_version")
    )
    units.write.parquet(f"{tmp_path}/units")
    devices = spark.read.parquet(f"{tmp_path}/units")
    got = planned(K.vendor_risks(devices, {name: spark.read.parquet(f"{tmp_path}/{name}") for name in rules}))
    assert not any("Broadcast" in plan for plan in plans)

    def want(i):
        n = i % 4_000
        own, listed = f"fw {i % 200}", f"fw {n}"
        if n >= 3_000:
            return (i, None, None, 0.3, [])
        fits = own in listed or listed in own
        return (i, f"Maker{n:05d}", 0.2 if fits else None, 0.2 if fits else 1.0, [f"CVE-{n}"])

    rows = got.select("id", "vendor_key", "firmware_risk", "cve_component", "matched_cves").collect()
    assert sorted(map(tuple, rows)) == [want(i) for i in range(6_000)]
