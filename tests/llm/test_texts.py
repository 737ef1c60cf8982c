"""Decontamination, mixing, line dedup, licenses: brute force, odd rows, empty tables."""

import glob
import hashlib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridrisk.llm import mixing
from gridrisk.llm.decontaminate import decontaminate
from gridrisk.llm.licenses import scan_licenses
from gridrisk.llm.lines import dedup_lines
from gridrisk.llm.mixing import first_words, mix, source_targets, split_quotas
from gridrisk.llm.queries import QUERIES
from gridrisk.session import scratch_path
from tests.llm.conftest import BASE, LONG, ROWS, WORDS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(text, items):
    own, mask, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(13, len(w))
        for b in range(len(w) - n + 1 if w else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[b : b + n]:
                    mask.update(range(at, at + n))
                    if name is not None:
                        found.add(str(name))
    return len(own), len(mask), sorted(found)


ITEMS = [
    (10, " ".join(WORDS[20:40])),
    (9, " ".join(WORDS[20:33]).upper()),
    (3, "TWO, words"),
    (4, None),
    (5, ""),
    (None, " ".join(WORDS[100:113])),
    (10, "w1 w2 w3 w4"),
]


@pytest.mark.parametrize("block_bytes", [10_000_000, 60])
def test_decontaminate_against_brute_force(spark, odd_docs, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate(odd_docs, bench, block_bytes=block_bytes)
    assert got.columns == [*odd_docs.columns, "hits"]
    seen = sorted((str(r["doc_id"]), r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) for r in got.collect())
    want = sorted((str(r[0]), *hits(r[1], [i for i in ITEMS])) for r in ROWS if r[1] != LONG)
    assert [s for s in seen if s[0] != "8"] == want
    assert [s[1:] for s in seen if s[0] == "8"] == [(60_000, 0, [])]


def test_decontaminate_removes(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = {r["doc_id"] for r in decontaminate(odd_docs, bench, remove="documents").collect()}
    assert kept == {5, 6, 7, 8, 11, 12}
    cut = {r["doc_id"]: r["text"] for r in decontaminate(odd_docs, bench, remove="spans").collect()}
    assert cut[9] == "" and cut[5] is None and cut[8] == LONG
    assert cut[1] == " ".join([*WORDS[:1], "", *WORDS[5:20], "", *WORDS[40:60]])
    assert decontaminate(no_docs, bench).count() == 0
    nothing = decontaminate(odd_docs, bench.limit(0)).select("hits.*").collect()
    assert len(nothing) == len(ROWS) and not any(r["contaminated"] or r["n_hit"] for r in nothing)


def test_share_rule(spark):
    bench = spark.createDataFrame([(1, "hit")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "hit " + "x " * 19), (2, "hit " + "x " * 20), (3, "x")], "doc_id bigint, text string"
    )
    got = {r["doc_id"]: r["hits"]["contaminated"] for r in decontaminate(docs, bench).collect()}
    assert got == {1: True, 2: False, 3: False}


def poured(sizes, weights=(5, 2, 1)):
    """Targets by pouring again and again, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(full.values())
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10, "b": 1000, "c": 7, None: 50}, {"a": 1, "b": 0, "c": 1, "d": 5000, "e": 3}, {"x": 5}, {"x": 0, None: 0}],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(poured(sizes))


def test_tree_deals_exact_quotas(spark):
    quotas = {"a": 500, "b": 21, None: 7, "z": 0}
    df = spark.createDataFrame(list(quotas.items()), "source string, blocks bigint")
    rows = split_quotas(df, 13, 3).collect()
    assert rows == split_quotas(df, 13, 3).collect() or sorted(map(str, rows)) == sorted(
        map(str, split_quotas(df, 13, 3).collect())
    )
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r["source"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert {s: by_source[s] for s in quotas} == quotas
    assert len(by_shard) == 13 and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_tree_draws_are_hypergeometric(spark):
    from gridrisk.llm.mixing import _draw

    uniform = "(pmod(xxhash64(7L, id), 9007199254740992L) / 9007199254740992D)"
    for rest, own, want in ((100, 30, 40), (12, 1, 6), (10, 9, 9)):
        x = F.expr(_draw(f"{rest}L", f"{own}L", f"{want}L", uniform))
        mean, var, low, high = spark.range(4000).select(x.alias("x")).agg(
            F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")
        ).first()
        share = own / rest
        assert abs(mean - want * share) < 0.15
        assert abs(var - want * share * (1 - share) * (rest - want) / (rest - 1)) < 0.3
        assert low >= max(0, want + own - rest) and high <= min(want, own)


def test_mix_meets_targets(spark, odd_docs, no_docs):
    draws = mix(odd_docs, shard_words=9_000, block_words=500)
    assert draws.select("row.*").columns == odd_docs.columns
    rows = draws.collect()
    taken, target, size, doc = Counter(), {}, defaultdict(int), {}
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in rows:
        taken[r["source"]] += r["words"]
        target[r["source"]] = r["target"]
        size[r["source"]] = r["source_size"]
        key = (r["source"], r["bucket"], r["n"])
        doc.setdefault(key, [r["size"], 0])[1] += r["words"]
        assert (r["words"] > 0) == (r["shard"] is not None) == (r["copy"] is not None)
    assert len(doc) == len(ROWS)
    assert dict(size) == dict(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert all(own <= 3 * n for n, own in doc.values())
    assert target == pytest.approx(poured(dict(sizes)))
    again = mix(odd_docs.repartition(5), shard_words=9_000, block_words=500)
    columns = ["row.doc_id", "row.text", "copy", "words", "shard", "place"]
    assert sorted(map(str, again.select(*columns).collect())) == sorted(map(str, draws.select(*columns).collect()))
    assert mix(no_docs).count() == 0


def test_dealt_blocks_decide_the_draws(spark, odd_docs, monkeypatch):
    whole = Counter()
    for r in mix(odd_docs, shard_words=9_000, block_words=500).collect():
        whole[r["source"]] += r["words"]

    def fewer(quotas, shards, seed):
        return split_quotas(quotas, shards, seed).where("NOT (source <=> 'a')").withColumn(
            "blocks", F.when(F.col("source") == "b", F.least("blocks", F.lit(2))).otherwise(F.col("blocks"))
        )

    runs = {(r["source"], r["shard"]): r["blocks"] for r in fewer(mixing_quotas(odd_docs, 500), 7, 17).collect()}
    monkeypatch.setattr(mixing, "split_quotas", fewer)
    rows = mix(odd_docs, shard_words=9_000, block_words=500).collect()
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["words"]
    assert whole["a"] > 0 and taken["a"] == 0
    assert taken["b"] == 500 * sum(n for (s, _), n in runs.items() if s == "b") < whole["b"]
    assert len({(r["source"], r["bucket"], r["n"]) for r in rows}) == len(ROWS)


def mixing_quotas(docs, block_words):
    sizes = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    return source_targets(sizes).select("source", F.ceil(F.round("target") / block_words).cast("bigint").alias("blocks"))


def test_mix_is_written_by_shard(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 3}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int").repartition(3)
    draws, shards = mixing.dealt_mix(docs, shard_words=700, block_words=50)
    draws = draws.where("copy IS NOT NULL")
    order = sorted((r["shard"], r["place"]) for r in draws.collect())
    assert shards == 5 and {s for s, _ in order} == set(range(shards))
    path = scratch_path(spark, "by-shard")
    mixing.in_shards(draws, shards).write.parquet(path)
    files = [pq.read_table(f).select(["shard", "place"]).to_pylist() for f in sorted(glob.glob(f"{path}/part-*"))]
    assert [(r["shard"], r["place"]) for f in files for r in f] == order
    assert all(len({r["shard"] for r in f}) <= 1 for f in files) and len(files) > 2 * shards
    want = [r["row"]["doc_id"] for r in mix(docs).where("copy IS NOT NULL").orderBy("shard", "place").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, "").collect()] == want


def test_mix_query_tells_shards(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op2_mix_sources"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = defaultdict(list)
    for r in mix(docs).where("copy IS NOT NULL").collect():
        want[r["row"]["doc_id"]].append((r["copy"], r["shard"], r["place"]))
    assert len(got) == docs.count()
    for i, r in got.items():
        assert list(zip(r["shard"], r["place"], strict=True)) == [(s, p) for _, s, p in sorted(want[i])]
        assert (r["taken"] > 0) == (len(r["shard"]) > 0)


def test_first_words(spark):
    rows = [("a b  c\nd ", 3), (" a b", 1), ("a", 1), (" x  y z", 2), (LONG, 59_000)]
    df = spark.createDataFrame(rows, "t string, w bigint")
    for (text, n), row in zip(rows, df.select(first_words(F.col("t"), F.col("w")).alias("x")).collect(), strict=True):
        assert row["x"].split() == text.split()[:n] and text.startswith(row["x"])


@pytest.mark.parametrize("min_sites", [2, 3, 12])
def test_lines_against_brute_force(spark, no_docs, min_sites):
    rows = [(i, f"own {i}\n  boiler plate\t\nfew {i % 2}\n\nend", f"s{i % 7}" if i % 5 else None) for i in range(40)]
    rows += [(100, None, "s1"), (101, "", "s1"), (3, rows[3][1], "s3"), (None, "boiler plate", None)]
    rows += [(200 + i, "wide", f"t{i}") for i in range(30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, n_lines string")
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if source is not None:
                sites[line.strip(" \t\r\v\f")].add(source)
    want = []
    for doc_id, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if not x.strip() or len(sites[x.strip()]) < min_sites]
        want.append((str(doc_id), len(lines), len(lines) - len(left), None if text is None else "\n".join(left)))
    got = dedup_lines(docs, min_sites=min_sites)
    assert got.columns == [*docs.columns, "cut"]
    assert sorted((str(r["doc_id"]), *r["cut"]) for r in got.collect() if r["doc_id"] != 100) == sorted(
        w for w in want if w[0] != "100"
    )
    assert [tuple(r["cut"]) for r in got.where("doc_id = 100").collect()] == [(0, 0, None)]
    assert dedup_lines(no_docs).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    known = spark.createDataFrame(
        [
            ("B", "Licence granted, to all."),
            ("A", "license granted to ALL"),
            ("N", "A one-line notice"),
            ("E", "!!"),
            ("Z", None),
            (None, "two words"),
            ("L", "first line\nsecond: line"),
        ],
        "license_id string, text string",
    )
    texts = [
        (1, "Copyright (c) 2020 Somebody\n\nLicense -- granted\nto all"),
        (2, "prose\na ONE line notice!\nprose\nlicence granted to all"),
        (2, "prose\na ONE line notice!\nprose\nlicence granted to all"),
        (3, None),
        (4, ""),
        (5, "First line,\nsecond line."),
        (None, "a one line notice"),
        (6, "unlicence granted to all"),
    ]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id bigint, text string, license_id string")
    got = [(str(r["doc_id"]), r["license_id"], r["notices"]) for r in scan_licenses(docs, known).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("1", "A", ""),
            ("2", None, "A,N"),
            ("2", None, "A,N"),
            ("3", None, ""),
            ("4", None, ""),
            ("5", "L", ""),
            ("None", "N", "N"),
            ("6", None, ""),
        ],
        key=str,
    )
    digest = {r["doc_id"]: r["digest"] for r in scan_licenses(docs, known).collect()}
    assert digest[5] == hashlib.sha256(b"first line second line").hexdigest()
    assert scan_licenses(no_docs, known).count() == 0
    assert scan_licenses(odd_docs, known.limit(0)).where("license_id IS NOT NULL OR notices <> ''").count() == 0


def test_base_text_is_what_the_cases_expect():
    assert len(BASE.split()) == 60


def test_whole_licenses_at_every_wrap_width(spark):
    """A titled file with its holder, wrapped at any width, is the license; no line that happens to begin a sentence is lost."""
    import textwrap

    from gridrisk.llm.queries import LICENSE_TEXTS, LICENSE_TITLES, LICENSES

    rows = []
    for name, text in LICENSE_TEXTS.items():
        if name.endswith("notice"):
            continue
        title = LICENSE_TITLES.get(name, ("",))[0]
        for width in range(60, 101, 1 if name in ("MIT", "BSD-3-Clause") else 7):
            body = "\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n"))
            rows.append((name, f"{title}\n\nCopyright (c) 2021 Some One\nCopyright 2022, Others. All rights reserved.\n\n{body}\n"))
    rows.append((None, "MIT License\n\ncopyright notice of our own\n\n" + LICENSE_TEXTS["MIT"]))
    known = spark.createDataFrame(LICENSES, "license_id string, text string")
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r.license_id for r in scan_licenses(docs, known).collect()}
    assert [found[i] for i in range(len(rows))] == [name for name, _ in rows]
