"""URLs, vectors, language model, language ID, token files and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridrisk.llm import lm
from gridrisk.llm.langid import identify_language
from gridrisk.llm.lm import lm_scores
from gridrisk.llm.neighbours import chi_square_limit, nearest
from gridrisk.llm.queries import URL_RULES
from gridrisk.llm.tokens import LENGTHS, TextEncoder, decode_ids, decode_tokens, encode_ids, encode_tokens
from gridrisk.llm.urls import judge_urls
from gridrisk.session import scratch_path
from tests.llm.conftest import ROWS

DIR = "/root/testdata/sf0.001"


# --- URLs ----------------------------------------------------------------------------------
def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [
        (len(h) + len(p), len(h), v == "block", h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


URLS = [
    "http://WWW.Example.com/en/x?a=/b#c", "https://example.com/en/", "https://example.com/en", "http://a.b.example.com/en/y",
    "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://net", "ftp://com/", "com/en", "", None,
    "http://://x", "http://example.net?q=/es/", "http://é.com/é/", "HTTP://x.com", "http://.com/", "http://x.com./en/",
    "http://a.example.com/enter", "http://a.example.com/en/sub/deep/page",
]
MORE = [*URL_RULES, ("example.com", "/en", "allow"), ("a.example.com", "/en/sub/de", "block"), ("example.com", "/en/", "allow")]


@pytest.mark.parametrize(("rules", "block"), [(URL_RULES, 1000), (MORE, 1000), (MORE, 2)])
def test_urls_against_brute_force(spark, rules, block):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id bigint, url string, host string")
    table = spark.createDataFrame([*rules, ("x", "/", None)], "host string, path string, verdict string")
    got = judge_urls(pages, table, block_rules=block)
    assert got.columns == [*pages.columns, "judged"]
    assert [tuple(r["judged"]) for r in got.orderBy("page_id").collect()] == [judged(u, rules) for u in [*URLS, URLS[0]]]
    assert judge_urls(pages.limit(0), table).count() == 0
    assert judge_urls(pages, table.limit(0)).where("judged.verdict <> 'allow' OR judged.rule IS NOT NULL").count() == 0


# --- vectors -------------------------------------------------------------------------------
def test_neighbours_against_brute_force(spark, monkeypatch):
    from gridrisk.llm import neighbours

    monkeypatch.setattr(neighbours, "SHARD", 300)
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    x = x.astype(np.float32)
    x[400:700] = x[400]
    x[900:920] = x[900] * 2
    rows = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)]
    odd = [
        (5000, None, "x"), (5001, [], "x"), (5002, [0.0] * 16, "x"), (5003, [None] + [1.0] * 15, "x"),
        (5050, [float("nan")] * 16, "x"), (5100, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"),
        (5150, [1.0, 2.0], "x"), (5151, [2.0, 1.0], "x"), rows[50], rows[51],
    ]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, rank string").repartition(4)
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    norm = np.sqrt((d * d).sum(axis=1))
    hit = 0
    for q in range(0, 1500, 50):
        score = (d * d[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in own]
        assert all(s == score[v] for _, v, s in own)
        hit += len({v for _, v, _ in own} & set(best.tolist()))
    assert hit >= 0.97 * 150
    assert [v for _, v, _ in sorted(got[450])] == [400, 401, 402, 403, 404]
    assert [(r, v) for r, v, _ in got[5150]] == [(1, 5151)] and set(got) == {*range(0, 1500, 50), 5150}
    assert nearest(df.limit(0)).count() == 0


def test_an_id_with_several_vectors_finds_others(spark):
    """Its own vectors are nearest to each other, but leave before the lists are cut."""
    near = [(50, [1.0, 0.001 * i]) for i in range(9)] + [(i, [1.0, float(i)]) for i in range(1, 10)]
    shared = [(7, [1.0, 0.002]), (100, [1.0, 3.0])]
    df = spark.createDataFrame(near + shared, "vec_id bigint, embedding array<double>")
    rows = nearest(df).collect()
    own = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 50)
    # Nine queries by that id; the copy of one of its vectors under id 7 is first for each.
    assert [r for r, _ in own] == sorted([1, 2, 3, 4, 5] * 9) and {v for r, v in own if r == 1} == {7}
    assert 50 not in {v for _, v in own}
    single = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 100)
    assert [v for _, v in single][0] == 3 and len(single) == 5


def test_chi_square_limit():
    draws = (np.random.default_rng(0).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws > chi_square_limit(0.05)).mean() - 0.05) < 0.004


# --- language model ------------------------------------------------------------------------
class Walker:
    """The automaton arc by arc: histories of up to two words, failure arcs, one word at a time."""

    def __init__(self, texts, least):
        self.counts, self.documents, self.least = Counter(), len(texts), least
        for own in texts:
            padded = ["<", *own]
            for n in (1, 2, 3):
                self.counts.update(tuple(padded[i : i + n]) for i in range(len(padded) - n + 1))
        self.tokens = sum(map(len, texts))
        self.types = len({w for own in texts for w in own})
        self.counts["<",] = self.documents

    def root(self, w):
        return math.log10((self.counts[w,] + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def step(self, state, w):
        """Weight of the way out of a state by a word, through failure arcs where it has no arc."""
        if not state:
            return self.root(w)
        seen, held, s = self.counts[(*state, w)], self.counts[state], lm.STRENGTHS[len(state) - 1]
        if len(state) == 2 and held < self.least:
            return self.step(state[1:], w)
        below = self.step(state[1:], w)
        if not seen:
            return (math.log10(s / (held + s)) if held else 0.0) + below
        return math.log10((seen + s * 10**below) / (held + s))

    def score(self, own):
        state, out = ("<",), 0.0
        for w in own:
            out += self.step(state, w)
            state = (*state, w)[-2:]
            while state and (not self.counts[state] or len(state) == 2 and self.counts[state] < self.least):
                state = state[1:]
        return out


@pytest.mark.parametrize(("chunk_bytes", "range_bytes", "least"), [(10_000_000, 10_000_000, 20), (40_000, 7_000, 2)])
def test_lm_against_brute_force(spark, odd_docs, no_docs, chunk_bytes, range_bytes, least):
    odd_docs = odd_docs.unionByName(odd_docs.where("doc_id < 8").withColumn("doc_id", F.col("doc_id") + 100))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    train = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    assert False in train
    walker = Walker([own for own, seen in zip(tokens, train, strict=True) if seen], least)
    want = [
        (str(doc_id), not seen, len(own), sum(walker.counts[w,] > 0 for w in own), walker.tokens, sum(map(walker.root, own)), walker.score(own))
        for (doc_id, _), own, seen in zip(rows, tokens, train, strict=True)
    ]
    got = [tuple(r) for r in lm_scores(odd_docs, chunk_bytes, range_bytes, least).collect()]
    got, want = sorted((str(g[0]), *g[1:]) for g in got), sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lm_scores(no_docs).count() == 0


def test_lm_takes_long_words_and_no_training(spark):
    rows = [(9, "w" * 3_000_000 + " a a a a"), (9, None)]
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm_scores(spark.createDataFrame([(held, t) for _, t in rows], "doc_id bigint, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in got) == [(1, 0, 0, True), (6, 0, 0, True)]
    assert all(r.score == pytest.approx(r.base_score) for r in got)


def test_automaton_weights_sum_to_one():
    texts = [["a", "b", "a", "b", None], ["b", "a", "b", "c", None], ["a", "b", "b", None]]
    walker = Walker(texts, 2)
    words = ["a", "b", "c", None, "never seen"]
    for state in [(), ("<",), ("a",), ("a", "b"), ("b", "a"), ("<", "a"), ("c",)]:
        assert sum(10 ** walker.step(state, w) for w in words) == pytest.approx(1.0)


# --- language ID ---------------------------------------------------------------------------
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    rows = identify_language(held, learn_from=docs).select("lang", "language.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 40
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Labels of the documents to predict have no say.
    other = held.withColumn("lang", F.lit("zz"))
    again = identify_language(other, learn_from=docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    assert sorted(map(tuple, again.select("language.*").collect())) == sorted((r["lang_pred"], r["score"]) for r in rows)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    learn = spark.read.parquet(f"{DIR}/documents.parquet")
    got = identify_language(odd_docs.withColumn("language", F.lit(1)), learn_from=learn)
    assert got.columns == [*odd_docs.columns, "language"]
    found = {r["doc_id"]: r["language"] for r in got.collect()}
    assert {i for i, g in found.items() if g["lang_pred"] == "und"} == {5, 6, 7, 11}
    assert all(found[i]["score"] == 0 for i in (5, 6, 7, 11)) and len(found) == 13
    assert identify_language(no_docs, learn_from=learn).count() == 0
    blank = identify_language(odd_docs, learn_from=no_docs).select("language.*").distinct().collect()
    assert [tuple(r) for r in blank] == [("und", 0.0)]


def test_language_is_judged_once_where_a_filter_reads_it(spark):
    """A second judgement of each text would also take a second Python worker a task."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    right = identify_language(docs).where("lang = language.lang_pred").agg(F.max("language.score"), F.count("*"))
    assert str(right._jdf.queryExecution().executedPlan()).count("ArrowEvalPython [") == 1
    score, n = right.first()
    assert 0 < score <= 1 and n > 0


def test_many_languages_stay_within_the_sample(spark, monkeypatch):
    from gridrisk.llm import langid

    monkeypatch.setattr(langid, "LANGUAGES", 5)
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 12)
    rows = [(3 * i, "some words", f"l{i % 3}") for i in range(60)] + [(1000 + 3 * i, "other words", f"rare{i:02d}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.train_network(docs)
    assert set(net.languages) <= {"l0", "l1", "l2", "rare00", "rare01", "rare02"} and {"l0", "l1", "l2"} <= set(net.languages)
    assert len(net.languages) <= 5


# --- token files ---------------------------------------------------------------------------
def test_codec_round_trip():
    rng = np.random.default_rng(1)
    assert LENGTHS[0b11100100].tolist() == [1, 2, 3, 4]
    for ids in (
        np.array([], dtype=np.uint32),
        np.array([7], dtype=np.uint32),
        rng.zipf(1.3, 5000).clip(max=4_000_000_000).astype(np.uint32),
        rng.permutation(np.repeat(np.arange(70_000, dtype=np.uint32), 2)),
    ):
        ranked, control, data = encode_ids(ids)
        assert np.array_equal(decode_ids(len(ids), ranked, control, data), ids)
        assert len(control) == -(-len(ids) // 4)


WORD_CASES = [
    "It's the user's, don't! we'll; I'd... a.b,c", "a\x01b \x01 c\x1cd e\x1c, f", "É È, ÀÉ. İstanbul ΣΑΣ. ñ́ é, é́.",
    "<|endoftext|> x<|startoftext|>, <|endoftext|>.", "x y z\u0085w,\tq\r\nr", "１２３ ½ 12.5, 3.", ",. ., .", "",
    "日本語、テスト. 한국어,", "ａｂｃ, Ⅷ. ʰ, ə.", "A. B, C", "...,,, x...", "́, ́.",
]


@pytest.mark.parametrize("remembered", [1, 100_000])
def test_word_cache_equals_the_library(remembered):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, library = TextEncoder(path, remembered), Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "abcXYZ.,'!12 \n\té́\x01<|>"
    texts = WORD_CASES + ["".join(rng.choice(letters) for _ in range(60)) for _ in range(400)]
    for at in range(0, len(texts), 50):
        own = texts[at : at + 50]
        for text, ids in zip(own, tool.encode(own), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_marks_behind_letters_of_every_class():
    """Random texts of letters, marks and numbers of many scripts, each with stops and commas behind it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, library = TextEncoder(path), Tokenizer.from_file(path)
    assert tool.words_apart and not TextEncoder(public_tokenizers.path("byte_bpe_50k.json")).words_apart
    rng = random.Random(11)
    special = "İIıǅǆßẞſªºµΣσςŉǰΐﬁÅÅ\u0301\u0307\u0345\u200d\ufeff½٣'\u2019´"
    plain = [c for c in map(chr, [*range(0x21, 0x400), *range(0x1E00, 0x2000), *range(0x2100, 0x2190)]) if c.isprintable()]
    texts = []
    for _ in range(6000):
        word = lambda: "".join(rng.choice(special if rng.random() < 0.3 else plain) for _ in range(rng.randrange(1, 5)))
        texts.append(" ".join(word() + rng.choice(["", ".", ",", "..", ".,", "!"]) for _ in range(8)))
    texts += [f"{c}. {c}, x{c}. {c}x. MECL{c}S{c}." for c in {*special, *plain}]
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        for text, ids in zip(own, tool.encode(own), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("block_ids", [1_000_000, 50])
def test_token_files(spark, odd_docs, no_docs, block_ids):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = scratch_path(spark, "tokens")
    encode_tokens(odd_docs, path, block_ids=block_ids)
    rows = decode_tokens(spark, path).orderBy("part", "block", "place").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    texts, start = {r[0]: r[1] or "" for r in ROWS}, 0
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    empty = scratch_path(spark, "tokens")
    encode_tokens(no_docs, empty)
    assert decode_tokens(spark, empty).count() == 0


def test_other_vocabularies_go_plain(spark):
    docs = spark.createDataFrame([(1, " Two  words "), (2, "x")], "doc_id bigint, text string")
    path = scratch_path(spark, "tokens")
    encode_tokens(docs, path, vocabulary="byte_bpe_50k.json")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r["n_tokens"] for r in decode_tokens(spark, path).orderBy("doc_id").collect()] == [
        len(library.encode(t).ids) + 1 for t in (" Two  words ", "x")
    ]


# --- pipeline ------------------------------------------------------------------------------
def test_unclear_languages_go_and_clear_ones_stay(spark):
    """The threshold follows the scores of right predictions; unlearnt letters and bare numbers are unclear."""
    docs = spark.read.parquet(f"{DIR}/../sf0.01/documents.parquet")
    odd = ["Привет как дела это русский текст " * 20, "1234 5678 a 9999 " * 20, "日本語の文章です。" * 40]
    none = F.lit(None).cast("string")
    rows = [docs.limit(1).withColumns({"doc_id": F.lit(900_001 + i).cast("bigint"), "text": F.lit(t), "lang": none}) for i, t in enumerate(odd)]
    judged = corpus_pipeline.known_language(spark, docs.unionByName(rows[0]).unionByName(rows[1]).unionByName(rows[2]), DIR)
    kept = {r.doc_id for r in judged.collect()}
    everyone = {r.doc_id for r in docs.where(r"text RLIKE '\\p{L}'").collect()}
    assert len(kept & {900_001, 900_002, 900_003}) < 3 and len(everyone - kept) <= 0.002 * len(everyone)
    assert corpus_pipeline.least_score(docs.limit(0), None) == 0.0


def test_pipeline_stages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    planted = docs.limit(1).select(
        F.lit(900_001).cast("bigint").alias("doc_id"), F.lit("12 !! 34").alias("text"), "lang", "source", "n_chars"
    )
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    planted = planted.unionByName(planted.withColumns({"doc_id": F.lit(900_002).cast("bigint"), "text": F.lit(bench)}))
    now = docs.unionByName(planted)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, corpus_pipeline.written(stage(spark, now, DIR), name)
        counts.append(now.count())
        if name != "token_ids":
            assert now.columns == docs.columns
        ids, old = {r[0] for r in now.select("doc_id").collect()}, {r[0] for r in before.select("doc_id").collect()}
        assert ids <= old
        if name == "language":
            # In a table this small, one very short text may count as unclear.
            assert 900_001 in old - ids and len(old - ids) <= 2
        if name == "near_duplicates":
            assert counts[1] == len(ids) < counts[0]
        if name == "decontamination":
            assert 900_002 in old - ids
        if name == "mixing":
            from gridrisk.llm.mixing import source_targets, word_count

            sized = before.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
            want = {r["source"]: r["target"] for r in source_targets(sized).collect()}
            got = {r[0]: r[1] for r in now.groupBy("source").agg(F.sum(word_count(F.col("text")))).collect()}
            assert all(abs(got.get(s, 0) - t) <= 0.5 for s, t in want.items())
    assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and counts[4] == counts[3]
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, no_docs, DIR).count() == 0
        assert stage(spark, odd_docs, DIR).columns == odd_docs.columns


def test_least_score_judges_every_labelled_document(spark, monkeypatch):
    """Far more documents than 20,000 are not learnt from, and all of their scores count."""
    held = spark.range(120_000).where(~corpus_pipeline.training_mask(F.col("id")))
    docs = held.select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang")).localCheckpoint()
    judged = []

    def score(rows, network=None):
        judged.append(rows.count())
        own = F.struct(F.lit("en").alias("lang_pred"), (F.col("doc_id") / 120_000).alias("score"))
        return rows.withColumn("language", own)

    monkeypatch.setattr(corpus_pipeline, "identify_language", score)
    n = docs.count()
    want = sorted(r.doc_id / 120_000 for r in docs.collect())[max(0, -(-n // corpus_pipeline.CLEAR) - 1)]
    assert corpus_pipeline.least_score(docs, None) == pytest.approx(0.75 * want, rel=0.1)
    assert judged == [n] and n > 30_000
