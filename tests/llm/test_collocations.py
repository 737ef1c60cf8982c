"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridrisk.llm import queries
from gridrisk.llm.collocations import Shard, Transducer, collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, percent=100, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    out = []
    for lang in {r[0] or ("und" if r[0] is None else "") for r in rows}:
        count, n = Counter(), 0
        for _, text in (r for r in rows if (("und" if r[0] is None else r[0]) == lang)):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for m in range(1, longest + 1):
                    count.update(tuple(words[b : b + m]) for b in range(len(words) - m + 1))
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for b in range(len(p) - m + 1):
                    around[p[b : b + m]] = max(around[p[b : b + m]], a)
        scored = []
        for p, a in found.items():
            if p in around and 100 * around[p] >= percent * a:
                continue
            score, k = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed):
    pick = random.Random(seed)
    words = ["the", "of", "New", "york", "a", "b", "É", "ch\x1c", "😀", "long" * 30]
    text = lambda n: "".join(pick.choice(words) + pick.choice(["  ", " ", "\t", " ", " ", ". ", ",", "\n", "\x0b"]) for _ in range(n))
    rows = [(pick.choice(["en", "de", None, ""]), text(pick.randrange(60))) for _ in range(80)]
    return rows + [("en", "the new york of the")] * 40 + [("en", None), ("fr", ""), ("fr", " . ! ")] + [("en", "x y " * 200)]


@pytest.mark.parametrize(("seed", "top", "percent"), [(1, 2000, 100), (2, 3, 100), (3, 2000, 50)])
def test_equals_brute_force(spark, seed, top, percent):
    rows = made(seed)
    docs = spark.createDataFrame([(i % 50, *r, "x") for i, r in enumerate(rows)], "doc_id bigint, lang string, text string, words string")
    got = collocations(docs.repartition(4), least=12, top=top, percent=percent, chunk_bytes=3000, range_bytes=4000)
    assert found(got) == brute(rows, 12, percent=percent, top=top)


def test_products_beyond_64_bits(spark):
    rows = [("en", "a b " * 30000 + ". " + "c d " * 30000)]
    docs = spark.createDataFrame([(1, *r) for r in rows], "doc_id bigint, lang string, text string")
    assert found(collocations(docs)) == brute(rows, 100)


def test_query_on_odd_tables(spark, tmp_path):
    rows = [("en", "One of the. One of the! \tONE of the")] * 60 + [(None, "A b\x0bc d")] * 100 + [("de", None)]
    schema = "doc_id bigint, lang string, text string, rank int, n int"
    spark.createDataFrame([(None, *r, 1, 2) for r in rows], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = found(queries.op11_collocations(spark, f"{tmp_path}/a"))
    assert got == brute(rows, 100) and got
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_collocations(spark, f"{tmp_path}/b").collect() == []


def test_union_sums_and_composition_finds_parts():
    texts = [["a b c a b c d", "b c"], ["c a b", "a b. a b"]]
    parts = []
    for own in texts:
        shard = Shard(["en"] * len(own), [t.encode() for t in own])
        whole = Transducer.of_shard(shard, np.ones(len(shard.codes), bool), np.ones(len(shard.at), bool), 5)
        parts += [part for _, part, _ in whole.by_range(1)]
    both = Transducer.union(parts, 5)
    code = dict(zip("abcd", Shard(["en"], [b"a b c d"]).codes.view(np.int64).tolist()))
    ask = ["a b", "b c", "a b c", "c a b", "a", "d", "b a", "a b c a b", "d d"]
    assert both.composed([[code[w] for w in p.split()] for p in ask]).tolist() == [5, 3, 2, 2, 5, 1, 0, 1, 0]
    assert both.pruned(3).composed([[code[w] for w in p.split()] for p in ask]).tolist() == [5, 3, 0, 0, 5, 1, 0, 0, 0]
