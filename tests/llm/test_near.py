"""Near-duplicates and components against brute force."""

import random

import pytest

from gridrisk.llm import near
from gridrisk.llm.components import components
from tests.llm.conftest import ROWS


def shingle_set(text, n):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def joined(pairs):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    return {x: root(x) for x in list(top)}


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    links = [(i, i) for i, _ in sets]
    for k, (a, one) in enumerate(sets):
        for b, two in sets[:k]:
            both = len(one & two)
            if one and two and 100 * both >= percent * (len(one) + len(two) - both) or a == b:
                links.append((a, b))
    return joined(links)


def edited(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def grouped():
    """A large group of near copies with chains, exact copies in many forms, short and unlike texts."""
    rng = random.Random(4)
    base = " ".join(f"b{rng.randrange(500)}" for _ in range(150))
    rows = [edited(rng, base, rng.randrange(0, 12)) for _ in range(120)]
    chain = base
    for _ in range(25):
        chain = edited(rng, chain, 3)
        rows.append(chain)
    rows += [base.upper(), "\t" + base.replace(" ", "\n"), base] * 4
    rows += [" ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows += ["one", "ONE", "one two", "a b c d e", "a b c d", None, "", "  "]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("n", "percent", "chunk"), [(3, 85, 256), (5, 80, 256), (3, 85, 20)])
def test_against_brute_force(spark, grouped, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(near, "CHUNK_TEXTS", chunk)
    df = spark.createDataFrame(grouped, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in near.near_duplicates(df, n, percent).collect()}
    want = brute(grouped, n, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingle_set(t, n)) for i, t in grouped}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near.near_duplicates(odd_docs, 3, 85).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9, None: None, 11: 11, 12: 12}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [False]
    kept = near.drop_near_duplicates(odd_docs, 3, 85)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("1 4 5 6 7 8 9 11 12".split())
    assert near.near_duplicates(no_docs).count() == 0
    assert near.drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)]
    pairs += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, None)], "a bigint, b bigint").repartition(3)
    want = joined([p for p in pairs if p[0] != p[1]])
    rows = components(df).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["component"] for r in rows} == want
    assert components(df.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(1)
    least = near.least_matches(85, near.MISS)
    cuts = range(near.BATCH, near.BANDS * near.ROWS + 1, near.BATCH)
    matches = rng.random((20_000, near.BANDS * near.ROWS)) < 0.85
    assert all((matches[:, :n].sum(axis=1) >= m).all() for n, m in zip(cuts, least, strict=True))


def test_repeated_words_make_equal_sets(spark):
    rows = [(1, "a a a"), (2, "a a a a"), (3, "A a\na a a a"), (4, "a a"), (5, "a"), (6, "a a a b"), (7, "b a a a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 4), 5: (1, 5), 6: (2, 6), 7: (2, 7)}
    assert brute(rows, 3, 85) == {i: c for i, (_, c) in got.items()}


def test_dropping_goes_by_rows(spark):
    """Repeated ids and null ids are copies like others; one row of a group stays, and texts without words all do."""
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, text), (1, text), (1, text), (2, text), (None, text), (2, other), (None, "alone here"), (None, None), (9, ""), (9, " ")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id bigint, text string, at int").repartition(3)
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, text), (2, other), (None, "alone here"), (None, None), (9, ""), (9, " ")], key=str)
    only_null = spark.createDataFrame([(None, text), (None, text)], "doc_id bigint, text string")
    assert near.drop_near_duplicates(only_null).count() == 1
