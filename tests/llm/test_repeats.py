"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from gridrisk.llm import queries, repeats
from gridrisk.llm.repeats import remove_repeats
from tests.llm.conftest import ROWS


def brute(rows, length):
    """Sorted (doc_id, n_bytes, n_removed, spans, kept) of (doc_id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = [p for p in range(len(b) + 1) if gone[p] != (p > 0 and gone[p - 1])]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), tuple(zip(spans[::2], spans[1::2])), kept))
    return sorted(out, key=str)


def found(df):
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, tuple((s.begin, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()),
        key=str,
    )


def made(seed):
    """Texts of few letters with passages, near copies, periods, runs, and copies of whole texts."""
    pick = random.Random(seed)

    def noise(n):
        return "".join(pick.choice("abcdeé \n") for _ in range(n))

    passages = [noise(pick.randrange(30, 200)) for _ in range(4)] + ["ab" * 60, "x" * 150, noise(7) * 20]
    texts = [None, "", "a" * 39, "a" * 40, "a" * 41]
    for _ in range(60):
        texts.append("".join(pick.choice([noise(pick.randrange(60)), pick.choice(passages)]) for _ in range(pick.randrange(1, 6))))
    near = list(texts[20])
    for _ in range(6):
        near = list(texts[20])
        near[pick.randrange(len(near))] = "Z"
        texts.append("".join(near))
    texts += [texts[30]] * 5
    return [(pick.choice([None, n]) if n % 7 == 0 else n, t) for n, t in enumerate(texts)] + [(30, texts[30])]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, monkeypatch, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, n_bytes string").repartition(3)
    monkeypatch.setattr(repeats, "SLICE", 1 << (8 + 3 * seed))
    got = remove_repeats(docs, length=40, window=(16, 25, 2, 10)[seed], chunk_bytes=2500, range_bytes=6000)
    assert found(got) == brute(rows, 40)


def test_keys_do_not_depend_on_what_stands_around():
    pick = random.Random(1)
    common = bytes(pick.randrange(97, 101) for _ in range(900))
    one, two = (repeats.Strings([bytes(pick.randrange(97, 101) for _ in range(n)) + common], 400, 128) for n in (700, 1333))
    place = {}
    for own, begin in ((one, 700), (two, 1333)):
        inside = (own.lo >= begin) & (own.hi + 400 <= begin + 900)
        place[begin] = {(int(lo) - begin, int(hi) - begin, int(w), int(c)) for lo, hi, w, c in
                        zip(own.lo[inside], own.hi[inside], own.whole[inside], own.core[inside])}
    assert place[700] and len(place[700] & place[1333]) >= len(place[700]) - 1


def test_query_on_odd_rows(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(70))
    rows = [(r[0], r[1]) for r in ROWS] + [(20, f"before {passage} after"), (21, f"{passage} elsewhere")]
    schema = "doc_id bigint, text string, chunk int"
    spark.createDataFrame([(*r, 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_suffix_dedup(spark, str(tmp_path)).collect()}
    # The long text repeats nothing within itself, so it is left out of the slow count.
    slow = brute([r for r in rows if r[0] != 8], 400)
    want = {(i, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in slow}
    assert {r for r in got if r[0] != 8} == want
    assert [(r[2], r[3]) for r in got if r[0] == 8] == [(0, 0)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
