"""Conversation repair against an exhaustive search."""

import hashlib
import heapq
import random
import zlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from gridrisk.llm import queries
from gridrisk.llm.conversations import (
    CLOSING,
    START,
    composed,
    damaged,
    exit_state,
    floors,
    least_edits,
    repair,
    Segment,
    walked,
)

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) by uniform-cost search over all edits; rows are (forced, initial, truncated)."""
    target = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, target[state]))
        if i < len(rows):
            forced, initial, truncated = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not forced:
                if (state, initial) in keep:
                    heapq.heappush(heap, (cost + 3 * truncated, audit + "K", i + 1, keep[state, initial]))
                heapq.heappush(heap, (cost + 3 + 3 * truncated, audit + "R", i + 1, target[state]))


def brute(rows):
    """The query's result from (conv_id, turn, role, text) rows, one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in left:
            bare = text.rstrip(BLANKS)
            faults.append(
                "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        cost, audit = cheapest([(f in ("blank", "duplicate"), r[1][:1], f == "truncated") for r, f in zip(left, faults)])
        lines, state, i = [], 0, 0
        for letter in audit:
            want = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            if letter == "K":
                lines.append(":".join(left[i][1:]))
                state = {"s": 1, "u": 2, "a": 3}[left[i][1][0]]
            elif letter != "D":
                lines.append({2: "user:", 3: "assistant:"}[want] + (left[i][2] if letter == "R" else ""))
                state = want
            i += letter != "I"
        turns = [r[0] for r in left if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        out[conv] = (
            gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def random_rows(seed, n, roles="sua?"):
    pick = random.Random(seed)
    return [(pick.random() < 0.2, pick.choice(roles), pick.random() < 0.2) for _ in range(n)]


@pytest.mark.parametrize("seed", range(300))
def test_search_finds_the_cheapest_and_least_edits(seed):
    rows = random_rows(seed, seed % 11)
    rows = [(f, i, t and not f) for f, i, t in rows]
    best = cheapest(rows)
    assert least_edits(rows) == best
    assert floors(rows)[0] <= best[0]


@pytest.mark.parametrize("seed", range(60))
def test_segments_compose_to_the_whole(seed):
    rows = [(f, i, t and not f) for f, i, t in random_rows(seed, 3 + seed % 14)]
    segments = []
    for at in range(0, len(rows), 1 + seed % 4):
        segments.append(Segment())
        segments[-1].rows = rows[at : at + 1 + seed % 4]
    tables = [s.table() for s in segments]
    pairs = [t[:2] for t in tables]
    whole = reduce(composed, pairs)
    last = exit_state(whole)
    ways = walked(pairs, START, last)
    audit = "".join(t[2][4 * s + e] for t, (s, e) in zip(tables, ways)) + CLOSING[last][1]
    assert (whole[0][last] + CLOSING[last][0], audit) == cheapest(rows)


ROWS = "conv_id bigint, turn bigint, role string, text string, extra int"


def made(seed=5):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "cut \n", "", " \t\r\n", None, "İ. ", "x" * 3000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(pick.randrange(0, 12)):
            at = None if pick.random() < 0.05 else turn + (pick.random() < 0.1) * 7
            role = pick.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, at, role, pick.choice(texts), 1))
    # One conversation holds a third of all rows, with one text most of the time.
    rows += [(77, t, pick.choice(["user", "assistant"]), pick.choice(["Same.", "Same.", f"Answer {t}.", f"cut {t}"]), 1) for t in range(130)]
    return rows + rows[:9] + [(5, 1, "user", "Twice.", 1)] * 5


def collected(df):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in df.collect()
    }


def test_query_equals_brute_force(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, ROWS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = collected(queries.op13_conversation_repair(spark, str(tmp_path)))
    assert found == brute([r[:4] for r in rows])


def test_long_conversations_in_pieces(spark, monkeypatch):
    """Short segments, little kept in place and two children a node give the same result."""
    rows = made(8)
    wanted = brute([r[:4] for r in rows])
    got = repair(damaged(spark.createDataFrame(rows, ROWS)), segment_rows=3, local_segments=2, fan=2)
    found = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}
    assert found == {k: v[1:] for k, v in wanted.items() if k in found}
    assert all(v[1:5] == (0, 0, 0, 0) for k, v in wanted.items() if k not in found)


def test_empty_table_and_all_rows_dropped(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert queries.op13_conversation_repair(spark, f"{tmp_path}/a").collect() == []
    conv, turn = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(conv, turn, "user", "Hi.", 1)], ROWS).write.parquet(f"{tmp_path}/b/conversations.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    assert collected(queries.op13_conversation_repair(spark, f"{tmp_path}/b")) == {conv: (0, 0, 0, 0, 0, 0, "", empty)}


def test_plan_reads_only_its_columns(spark):
    rows = damaged(spark.createDataFrame([(1, 1, "user", "Hi.", 1)], ROWS))
    assert rows.columns == ["conv_id", "turn", "role", "text", "copies"]
    assert rows.where(F.col("copies") < 0).count() == 0
