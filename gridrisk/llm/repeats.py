"""Removal of byte strings that stand more than once, by bucket refinement of suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from gridrisk.llm.common import ship, written
from gridrisk.llm.exchange import (
    RUNS,
    answers_of,
    dealt,
    packed_run,
    planes,
    run_table,
    runs,
    text_bytes,
    texts_of,
    unpacked_run,
    unplaned,
)

#: Bytes of a string that may not repeat, and of the window in which the key of a string is chosen.
LENGTH, WINDOW = 400, 128
#: Bytes of text in a chunk, and of text whose keys one range takes.
CHUNK_BYTES, RANGE_BYTES = 8_000_000, 64_000_000
#: Positions whose buckets are refined at once, so that the arrays stay in cache.
SLICE = 1 << 17
POSITION = np.uint64((1 << 18) - 1)

MULTIPLIERS = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)),
    (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)),
)
SCHEMA = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"
)
CORES, WHOLES, STRINGS, OWN = 1, 2, 3, 4


def joined(first: np.ndarray, second: np.ndarray, which: int) -> np.ndarray:
    """The identifier of two buckets, one after the other."""
    one, two = MULTIPLIERS[which]
    out = first >> np.uint64(29)
    out ^= first
    out *= one
    out += second
    out ^= out >> np.uint64(32)
    out *= two
    return out


def refined(ids: np.ndarray, depth: int, to: int, which: int) -> np.ndarray:
    """Bucket identifiers at depth ``to`` from those at ``depth`` at each position and at a later offset."""
    return joined(ids[: len(ids) - (to - depth)], ids[to - depth :], which)


def buckets(data: np.ndarray, depths: tuple[int, ...], which: int = 0) -> list[np.ndarray]:
    """Bucket identifiers of all positions at the given depths, in rising order.

    The first buckets are those of the 8-grams, named by their bytes. Each refinement names a
    bucket by the identifiers of a position and of one as far behind it as the buckets are deep, so
    the depth doubles and every update is used by the next. Equal strings have equal identifiers
    wherever they stand, so no table of buckets is shared between tasks.
    """
    ids = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    out, depth = [], 8
    for to in depths:
        while 2 * depth <= to:
            ids, depth = refined(ids, depth, 2 * depth, which), 2 * depth
        out.append(refined(ids, depth, to, which) if to > depth else ids)
    return out


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


class Strings:
    """The strings of ``length`` bytes of some texts, grouped by key position.

    A string's key is the position of the least 16-gram bucket in its first ``window`` positions,
    the first of equals. It depends on the string alone, so equal strings have their key at the same
    place. Neighbouring strings share keys: those from ``lo`` to ``hi``. ``core`` is the bucket of
    what all strings of a key at any place have in common, from the key on; ``whole`` (and its
    second half ``check``) the bucket of all bytes of the group and the place of the key in it.
    """

    def __init__(self, texts: list[bytes], length: int, window: int):
        self.length, self.window = length, window
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        parts = [self._keys(at) for at in range(0, len(self.data), SLICE)]
        parts = [p for p in parts if len(p[0])]
        empty = [np.empty(0, dtype=np.int64)] * 2 + [np.empty(0, dtype=np.uint64)] * 3
        self.lo, self.hi, self.core, self.whole, self.check = (
            (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        )

    def _keys(self, at: int) -> tuple[np.ndarray, ...]:
        none = (np.empty(0, dtype=np.int64),) * 5
        data = self.data[at : at + SLICE + self.length - 1]
        n = min(SLICE, len(data) - self.length + 1)
        if n <= 0:
            return none
        # A string starts where its text goes on for its length.
        first, last = np.searchsorted(self.ends, [at, at + n], side="right")
        ends = self.ends[first : last + 1]
        begins = np.concatenate([[0 if first == 0 else self.ends[first - 1]], ends[:-1]])
        opens = np.clip(begins - at, 0, n)
        closes = np.clip(ends - self.length + 1 - at, opens, n)
        change = np.zeros(n + 1, dtype=np.int32)
        np.add.at(change, opens, 1)
        np.add.at(change, closes, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(starts):
            return none
        core_depth = self.length - self.window + 1
        gram, core, whole = buckets(data, (16, core_depth, self.length))
        marked = (gram & ~POSITION) | np.arange(len(gram), dtype=np.uint64)
        key = (least_in_window(marked, self.window)[starts] & POSITION).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lo, hi = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
        key = key[new]
        check = buckets(data, (self.length,), 1)[0]
        place = ((hi - lo) << 20 | (key - lo)).astype(np.uint64)

        def both(ids: np.ndarray, which: int) -> np.ndarray:
            return joined(joined(ids[lo], ids[hi], which), place, which)

        return lo + at, hi + at, core[key], both(whole, 0), both(check, 1)

    def ids(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all strings of the given groups, their identifiers and second identifiers."""
        places, first, second = [], [], []
        step = max(1, SLICE // (self.length + self.window))
        for at in range(0, len(lo), step):
            a, b = lo[at : at + step], hi[at : at + step]
            sizes = b - a + self.length
            begins = np.cumsum(sizes) - sizes
            data = self.data[np.repeat(a - begins, sizes) + np.arange(sizes.sum())]
            counts = b - a + 1
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            where = np.repeat(begins, counts) + inside
            places.append(np.repeat(a, counts) + inside)
            first.append(buckets(data, (self.length,), 0)[0][where])
            second.append(buckets(data, (self.length,), 1)[0][where])
        if not places:
            return (np.empty(0, dtype=np.int64), *[np.empty(0, dtype=np.uint64)] * 2)
        return np.concatenate(places), np.concatenate(first), np.concatenate(second)


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct pair first stands in sorted order, the number of the pair of each entry, and the counts."""
    order = np.lexsort((second, first))
    new = np.concatenate([[True], (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)])[: len(order)]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number, minlength=int(new.sum()))


def ordered_rows(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a chunk, in an order that does not depend on how they came."""
    rows = sorted(
        zip(table.column("doc_id").to_pylist(), texts_of(table), strict=True),
        key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh3_128_digest(r[1])),
    )
    return [r[0] for r in rows], [r[1] for r in rows]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, spans (begin, end) and kept, the bytes that are left.

    Removed is each byte under a string of ``length`` bytes of one text that also starts anywhere
    else, in the same text or another; strings are judged on the input, and overlaps count.
    ``spans`` are the maximal removed runs.

    A null or empty text has no bytes; a text shorter than ``length`` keeps all. Repeated rows are
    copies of each other, whatever their doc_id, null included. An empty table gives an empty
    result. What is kept may end inside a character. Other columns are not read.

    Suffixes go to buckets by bucket refinement (``buckets``) down to ``length`` bytes, but of the
    strings that share a key only the bucket of their common core and that of all their bytes are
    sent. A core that stands once ends its strings; all strings of a group that stands twice are
    repeats. Only where a core has several surroundings, one group of each sends its single strings
    in a second round. Keys are compared on 104 or more bits of two independent identifiers. A key
    held by very many documents is one entry in each chunk, so no task gets more than its share.
    """
    if length - window < 15 or window < 2 or window > 1 << 17:
        raise ValueError("length must be at least window + 15")
    ship(docs.sparkSession)
    size = text_bytes(docs)
    chunks, ranges = max(1, -(-size // chunk_bytes)), max(1, -(-size // range_bytes))
    texts = dealt(docs, chunks)

    def read(table: pa.Table) -> Strings:
        return Strings([t for t in ordered_rows(table)[1] if len(t) >= length], length, window)

    def grouped(own: Strings):
        """Distinct cores (first group, number of each group's core) and distinct whole groups."""
        core, core_of, n = np.unique(own.core, return_inverse=True, return_counts=True)
        return core, core_of, n, distinct(own.whole, own.check)

    def ask(table: pa.Table) -> pa.Table:
        own, chunk = read(table), table.column("chunk")[0].as_py()
        core, core_of, n, (at, _, counts) = grouped(own)
        # 0: one group, 1: several and all the same, 2: different ones; then the bucket of one of them.
        least = np.full(len(core), np.iinfo(np.uint64).max, dtype=np.uint64)
        most = np.zeros(len(core), dtype=np.uint64)
        np.minimum.at(least, core_of, own.whole)
        np.maximum.at(most, core_of, own.whole)
        state = np.where(least != most, 2, (n > 1).astype(np.uint8)).astype(np.uint8)
        whole, check, many = own.whole[at], own.check[at], (counts > 1).astype(np.uint8)
        return run_table(
            runs(chunk, CORES, core, ranges, lambda a, b: state[a:b].tobytes() + planes(least[a:b], 6))
            + runs(chunk, WHOLES, whole, ranges, lambda a, b: many[a:b].tobytes() + planes(check[a:b], 5))
        )

    def answer(table: pa.Table) -> pa.Table:
        kind, r = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
        chunk = np.array(table.column("chunk").to_pylist())
        if kind == OWN:
            return table.select(["chunk", "kind", "range", "keys", "extra"])
        keys = [unpacked_run(k) for k in table.column("keys").to_pylist()]
        lengths = np.array([len(k) for k in keys])
        sent = table.column("extra").to_pylist()
        key = np.concatenate(keys)
        many = np.concatenate([np.frombuffer(x[:n], dtype=np.uint8) for x, n in zip(sent, lengths, strict=True)])
        more = np.concatenate([unplaned(x[n:], n) for x, n in zip(sent, lengths, strict=True)])
        if kind == CORES:
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            several = np.diff(np.append(new, len(order))) > 1
            state = np.maximum(np.maximum.reduceat(many[order], new), several.astype(np.uint8))
            apart = np.minimum.reduceat(more[order], new) != np.maximum.reduceat(more[order], new)
            state[apart] = 2
            reply = np.empty(len(key), dtype=np.uint8)
            reply[order] = np.repeat(state, np.diff(np.append(new, len(order))))
        else:
            order = np.lexsort((np.repeat(chunk, lengths), more, key))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(more[order]) != 0)]))
            sizes = np.diff(np.append(new, len(order)))
            repeated = (sizes > 1) | (np.maximum.reduceat(many[order], new) > 0)
            reply = np.empty(len(key), dtype=np.uint8)
            reply[order] = np.repeat(repeated.astype(np.uint8), sizes)
            # Bit 1: of the chunks that hold it, this one speaks for it.
            reply[order[new]] |= 2
        ends = np.cumsum(lengths)
        return run_table(
            [(int(c), kind, r, b"", reply[e - n : e].tobytes()) for c, e, n in zip(chunk, ends, lengths, strict=True)]
        )

    def single(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts):
            return run_table([])
        own, chunk = read(texts), texts.column("chunk")[0].as_py()
        if not len(own.lo):
            return run_table([(chunk, OWN, chunk, b"", b"")])
        core, core_of, _, (at, number, counts) = grouped(own)
        got = {k: np.frombuffer(v, dtype=np.uint8) for k, v in answers_of(replies).items()}
        apart, reply = got[CORES][core_of] == 2, got[WHOLES][number]
        repeated = reply & 1 > 0
        speaks = np.zeros(len(own.lo), dtype=bool)
        speaks[at] = True
        speaks &= apart & (reply & 2 > 0)
        spans = [own.lo[repeated], own.hi[repeated]]
        place, first, second = own.ids(own.lo[speaks], own.hi[speaks])
        # Strings of repeated groups are sent for others to meet; their own answer is known.
        open_place = np.where(np.repeat(repeated[speaks], (own.hi - own.lo + 1)[speaks]), -1, place)
        one, of, n = distinct(first, second)
        inside = (n[of] > 1) & (open_place >= 0)
        spans = [np.concatenate([s, open_place[inside]]) for s in spans]
        waiting = np.where(n > 1, -1, open_place[one])
        key, check, many = first[one], second[one], (n > 1).astype(np.uint8)
        rows = runs(chunk, STRINGS, key, ranges, lambda a, b: many[a:b].tobytes() + planes(check[a:b], 5))
        return run_table([*rows, (chunk, OWN, chunk, planes(waiting), planes(np.concatenate(spans)))])

    def cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
        doc_ids, own = ordered_rows(texts)
        long = [t for t in own if len(t) >= length]
        covered = np.zeros(sum(map(len, long)) + 1, dtype=np.int32)
        for kind, keys, extra in zip(*(replies.column(c).to_pylist() for c in ("kind", "keys", "extra")), strict=True):
            if kind == OWN:
                waiting, spans = (unplaned(x, len(x) // 8, np.int64) for x in (keys, extra))
        if len(replies):
            reply = np.frombuffer(answers_of(replies).get(STRINGS, b""), dtype=np.uint8)
            found = waiting[(reply & 1 > 0) & (waiting >= 0)]
            lo, hi = spans.reshape(2, -1)
            np.add.at(covered, np.concatenate([lo, found]), 1)
            np.add.at(covered, np.concatenate([hi, found]) + length, -1)
        gone = np.cumsum(covered[:-1]) > 0
        begin, rows = 0, []
        for doc_id, text in zip(doc_ids, own, strict=True):
            if len(text) < length:
                rows.append((doc_id, len(text), 0, [], text))
                continue
            here = gone[begin : begin + len(text)]
            begin += len(text)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
            kept = np.frombuffer(text, dtype=np.uint8)[~here].tobytes() if len(edges) else text
            spans_of = [{"begin": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            rows.append((doc_id, len(text), len(text) - len(kept), spans_of, kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, columns, kinds, strict=True)})

    def exchanged(sent: DataFrame, name: str) -> DataFrame:
        return written(sent.groupBy("kind", "range").applyInArrow(answer, RUNS), name).groupBy("chunk")

    known = exchanged(texts.groupBy("chunk").applyInArrow(ask, RUNS), "repeat-groups")
    strings = exchanged(texts.groupBy("chunk").cogroup(known).applyInArrow(single, RUNS), "repeat-strings")
    return texts.groupBy("chunk").cogroup(strings).applyInArrow(cut, SCHEMA)
