"""Benchmark decontamination: a broadcast set of normalised n-grams against training texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.llm.common import packed, ship, written

#: Consecutive words of a window; a shorter item is one window.
WINDOW = 13
#: A document is contaminated from one hit word in so many.
ONE_IN = 20
#: Bytes of benchmark text in one broadcast; more text is scanned for block by block.
BLOCK_BYTES = 8_000_000
#: Every byte that belongs to no word becomes a blank; bytes from 128 on belong to words.
WORD_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
HIT = "struct<n_words: bigint, runs: array<int>, items: array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class WindowIndex:
    """The distinct windows of some items: sorted 64-bit hashes, the words behind them, and their items."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for at, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            size = min(WINDOW, len(ids))
            for begin in range(len(ids) - size + 1 if ids else 0):
                windows[tuple(ids[begin : begin + size])].add(at)
        self.by_size = {}
        for size in sorted({len(w) for w in windows}):
            mine = [w for w in windows if len(w) == size]
            ids = np.array(mine, dtype=np.int32).reshape(len(mine), size)
            hashes = self.hashed(ids)
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], ids[order], [sorted(windows[mine[i]]) for i in order])

    @classmethod
    def hashed(cls, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for column in windows.T:
                out = (out ^ column.astype(np.uint64)) * cls.FACTOR
                out ^= out >> np.uint64(29)
        return out

    def scan(self, text: str) -> tuple[int, np.ndarray | None, set[int]]:
        """Number of words, a mask of those inside verified windows (None: no hit), the items hit."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        mask, items = None, set()
        for size, (hashes, windows, owners) in self.by_size.items():
            if len(ids) < size:
                break
            begins = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(begins):
                continue
            seen = ids[begins[:, None] + np.arange(size)]
            found = self.hashed(seen)
            at, end = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            while len(open_ := np.flatnonzero(at < end)):
                same = open_[(windows[at[open_]] == seen[open_]).all(axis=1)]
                for window in np.unique(at[same]):
                    items.update(owners[window])
                if len(same):
                    if mask is None:
                        mask = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.add.at(mask, begins[same], 1)
                    np.add.at(mask, begins[same] + size, -1)
                at = at + 1
        return len(ids), None if mask is None else np.cumsum(mask[:-1]) > 0, items


def as_runs(mask: np.ndarray) -> list[int]:
    """Begin and end of every run of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()


def scan_udf(shared):
    @F.pandas_udf(HIT)
    def scan(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = WindowIndex(shared.value)
        for texts, runs, items in parts:
            out = []
            for text, old_runs, old_items in zip(texts, runs, items, strict=True):
                size, mask, found = index.scan(text or "")
                if mask is not None:
                    for begin, end in zip(old_runs[::2], old_runs[1::2], strict=True):
                        mask[begin:end] = True
                names = {index.names[i] for i in found} - {None}
                out.append(
                    (size, list(old_runs) if mask is None else as_runs(mask), sorted(names | set(old_items)))
                )
            yield pd.DataFrame(out, columns=["n_words", "runs", "items"])

    return scan


@F.pandas_udf(T.StringType())
def without_runs(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """The texts without the words of their runs and what stands between those words."""

    def cut(text: str | None, own: np.ndarray) -> str | None:
        if text is None or not len(own):
            return text
        raw, kept, at = text.encode(), [], 0
        spans = [m.span() for m in WORD.finditer(raw)]
        for begin, end in zip(own[::2], own[1::2], strict=True):
            kept.append(raw[at : spans[begin][0]])
            at = spans[end - 1][1]
        return b"".join([*kept, raw[at:]]).decode()

    return pd.Series([cut(*x) for x in zip(texts, runs, strict=True)], dtype=object)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if block and size + len(text or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text or "")
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``hits``: struct of n_words, n_hit, items, contaminated.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is 13
    consecutive words of a benchmark item, or all words of a shorter one. Windows are looked up by
    hash and then compared word by word; each word of a document inside any occurrence is hit.
    ``items`` are the ids (as strings, sorted) of the items with occurring windows. A document is
    contaminated if it has a hit and at least one hit in 20 words.

    ``remove="documents"`` leaves contaminated documents out; ``remove="spans"`` cuts the hit words
    of contaminated documents out of ``text``; ``None`` only reports.

    A null or empty text has no words and is never hit; an item without words has no window. An item
    with a null id hits words but is not listed; equal ids count once. Repeated documents are
    judged alike and all kept. An empty benchmark hits nothing. An extra column called ``hits`` is
    replaced.

    The window set is broadcast in blocks of at most ``block_bytes`` of benchmark text (or one
    item), one block after the other with a written table in between. Documents are never shuffled.
    """
    ship(docs.sparkSession)
    nothing = "named_struct('n_words', 0L, 'runs', CAST(array() AS array<int>), 'items', CAST(array() AS array<string>))"
    out = docs.select(packed(docs, "hits").alias("row"), F.expr(nothing).alias("hit"))
    for number, block in enumerate(benchmark_blocks(benchmark, block_bytes)):
        if number:
            out = written(out, "decontaminated")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.select("row", scan_udf(shared)("row.text", "hit.runs", "hit.items").alias("hit"))
    n_hit = F.aggregate(
        F.sequence(F.lit(1), F.size("hit.runs")),
        F.lit(0).cast("bigint"),
        lambda total, i: total + F.when(i % 2 == 0, 1).otherwise(-1) * F.get("hit.runs", i - 1),
    )
    n_hit = F.when(F.size("hit.runs") > 0, n_hit).otherwise(0).cast("bigint")
    out = out.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("hit.n_words"))
    )
    if remove == "documents":
        out = out.where(~F.col("contaminated"))
    elif remove == "spans":
        text = F.when(F.col("contaminated"), without_runs("row.text", "hit.runs")).otherwise(F.col("row.text"))
        out = out.withColumn("row", F.col("row").withField("text", text))
    return out.select(
        "row.*", F.struct("hit.n_words", "n_hit", F.col("hit.items").alias("items"), "contaminated").alias("hits")
    )
