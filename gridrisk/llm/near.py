"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import packed, ship, written
from gridrisk.llm.components import components

#: Words of a shingle and the least similarity in percent, unless the caller says otherwise.
SHINGLE = 5
PERCENT = 80
#: 30 bands of 5: at similarity 0.8 a pair misses all bands once in 100,000; at 0.85 once in 40 million.
BANDS, ROWS = 30, 5
#: Chance to prune a pair of the least similarity, over all batches.
MISS = 1e-6
#: Hashes of one batch of comparisons.
BATCH = 30
#: Texts and shingles of one verification chunk, on average.
CHUNK_TEXTS, CHUNK_SHINGLES = 256, 200_000

MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class WordHashes(dict):
    """64-bit hashes of words; 150,000 words of at most 64 bytes are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; words are parted by ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    # A whole sequence that is shorter than a shingle has a seed of its own; equal shingles never have.
    seed, size = (len(hashes), len(hashes)) if len(hashes) < size else (0, size)
    n = len(hashes) - size + 1
    out = np.full(n, seed, dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """The least of the shingles' low 32 bits under each odd multiplier; long texts go in pieces."""
    low, least = own.astype(np.uint32), np.full(len(MULTIPLIERS), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024, None] * MULTIPLIERS).min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray) -> list[int]:
    return [
        xxhash.xxh3_64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)
    ]


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For each batch, the fewest matches so far with which a pair goes on.

    With a uniform prior the similarity after m matches of n is Beta(m+1, n-m+1) distributed; a
    pair is pruned if the posterior chance of ``percent`` or more is below ``miss`` by batch.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    tail = s >= percent / 100
    out = []
    batches = range(BATCH, len(MULTIPLIERS) + 1, BATCH)
    for n in batches:
        for m in range(n + 1):
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(s) + (n - m) * np.log1p(-s)
            if np.exp(log[tail]).sum() / 20_000 >= miss / len(batches):
                out.append(m)
                break
    return tuple(out)


class Chunk:
    """Signatures, band hashes and sorted shingle sets of some documents."""

    def __init__(self, nodes: np.ndarray, sets: list[bytes]):
        self.nodes = nodes
        self.sets = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.signs = np.array([signature(s) for s in self.sets]).reshape(len(sets), len(MULTIPLIERS))
        # One number for each band, equal where the band is.
        mixed = np.zeros((len(sets), BANDS), dtype=np.uint64)
        for k in range(ROWS):
            mixed = (mixed ^ self.signs[:, k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        self.bands = mixed


def band_pairs(a: Chunk, b: Chunk) -> np.ndarray:
    """Pairs (i, j) that share a band, each once."""
    found = []
    for band in range(BANDS):
        order = np.argsort(b.bands[:, band], kind="stable")
        keys = b.bands[order, band]
        begin, end = (np.searchsorted(keys, a.bands[:, band], side) for side in ("left", "right"))
        counts = end - begin
        left = np.repeat(np.arange(len(a.nodes)), counts)
        right = order[np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        found.append(left * len(b.nodes) + right)
    both = np.unique(np.concatenate(found))
    return np.stack([both // len(b.nodes), both % len(b.nodes)], axis=1)


def verified_links(a: Chunk, b: Chunk, percent: int, miss: float) -> list[tuple[int, int]]:
    """Links between two chunks (or inside one) that join what was apart, confirmed on full sets.

    Pairs that share a band go through batches of signature comparisons and leave when the
    posterior drops. Survivors are met from the most similar on; a pair whose ends are already
    joined by confirmed links needs no more work.
    """
    pairs = band_pairs(a, b)
    if a is b:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    # The sizes alone bound the similarity.
    small, large = np.minimum(a.sizes[pairs[:, 0]], b.sizes[pairs[:, 1]]), np.maximum(a.sizes[pairs[:, 0]], b.sizes[pairs[:, 1]])
    pairs = pairs[small * 100 >= large * percent]
    matches = np.zeros(len(pairs), dtype=np.int64)
    for at, least in zip(range(0, len(MULTIPLIERS), BATCH), least_matches(percent, miss), strict=False):
        part = slice(at, at + BATCH)
        matches += (a.signs[pairs[:, 0], part] == b.signs[pairs[:, 1], part]).sum(axis=1)
        pairs, matches = pairs[matches >= least], matches[matches >= least]
    top: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out, side = [], int(a is not b)
    for i, j in pairs[np.argsort(-matches, kind="stable")].tolist():
        x, y = root((0, i)), root((side, j))
        if x == y:
            continue
        one, two = a.sets[i], b.sets[j]
        if len(one) > len(two):
            one, two = two, one
        at = np.searchsorted(two, one)
        at[at == len(two)] = 0
        both = int((two[at] == one).sum())
        if 100 * both >= percent * (len(one) + len(two) - both):
            out.append((int(a.nodes[i]), int(b.nodes[j])))
            top[x] = y
    return out


def near_classes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set, and its band hashes; empty sets have none."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), shingle)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bands.append(band_hashes(signature(own)) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(
        sketch, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
    )


def near_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, miss: float) -> DataFrame:
    """Confirmed links (a, b) between class representatives, enough to join every component.

    ``classes`` has node, n_shingles, bands. Nodes that share a band bucket with another one are
    placed in chunks near the smallest node they meet; chunks are of bounded size. Every two chunks
    with a common bucket (and each with itself) are verified together in one task, so all
    candidate pairs are met, no pair becomes a row, and no bucket sits in one task.
    """
    buckets = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(buckets.join(shared, "bucket").select("node", "n_shingles", "bucket", "first"), "near-buckets")
    homes = met.groupBy("node", "n_shingles").agg(F.min("first").alias("home"))
    sizes = homes.groupBy("home").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / CHUNK_TEXTS), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)
        ).alias("parts")
    )
    placed = written(
        homes.join(sizes, "home").select(
            "node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("chunk")
        ),
        "near-chunks",
    )
    in_bucket = met.select("node", "bucket").join(placed, "node").groupBy("bucket").agg(
        F.array_sort(F.collect_set("chunk")).alias("chunks")
    )
    # Inside a chunk two nodes must share a bucket, across chunks the bucket's chunks meet.
    meetings = (
        in_bucket.select(F.explode("chunks").alias("a"), "chunks")
        .select("a", F.explode(F.expr("filter(chunks, c -> c >= a)")).alias("b"))
        .distinct()
    )
    tasks = meetings.select(F.xxhash64("a", "b").alias("task"), "a", "b")
    seats = tasks.select("task", F.col("a").alias("chunk"), F.lit(0).alias("side")).unionByName(
        tasks.where("a <> b").select("task", F.col("b").alias("chunk"), F.lit(1).alias("side"))
    )

    def set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text.as_py(), shingle).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("chunk"), pa.array(own, pa.binary())], names=["node", "chunk", "shingles"]
            )

    texts = docs.select(docs["doc_id"].cast("bigint").alias("node"), docs["text"])
    # The placed nodes grow with the corpus, so the join is a shuffle at every size.
    sets = written(
        texts.join(placed.hint("merge"), "node").mapInArrow(set_bytes, "node bigint, chunk bigint, shingles binary"), "near-sets"
    )

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        sides = [
            Chunk(own["node"].to_numpy(np.int64), own["shingles"].tolist()) for _, own in group.groupby("side", sort=True)
        ]
        links = verified_links(sides[0], sides[-1], percent, miss)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return sets.join(seats, "chunk").groupBy("task").applyInPandas(verify, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are parted by ASCII white space, A-Z lower-cased; a set holds the distinct shingles, or
    the whole sequence where there are fewer words. Two documents are linked if their sets share at
    least ``percent`` of their union; component_id is the smallest doc_id that links reach, and
    kept marks the document with that id.

    A null or empty text has an empty set and no links. Equal sets are one class under its smallest
    doc_id (an exact group of any size is one row here). Rows with equal doc_ids are one document
    with several texts: they share a component. A row with a null doc_id is never linked: its
    component_id is null and it is not kept. An empty table gives an empty result; other columns
    are not read.

    Candidates come from 30 bands of 5 MinHash values and pass a sequential Bayesian test; every
    link is confirmed on the full sets of 64-bit shingle hashes. What can be lost is a pair that
    shares no band or that the test prunes: about one in 100,000 at the least similarity for 80 %.
    """
    ship(docs.sparkSession)
    rows = written(near_classes(docs, shingle), "near-rows")
    known = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
        ),
        "near-classes",
    )
    # A doc_id whose rows have different texts stands for several classes.
    by_id = known.join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    same_id = by_id.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = near_links(docs, classes, shingle, percent, miss)
    reached = components(links.unionByName(same_id))
    return (
        rows.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of the smallest doc_id, a null one last.

    Every row is judged by its own text, whatever its doc_id: repeated rows and rows without a
    doc_id are copies like others, and of a doc_id with different texts each has its own group. Rows
    whose text is null, empty or blank are in no group and stay, one for each doc_id and text. Rows
    whose 64-bit keys meet by chance all stay.
    """
    # A row's key is a hash of its doc_id and text; a second hash tells the few rows that only share the key.
    keyed = docs.select(
        packed(docs).alias("row"),
        F.xxhash64("doc_id", "text").alias("key"),
        F.xxhash64(F.lit("second"), "text", "doc_id").alias("second"),
    )
    judged = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), shingle, percent)
    groups = judged.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
    names = keyed.groupBy("key").agg(
        F.min(F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))).alias("name"), (F.min("second") != F.max("second")).alias("shared")
    )
    named = written(names.join(groups.hint("merge"), "key"), "near-names")
    first = named.groupBy("group").agg(F.min(F.struct("name", "key")).alias("first")).select(F.col("first.key").alias("key"))
    chosen = first.unionByName(named.where("shared").select("key")).hint("merge")
    return keyed.join(chosen, "key", "left_semi").dropDuplicates(["key", "second"]).select("row.*")
