"""Sorted 64-bit keys of chunks, sent to key ranges as packed runs, with one answer to every key.

A chunk is some documents; it sends its distinct keys once, cut into ranges of equal width. The
task of a range meets the keys of all chunks and answers each in the order it was sent, so nothing
but the answer travels back. A very common key is one entry a chunk. Ranges follow the amount of
text and empty runs are not sent, so there are never more rows than distinct keys a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "chunk int, kind int, range int, keys binary, extra binary"
NAMES = ["chunk", "kind", "range", "keys", "extra"]
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def planes(values: np.ndarray, width: int | None = None) -> bytes:
    """The lowest ``width`` bytes of the values, all lowest bytes first; what is mostly zero then packs well."""
    bytes_of = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return np.ascontiguousarray(bytes_of[:width]).tobytes()


def unplaned(raw: bytes, n: int, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((n, size), dtype=np.uint8)
    if n:
        got = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
        out[:, : len(got)] = got.T
    return out.view(kind).reshape(-1)


def packed_run(keys: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their steps."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_run(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, len(raw) // 8), dtype=np.uint64)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted keys are cut into ranges of equal width."""
    edges = [(r << 64) // ranges for r in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]]).astype(np.int64)


def runs(chunk: int, kind: int, keys: np.ndarray, ranges: int, extra) -> list[tuple]:
    """Rows of sorted ``keys``; ``extra(a, b)`` packs what goes with the keys from a up to b."""
    at = cuts(keys, ranges)
    return [
        (chunk, kind, r, packed_run(keys[a:b]), extra(a, b))
        for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))
        if a < b
    ]


def run_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.table({name: pa.array(own, kind) for name, own, kind in zip(NAMES, columns, TYPES, strict=True)})


def answers_of(replies: pa.Table) -> dict[int, bytes]:
    """The answers to a chunk by kind, in the order in which its keys were sent."""
    rows = zip(*(replies.column(c).to_pylist() for c in ("kind", "range", "extra")), strict=True)
    out: dict[int, list[bytes]] = {}
    for kind, _, raw in sorted(rows, key=lambda x: x[:2]):
        out.setdefault(kind, []).append(raw)
    return {kind: b"".join(parts) for kind, parts in out.items()}


def dealt(docs: DataFrame, chunks: int, *carried: str) -> DataFrame:
    """chunk, doc_id, carried columns, and the text as zstd, for the way to the chunk's task.

    The chunk comes from a hash of doc_id and text, so copies of a text spread out and every pass
    over the documents finds the same chunks.
    """
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.pmod(F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"]), F.lit(chunks)).cast("int").alias("chunk"),
        *[docs[c].alias(c) for c in carried],
        docs["text"].cast("binary").alias("text"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = [None if t is None else packer.compress(t) for t in map(pa.BinaryScalar.as_py, batch.column("text"))]
            names = batch.schema.names
            arrays = [pa.array(small, pa.binary()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(pack, rows.schema)


def texts_of(table: pa.Table) -> list[bytes]:
    """The UTF-8 bytes of a chunk's texts; null is empty."""
    reader = zstandard.ZstdDecompressor()
    return [b"" if t is None else reader.decompress(t) for t in table.column("text").to_pylist()]
