"""Token ids in a binary file format: frequency ranks, byte-aligned, with separate control bytes."""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import ship

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Ids after which a block ends with its document.
BLOCK_IDS = 1_000_000
#: Words that one Python worker remembers with their ids; then it forgets all and starts anew.
REMEMBERED = 400_000
#: Characters that are encoded together.
GROUP_CHARS = 2_000_000

BLOCKS = (
    "part int, block int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, "
    "ranked binary, control binary, data binary"
)
DECODED = "part int, block int, place int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"

#: For each control byte, the byte lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The ids by falling frequency, the control bytes (two bits a value), the data bytes.

    A value is the frequency rank of an id in this block, in one to four little-endian bytes.
    """
    # Ids of a vocabulary are small numbers, so a table of their counts needs no sort; others are numbered first.
    names, places = (None, ids) if ids.max(initial=0) < 1 << 22 else np.unique(ids, return_inverse=True)
    counts = np.bincount(places)
    known = np.flatnonzero(counts)
    order = known[np.lexsort((known, -counts[known]))]
    rank = np.empty(len(counts), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    values = rank[places]
    sizes = np.ones(len(values), dtype=np.uint8)
    for bits in (8, 16, 24):
        if len(order) > 1 << bits:
            sizes += values >= 1 << bits
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    begins = np.cumsum(sizes, dtype=np.int64) - sizes
    data = np.empty(int(sizes.sum(dtype=np.int64)), dtype=np.uint8)
    data[begins] = values & np.uint32(255)
    for k in range(1, int(sizes.max(initial=1))):
        wide = np.flatnonzero(sizes > k)
        data[begins[wide] + k] = (values[wide] >> np.uint32(8 * k)) & np.uint32(255)
    return (order if names is None else names[order]).astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_ids(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n].astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    raw, values = np.frombuffer(data, dtype=np.uint8), np.zeros(n, dtype=np.uint32)
    for k in range(int(sizes.max(initial=0))):
        wide = sizes > k
        values[wide] |= raw[begins[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, dtype="<u4")[values]


#: The settings under which a word between blanks has the same ids wherever it stands: letters, single
#: digits and runs of other marks are pieces, white space is dropped, and letters are lower-cased.
WORD_SETTINGS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printing ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class KnownWords(dict):
    """Ids of words as bytes; ``learn`` is asked for a new one. Beyond the limit all are forgotten."""

    def __init__(self, learn: Callable[[str], bytes], limit: int):
        super().__init__()
        self.learn, self.limit = learn, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        self[word] = ids = self.learn(word)
        return ids


class TextEncoder:
    """Ids of whole texts from the tokenizers library.

    With a vocabulary of ``WORD_SETTINGS`` each different word goes to the library once and is
    remembered: a word of Latin letters to its model alone, as normalizing it is lower-casing, and
    ASCII marks behind such a word apart, as they are a piece of their own; any other word to the
    whole library. Other vocabularies get whole texts.
    """

    MARKS = string.punctuation

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        settings = json.loads(self.library.to_str())
        found = {
            "normalizer": (settings["normalizer"] or {}).get("normalizers"),
            "pre_tokenizer": (settings["pre_tokenizer"] or {}).get("pretokenizers"),
        }
        self.words_apart = found == WORD_SETTINGS and settings["model"]["type"] == "BPE"
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.model, self.letters = self.library.model, byte_letters()
        self.known = KnownWords(self._word, remembered)
        self.tails = KnownWords(self._whole, 100_000)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        body = word.rstrip(self.MARKS)
        # Lower-casing the dotted capital I leaves a mark that would join what follows.
        if not (body.isalpha() and (body.isascii() or (max(body) < "ɐ" and "İ" not in body))):
            return self._whole(word) if word else b""
        lower = body.lower()
        if lower != word:
            return self.known[lower] + (self.tails[word[len(body) :]] if len(body) < len(word) else b"")
        written = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
        return self._packed([token.id for token in self.model.tokenize(written)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.words_apart:
            return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        get, kind, out = self.known.__getitem__, np.dtype(self.kind), []
        for text in texts:
            words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(np.frombuffer(b"".join(map(get, words)), dtype=kind).astype(np.uint32))
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> TextEncoder:
    """The worker's encoder; a bare file name is one of the installed public vocabularies."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return TextEncoder(vocabulary)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Documents in order, some two million characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= GROUP_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of every whole text to ``path``, in ascending doc_id order.

    Each document's ids end with ``end_id``. The files are Parquet, so that Spark's commit protocol
    covers lost executors and any store will do; a row is a block of whole documents of about
    ``block_ids`` ids with its own frequency ranks (see ``encode_ids``). ``part`` and ``block``
    give the order of blocks.

    A null text is encoded as the empty one: only the end id. Null doc_ids come first. Rows with
    equal doc_ids are ordered by a hash of their text and all written; equal rows are alike in any
    order. Other columns are not read. An empty table gives an empty file set.
    """
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("block", pa.int32()),
            ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("n_ids", pa.int64()),
            ("ranked", pa.binary()),
            ("control", pa.binary()),
            ("data", pa.binary()),
        ]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, tool = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size, end = 0, np.array([end_id], dtype=np.uint32)

        def block() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            row = (part, number, doc_ids, lengths, sum(lengths), *encode_ids(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)

        for own, texts in _grouped(batches):
            for doc_id, encoded in zip(own, tool.encode(texts), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([encoded, end]))
                size += len(ids[-1])
                if size >= block_ids:
                    yield block()
                    number, size = number + 1, 0
                    doc_ids, ids = [], []
        if doc_ids:
            yield block()

    ship(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (
        docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(blocks, BLOCKS)
        .write.parquet(path)
    )


def decode_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: per document doc_id, start, n_tokens, ids_crc32 and its place (part, block, place).

    ``start`` counts the ids of all documents before it: those of earlier parts (one row a part in
    one window), of earlier blocks of its part, and of earlier documents of its block.
    """
    ship(spark)
    files = spark.read.schema(BLOCKS).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["n_ids"], row["ranked"], row["control"], row["data"]).astype("<u4")
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(range(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "block", "place", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    sizes = files.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    block_before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("blocks_before", F.coalesce(F.sum("n_ids").over(block_before), F.lit(0)))
        .join(parts.withColumn("parts_before", F.coalesce(F.sum("n").over(all_before), F.lit(0))), "part")
        .select("part", "block", (F.col("parts_before") + F.col("blocks_before")).alias("block_start"))
    )
    return (
        files.mapInArrow(documents, DECODED)
        .join(starts, ["part", "block"])
        .select(
            "doc_id",
            (F.col("block_start") + F.col("before")).alias("start"),
            "n_tokens",
            "ids_crc32",
            "part",
            "block",
            "place",
        )
    )
