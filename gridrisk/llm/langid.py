"""Language ID: a byte convolutional network, trained in numpy on labelled windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import packed, ship

#: Bytes of a window; the last one of a text is filled up with blanks.
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8
#: The training sample: so many labelled documents of each language, so many windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
#: Documents of the whole sample, and languages that the network can tell apart: the most frequent ones.
SAMPLE_TOTAL, LANGUAGES = 20_000, 1_000
EPOCHS, BATCH, RATE = 12, 64, 0.02
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
GUESS = "lang_pred string, score double"


def windows_of(text: str) -> np.ndarray:
    """The whole text, lower-cased, as UTF-8 in rows of ``WINDOW`` bytes."""
    raw = text.lower().encode()
    return np.frombuffer(raw.ljust(-(-len(raw) // WINDOW) * WINDOW), dtype=np.uint8).reshape(-1, WINDOW)


@dataclass
class ByteNet:
    """Filters of each width as tables (offset, byte, filter), then max pooling and a softmax layer."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteNet:
        n = len(WIDTHS) * FILTERS
        return cls(
            languages,
            {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.zeros(n, dtype=np.float32),
            rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
            np.zeros(len(languages), dtype=np.float32),
        )

    def responses(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """(window, position, filter) of each width."""
        for w in WIDTHS:
            last = WINDOW - w + 1
            yield sum(self.filters[w][k][windows[:, k : k + last]] for k in range(w))

    def train(self, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross-entropy; only the positions that win the pooling get a gradient."""
        params = [*(self.filters[w] for w in WIDTHS), self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                x, n = windows[own], len(own)
                best, pooled = [], []
                for r in self.responses(x):
                    best.append(r.argmax(axis=1))
                    pooled.append(np.take_along_axis(r, best[-1][:, None], axis=1)[:, 0])
                h = np.concatenate(pooled, axis=1) + self.bias
                active = np.maximum(h, 0)
                logits = active @ self.dense + self.offset
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), labels[own]] -= 1
                p /= n
                back = (p @ self.dense.T) * (h > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g, part = np.zeros_like(self.filters[w]), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        bytes_ = np.take_along_axis(x, best[i] + k, axis=1)
                        np.add.at(g[k], (bytes_, np.arange(FILTERS)[None]), part)
                    grads.append(g)
                grads += [back.sum(axis=0), active.T @ p, p.sum(axis=0)]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for value, g, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    value -= rate * a / (np.sqrt(b) + 1e-8)

    def folded(self) -> list[tuple[list[np.ndarray], list[int]]]:
        """For each width the tables to look up by two bytes (and one, if odd), and their offsets."""
        out = []
        for w in WIDTHS:
            tables, offsets = [], []
            for k in range(0, w, 2):
                if k + 1 < w:
                    pair = self.filters[w][k][:, None] + self.filters[w][k + 1][None, :]
                    tables.append(np.ascontiguousarray(pair.reshape(65536, FILTERS)))
                else:
                    tables.append(np.ascontiguousarray(self.filters[w][k]))
                offsets.append(k)
            out.append((tables, offsets))
        return out

    def log_probabilities(self, windows: np.ndarray, folded: list) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), dtype=np.float64)
        for at in range(0, len(windows), 256):
            x = windows[at : at + 256]
            pairs = (x[:, :-1].astype(np.int64) << 8) | x[:, 1:]
            pooled = []
            for w, (tables, offsets) in zip(WIDTHS, folded, strict=True):
                last, r = WINDOW - w + 1, None
                for table, k in zip(tables, offsets, strict=True):
                    part = table.take((pairs if len(table) > 256 else x)[:, k : k + last], axis=0)
                    r = part if r is None else np.add(r, part, out=r)
                pooled.append(r.max(axis=1))
            logits = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.dense + self.offset
            logits = logits.astype(np.float64) - logits.max(axis=1, keepdims=True)
            out[at : at + 256] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def training_mask(doc_id: Column) -> Column:
    """True for documents to learn from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def train_network(docs: DataFrame, seed: int = 11) -> ByteNet | None:
    """A network of the labelled languages, or None where nothing is labelled.

    The sample is bounded: of each of the ``LANGUAGES`` most frequent languages (of equals the first
    by name) the ``SAMPLE_DOCS`` documents that come first by a hash of their doc_id, fewer where
    there are many languages, so that there are ``SAMPLE_TOTAL`` in all at most; of each document
    ``SAMPLE_WINDOWS`` pieces spread over the whole text.
    """
    own = docs.select(docs["doc_id"], docs["text"], docs["lang"]).where(
        training_mask(docs["doc_id"]) & docs["lang"].isNotNull() & docs["text"].rlike(r"\p{L}")
    )
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    quota = min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts))
    # Four times the sample passes by hash, so a common language sends no more rows to its task than a rare one.
    listed = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 4.0 * quota / r["count"])])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    step = F.greatest(F.lit(0), F.length("text") - WINDOW) / max(1, SAMPLE_WINDOWS - 1)
    pieces = F.array_distinct(
        F.array(*[F.substring("text", (step * k).cast("int") + 1, F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)])
    )
    likely = own.where(place < F.try_element_at(listed, F.col("lang")))
    slim = likely.select("lang", "doc_id", place.alias("place"), F.xxhash64("text").alias("t"), pieces.alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "t"))
    sample = slim.withColumn("n", rank).where(F.col("n") <= quota).select("lang", "n", "pieces").collect()
    sample.sort(key=lambda r: (r["lang"], r["n"]))
    languages = sorted({r["lang"] for r in sample})
    windows, labels = [], []
    for r in sample:
        for piece in r["pieces"]:
            windows.append(windows_of(piece)[:1] if piece else np.full((1, WINDOW), 32, dtype=np.uint8))
            labels.append(languages.index(r["lang"]))
    rng = np.random.default_rng(seed)
    net = ByteNet.fresh(languages, rng)
    net.train(np.concatenate(windows), np.array(labels), rng)
    return net


def guess_udf(shared):
    @F.pandas_udf(GUESS)
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net: ByteNet | None = shared.value
        folded = net.folded() if net else None
        for texts in parts:
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at, size, rows = [], 0, []

            def settle(at, rows, names=names, scores=scores):
                counts = np.array([len(r) for r in rows])
                logs = net.log_probabilities(np.concatenate(rows), folded)
                means = np.add.reduceat(logs, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                p = np.exp(means - means.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, best, value in zip(at, p.argmax(axis=1), p.max(axis=1), strict=True):
                    names[i], scores[i] = net.languages[best], float(value)

            for i, text in enumerate(texts):
                if net and text and LETTER.search(text):
                    at.append(i)
                    rows.append(windows_of(text))
                    size += len(rows[-1])
                    if size >= 8192:
                        settle(at, rows)
                        at, size, rows = [], 0, []
            if rows:
                settle(at, rows)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    # Spark would judge each text again, in a second worker beside the first, for a filter on the language.
    return guess.asNondeterministic()


def identify_language(docs: DataFrame, learn_from: DataFrame | None = None, network: ByteNet | None = None) -> DataFrame:
    """``docs`` with ``language``: struct of lang_pred and score.

    The network, unless it is given, learns from the labelled documents of ``learn_from`` (by default
    ``docs``) whose crc32(doc_id as text) mod 3 is not 1. A prediction sees the text alone: the mean log
    probabilities of its windows, made to sum to one; lang_pred is the largest, score its value.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing is
    labelled. Repeated rows are judged alike and kept, long texts are judged window by window over
    their whole length. An extra column called ``language`` is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network or train_network(docs if learn_from is None else learn_from))
    return docs.select(packed(docs, "language").alias("row")).select(
        "row.*", guess_udf(shared)("row.text").alias("language")
    )
