"""Scores of a smoothed trigram model, read as a weighted automaton with failure arcs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import ship, written
from gridrisk.llm.exchange import RUNS, dealt, planes, run_table, runs, texts_of, unpacked_run, unplaned

#: Bytes of text in one chunk, and of text whose keys one range takes.
CHUNK_BYTES, RANGE_BYTES = 4_000_000, 12_000_000
#: Added to every word's count in the unigram model.
ADDED = 0.1
#: Strength of the shorter history below a bigram and a trigram count, in tokens.
STRENGTHS = (200.0, 100.0)
#: Training tokens from which on a history of two words is a state of its own.
LEAST_HISTORY = 20
#: One document in so many is held out.
HELD_OUT = 10
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Bits of a key that count.
KEY_BITS = np.uint64(0xFFFFFFFFFFFFFF00)

ANSWER = "chunk int, kind int, range int, counts binary, types bigint, tokens bigint"
SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


class Words(dict):
    """Numbers of a chunk's words; 0 is the start, 1 the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _distinct(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of n-grams and how many of each are from training texts, which a spare bit says."""
    marked = grams & KEY_BITS
    marked |= train
    marked.sort()
    keys = marked & KEY_BITS
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    counts = np.add.reduceat(marked & np.uint64(1), new) if len(new) else np.empty(0)
    return keys[new], counts.astype(np.uint32)


class TokenChunk:
    """The tokens of some documents, one after the other, with the distinct words and pairs.

    ``keys[n]`` are the sorted keys of the n-grams, ``counts[n]`` their counts in training texts.
    """

    def __init__(self, texts: list[bytes], train: np.ndarray):
        words = Words()
        get, parts = words.__getitem__, []
        for text in texts:
            own = text.lower().split()
            parts.append(np.fromiter(map(get, own), dtype=np.int32, count=len(own)))
        self.lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        numbers = np.ones(int(self.ends[-1]), dtype=np.int32)
        for end, part in zip(self.ends, parts, strict=True):
            numbers[end - 1 - len(part) : end - 1] = part
        hashed = np.array([START, END, *map(xxhash.xxh3_64_intdigest, words)], dtype=np.uint64)
        self.words = hashed[numbers]
        self.train = np.repeat(train.astype(np.uint64), self.lengths)
        self.pairs = np.concatenate([hashed[:1], self.words[:-1]])
        self.pairs[self.begins] = START
        self.pairs = _mixed(self.pairs, self.words)
        # Words are few, so their keys are sorted by word and not by token.
        own_keys, rank = np.unique(hashed[1:] & KEY_BITS, return_inverse=True)
        self.word_place = rank.astype(np.int32)[numbers - 1]
        word_counts = np.bincount(self.word_place, weights=self.train, minlength=len(own_keys)).astype(np.uint32)
        self.keys, self.counts = {1: own_keys}, {1: word_counts}
        self.keys[2], self.counts[2] = _distinct(self.pairs, self.train)

    def pair_place(self) -> np.ndarray:
        return np.searchsorted(self.keys[2], self.pairs & KEY_BITS)

    def add_trigrams(self, counts: np.ndarray, least: int) -> None:
        """The tokens whose two words before, by total ``counts`` of the pairs, are a state, and the trigrams that end there."""
        frequent = self.keys[2][counts >= least]
        self.after_state = np.empty(0, dtype=np.int64)
        if len(frequent):
            before = np.concatenate([self.pairs[:1], self.pairs[:-1]]) & KEY_BITS
            at = np.searchsorted(frequent, before)
            at[at == len(frequent)] = 0
            known = frequent[at] == before
            known[self.begins] = False
            self.after_state = np.flatnonzero(known)
        self.trigrams = _mixed(self.pairs[self.after_state - 1], self.words[self.after_state])
        self.keys[3], self.counts[3] = _distinct(self.trigrams, self.train[self.after_state])


class BackoffAutomaton:
    """States: the root, every word seen in training, and every pair seen ``least_history`` times or more.

    The arcs of a state are the words seen after its history; its failure arc leads to the state of
    the history without its first word, and from a history of one word to the root, whose arcs are
    all words. Arc weights are log10 p of (c(gw) + s p'(w)) / (c(g) + s), with p' of the state
    behind the failure arc, which itself weighs log10 of s / (c(g) + s); so the weights out of a
    state sum to one. At the root p is (c(w) + 0.1) / (N + 0.1 (V + 1)).
    """

    def __init__(self, counts: dict[int, np.ndarray], documents: int, tokens: int, types: int):
        self.counts, self.documents = counts, documents
        self.total = tokens + ADDED * (types + 1)

    def root_arcs(self, place: np.ndarray) -> np.ndarray:
        return np.log10((self.counts[1][place] + ADDED) / self.total)

    def traverse(self, chunk: TokenChunk) -> np.ndarray:
        """The weight of every step of one pass from the left over the texts of a chunk.

        The state carried to a token is that of the longest history that is a state, where the arc
        for the token before it led. A step takes the arc for its word, or else failure arcs until a
        state has one; what lies behind them is found for all tokens at once, level by level.
        """
        s2, s3 = STRENGTHS
        root, place = self.root_arcs(chunk.word_place), chunk.pair_place()
        one = np.concatenate([[0.0], self.counts[1][chunk.word_place[:-1]]])
        one[chunk.begins] = self.documents
        arc = self.counts[2][place]
        failed = np.where(one > 0, np.log10(s2 / (one + s2)), 0.0)
        steps = np.where(arc > 0, np.log10((arc + s2 * 10.0**root) / (one + s2)), failed + root)
        at = chunk.after_state
        two, below = self.counts[2][place[at - 1]], steps[at]
        arc = self.counts[3][np.searchsorted(chunk.keys[3], chunk.trigrams & KEY_BITS)]
        failed = np.log10(s3 / (two + s3))
        steps[at] = np.where(arc > 0, np.log10((arc + s3 * 10.0**below) / (two + s3)), failed + below)
        return steps


def lm_scores(
    docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES, least_history: int = LEAST_HISTORY
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. The model learns
    from all documents whose crc32(doc_id as text) mod 10 is not 0. base_score is the log10
    probability of the unigram model with 0.1 added, score that of the trigram automaton above it.

    A null or empty text is its end token. A row with a null doc_id counts as training. Repeated
    rows count and are scored each. An empty table gives an empty result; without training rows
    every word is unknown. Other columns are not read.

    Texts are dealt by hash into chunks of about ``chunk_bytes``. A chunk sends its distinct words
    and pairs (56-bit keys, sorted) with their training counts to key ranges, whose number follows
    the amount of text; a range adds up the counts of its keys over all chunks and answers each chunk
    in the order of its keys. A second round does the same for the trigrams behind pairs that are
    states. A very common n-gram is one key per chunk. Each chunk then has the part of the automaton
    that its own texts can reach, and is traversed. The counts cover the whole corpus, and no model
    passes the driver: it gets four sums.
    """
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % HELD_OUT == 0, F.lit(False))
    text_bytes, documents = docs.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~held)
    ).first()
    chunks, ranges = max(1, -(-text_bytes // chunk_bytes)), max(1, -(-text_bytes // range_bytes))
    texts = dealt(docs.select("doc_id", "text", held.alias("held_out")), chunks, "held_out")

    def read(table: pa.Table) -> TokenChunk:
        return TokenChunk(texts_of(table), ~np.array(table.column("held_out").to_pylist()))

    def sent(own: TokenChunk, chunk: int, orders: tuple[int, ...]) -> pa.Table:
        rows = []
        for n in orders:
            counts = own.counts[n]
            rows += runs(chunk, n, own.keys[n], ranges, lambda a, b, counts=counts: planes(counts[a:b]))
        return run_table(rows)

    def ask(table: pa.Table) -> pa.Table:
        return sent(read(table), table.column("chunk")[0].as_py(), (1, 2))

    def told(replies: pa.Table) -> dict[int, np.ndarray]:
        got = zip(*(replies.column(c).to_pylist() for c in ("kind", "range", "counts")), strict=True)
        parts: dict[int, list[np.ndarray]] = {n: [np.empty(0)] for n in (1, 2, 3)}
        for kind, _, raw in sorted(got, key=lambda x: x[:2]):
            parts[kind].append(unplaned(raw, len(raw) // 8).astype(np.float64))
        return {n: np.concatenate(x) for n, x in parts.items()}

    def ask_more(own_texts: pa.Table, replies: pa.Table) -> pa.Table:
        own = read(own_texts)
        own.add_trigrams(told(replies)[2], least_history)
        return sent(own, own_texts.column("chunk")[0].as_py(), (3,))

    def answer(table: pa.Table) -> pa.Table:
        kind, r = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
        keys = [unpacked_run(k) for k in table.column("keys").to_pylist()]
        lengths = [len(k) for k in keys]
        counts = [unplaned(x, n, np.uint32) for x, n in zip(table.column("extra").to_pylist(), lengths, strict=True)]
        key = np.concatenate(keys)
        del keys
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        totals = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), new)
        own = np.empty(len(key), dtype=np.uint64)
        own[order] = np.repeat(totals, np.diff(np.append(new, len(order)))).astype(np.uint64)
        ends, n = np.cumsum(lengths), len(lengths) + 1
        replies = [planes(own[e - k : e]) for e, k in zip(ends, lengths, strict=True)]
        words = kind == 1
        return pa.table(
            {
                # The last row, of no chunk, has the range's share of types and tokens.
                "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int32()),
                "kind": pa.array([kind] * n, pa.int32()),
                "range": pa.array([r] * n, pa.int32()),
                "counts": pa.array([*replies, b""], pa.binary()),
                "types": pa.array([0] * (n - 1) + [int((totals > 0).sum()) if words else 0], pa.int64()),
                "tokens": pa.array([0] * (n - 1) + [int(totals.sum()) if words else 0], pa.int64()),
            }
        )

    def answered(asked: DataFrame) -> DataFrame:
        return written(asked.groupBy("kind", "range").applyInArrow(answer, ANSWER), "lm-counts")

    columns = ["chunk", "kind", "range", "counts"]
    answers = answered(texts.groupBy("chunk").applyInArrow(ask, RUNS))
    types, tokens = answers.where("chunk = -1").agg(
        F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))
    ).first()
    short = answers.where("chunk >= 0").select(*columns)
    more = answered(texts.groupBy("chunk").cogroup(short.where("kind = 2").groupBy("chunk")).applyInArrow(ask_more, RUNS))
    every = short.unionByName(more.where("chunk >= 0").select(*columns))

    def score(own_texts: pa.Table, replies: pa.Table) -> pa.Table:
        own, counts = read(own_texts), told(replies)
        own.add_trigrams(counts[2], least_history)
        automaton = BackoffAutomaton(counts, documents, tokens, types)
        begins = own.begins
        steps = automaton.traverse(own)
        known = (counts[1] > 0)[own.word_place].astype(np.int64)
        n = len(own.lengths)
        return pa.table(
            {
                "doc_id": own_texts.column("doc_id"),
                "held_out": own_texts.column("held_out"),
                "n_tokens": pa.array(own.lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known, begins), pa.int64()),
                "train_tokens": pa.array([tokens] * n, pa.int64()),
                "base_score": pa.array(np.add.reduceat(automaton.root_arcs(own.word_place), begins), pa.float64()),
                "score": pa.array(np.add.reduceat(steps, begins), pa.float64()),
            }
        )

    return texts.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(score, SCORED)
