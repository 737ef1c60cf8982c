"""Phrase collocations: n-gram counts as weighted acyclic automata, united by prefix range."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import ship, written
from gridrisk.llm.exchange import (
    RUNS,
    answers_of,
    dealt,
    planes,
    run_table,
    runs,
    text_bytes,
    texts_of,
    unpacked_run,
    unplaned,
)

#: Least occurrences of a phrase, its most words, and phrases reported for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A candidate goes if a longer one around it has at least this share of its occurrences, in percent.
PERCENT = 100
#: Bytes of text in a chunk, and of text whose n-grams one range takes.
CHUNK_BYTES, RANGE_BYTES = 8_000_000, 20_000_000
UNKNOWN = "und"

WORDS, PAIRS = 1, 2
AUTOMATON, WORD, CUT, TOTAL = 1, 2, 3, 4
BITS = np.uint64(32)
LABEL = np.uint64((1 << 32) - 1)
#: Stops and line ends become line feeds, tabs blanks.
MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")

SENT = "kind int, range int, data binary, lang string, n bigint"
UNITED = (
    "kind int, range int, data binary, lang string, n bigint, word string, code bigint, words array<bigint>, k int, "
    "first array<bigint>, first_range int, rest array<bigint>, rest_range int"
)


def prefix_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The place of a prefix of two words in the order that ranges cut."""
    out = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.searchsorted(edges, keys, side="right").astype(np.int64)


class Vocabulary(dict):
    """Numbers of one language's words; all languages of a shard share the list of words."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b"": -2, b"\n": -1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append((self.lang, word))
        return number


class Shard:
    """The words of some documents by number, with -1 between pieces."""

    def __init__(self, langs: list[str | None], texts: list[bytes]):
        self.words: list[tuple[str, bytes]] = []
        own: dict[str, Vocabulary] = {}
        parts, end = [], np.array([-1], dtype=np.int32)
        for lang, text in zip(langs, texts, strict=True):
            name = UNKNOWN if lang is None else lang
            get = own.setdefault(name, Vocabulary(name, self.words)).__getitem__
            raw = text.lower().translate(MARKS).replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(get, raw), dtype=np.int32, count=len(raw))
            parts += [numbers[numbers >= -1], end]
        self.tokens = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        self.counts = np.bincount(self.tokens[self.tokens >= 0], minlength=len(self.words))
        self.codes = np.array(
            [xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh3_64_intdigest(lang.encode())) for lang, word in self.words],
            dtype=np.uint64,
        )
        # Where a word has another one behind it in its piece.
        self.at = np.flatnonzero((self.tokens[:-1] >= 0) & (self.tokens[1:] >= 0))

    def pair_keys(self) -> np.ndarray:
        return prefix_key(self.codes[self.tokens[self.at]], self.codes[self.tokens[self.at + 1]])


class Transducer:
    """A deterministic acyclic automaton over words that gives each n-gram its count.

    ``codes`` are the labels of the arcs from the root, in order; ``weights[0]`` their counts.
    Level n (from 2) has the states behind n words as sorted keys (state before, label) and their
    counts. States are numbered by their place.
    """

    def __init__(self, codes: np.ndarray, weights: list[np.ndarray], keys: list[np.ndarray]):
        self.codes, self.weights, self.keys = codes, weights, keys

    @classmethod
    def of_shard(cls, shard: Shard, known: np.ndarray, allowed: np.ndarray, longest: int) -> Transducer:
        """Built from the shard's n-grams, a word at a time in sorted order.

        ``known`` marks the words that count, ``allowed`` the positions (of ``shard.at``) whose pair
        may be part of a phrase.
        """
        weights, keys = [np.where(known, shard.counts, 0).astype(np.int64)], []
        tokens = shard.tokens.astype(np.uint64)
        goes_on = np.zeros(len(tokens) + longest, dtype=bool)
        goes_on[shard.at[allowed]] = True
        at = shard.at[allowed]
        state = tokens[at]
        for n in range(2, longest + 1):
            key, state, count = np.unique(state << BITS | tokens[at + n - 1], return_inverse=True, return_counts=True)
            keys.append(key)
            weights.append(count.astype(np.int64))
            more = goes_on[at + n - 1]
            at, state = at[more], state[more].astype(np.uint64)
        return cls(shard.codes, weights, keys)

    def by_range(self, ranges: int) -> list[tuple[int, Transducer, np.ndarray]]:
        """The parts of the automaton below the prefixes of each range, and the words that their labels are."""
        first = self.keys[0]
        where = range_of(prefix_key(self.codes[first >> BITS], self.codes[first & LABEL]), ranges)
        own_range = range_of(self.codes, ranges)
        counted = np.flatnonzero(self.weights[0] > 0)
        levels = []
        for n, key in enumerate(self.keys):
            if n:
                where = where[key >> BITS]
            order = np.argsort(where, kind="stable")
            begins = np.searchsorted(where[order], np.arange(ranges + 1))
            rank = np.empty(len(order), dtype=np.uint64)
            rank[order] = np.arange(len(order)) - begins[where[order]]
            levels.append((key[order], self.weights[n + 1][order], begins, rank))
        roots = counted[np.argsort(own_range[counted], kind="stable")]
        root_begins = np.searchsorted(own_range[roots], np.arange(ranges + 1))
        out = []
        for r in range(ranges):
            here = [(key[b[r] : b[r + 1]], weight[b[r] : b[r + 1]]) for key, weight, b, _ in levels]
            mine = roots[root_begins[r] : root_begins[r + 1]]
            labels = [k & LABEL for k, _ in here] + [here[0][0] >> BITS, mine.astype(np.uint64)]
            used = np.unique(np.concatenate(labels)).astype(np.int64)
            if not len(used):
                continue
            keys = []
            for n, (key, _) in enumerate(here):
                before = key >> BITS
                before = levels[n - 1][3][before] if n else np.searchsorted(used, before.astype(np.int64)).astype(np.uint64)
                keys.append(before << BITS | np.searchsorted(used, (key & LABEL).astype(np.int64)).astype(np.uint64))
            counts = np.zeros(len(used), dtype=np.int64)
            counts[np.searchsorted(used, mine)] = self.weights[0][mine]
            out.append((r, Transducer(self.codes[used], [counts, *[w for _, w in here]], keys), used))
        return out

    @classmethod
    def union(cls, parts: list[Transducer], longest: int) -> Transducer:
        """All paths of the parts, with the sums of their weights."""
        codes, state = np.unique(np.concatenate([p.codes for p in parts]), return_inverse=True)
        cut = np.cumsum([0] + [len(p.codes) for p in parts])
        label = [state[a:b].astype(np.uint64) for a, b in zip(cut[:-1], cut[1:], strict=True)]

        def summed(of: np.ndarray, values: list[np.ndarray], n: int) -> np.ndarray:
            out = np.zeros(n, dtype=np.int64)
            np.add.at(out, of, np.concatenate(values))
            return out

        weights, keys, before = [summed(state, [p.weights[0] for p in parts], len(codes))], [], label
        for n in range(longest - 1):
            sent = [s[p.keys[n] >> BITS] << BITS | w[p.keys[n] & LABEL] for p, s, w in zip(parts, before, label, strict=True)]
            key, state = np.unique(np.concatenate(sent), return_inverse=True)
            weights.append(summed(state, [p.weights[n + 1] for p in parts], len(key)))
            keys.append(key)
            cut = np.cumsum([0] + [len(s) for s in sent])
            before = [state[a:b].astype(np.uint64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return cls(codes, weights, keys)

    def pruned(self, least: int) -> Transducer:
        """Without n-grams of two words and more that are rarer than ``least``; what follows one is as rare."""
        weights, keys, kept, rank = [self.weights[0]], [], np.ones(len(self.codes), dtype=bool), np.arange(len(self.codes))
        for n, key in enumerate(self.keys):
            stay = (self.weights[n + 1] >= least) & kept[key >> BITS]
            keys.append(rank[key[stay] >> BITS].astype(np.uint64) << BITS | key[stay] & LABEL)
            weights.append(self.weights[n + 1][stay])
            kept, rank = stay, np.cumsum(stay) - 1
        return Transducer(self.codes, weights, keys)

    def paths(self, n: int) -> np.ndarray:
        """The words of the states of level ``n``, one row each."""
        columns, state = [], np.arange(len(self.keys[n - 2]))
        for key in reversed(self.keys[: n - 1]):
            columns.append(self.codes[key[state] & LABEL])
            state = (key[state] >> BITS).astype(np.int64)
        return np.stack([self.codes[state], *reversed(columns)], axis=1)

    def composed(self, phrases: list[np.ndarray]) -> np.ndarray:
        """The weights of phrases: all walk the automaton side by side, a word a step; 0 where there is no path."""
        lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        out, state = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.uint64)
        alive = np.ones(len(phrases), dtype=bool)
        for n in range(int(lengths.max(initial=0))):
            here = np.flatnonzero(alive & (lengths > n))
            word = np.array([phrases[i][n] for i in here], dtype=np.int64).view(np.uint64)
            label = np.searchsorted(self.codes, word)
            found = label < len(self.codes)
            found[found] = self.codes[label[found]] == word[found]
            if n:
                key = state[here] << BITS | label.astype(np.uint64)
                label = np.searchsorted(self.keys[n - 1], key)
                found &= label < len(self.keys[n - 1])
                found[found] = self.keys[n - 1][label[found]] == key[found]
            state[here[found]] = label[found].astype(np.uint64)
            alive[here[~found]] = False
            done = here[found & (lengths[here] == n + 1)]
            out[done] = self.weights[n][state[done].astype(np.int64)]
        return out

    def dumped(self, *more) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((self.codes, self.weights, self.keys, *more), protocol=5))

    @classmethod
    def loaded(cls, raw: bytes) -> tuple[Transducer, tuple]:
        codes, weights, keys, *more = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
        return cls(codes, weights, keys), tuple(more)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def _table(columns: dict[str, object], n: int) -> pa.Table:
    """Rows of ``UNITED``; columns that are not given are null."""
    ints, longs = pa.int32(), pa.int64()
    kinds = {
        "kind": ints, "range": ints, "data": pa.binary(), "lang": pa.string(), "n": longs, "word": pa.string(), "code": longs,
        "words": pa.list_(longs), "k": ints, "first": pa.list_(longs), "first_range": ints, "rest": pa.list_(longs),
        "rest_range": ints,
    }
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()})


def _part_ranges(part: np.ndarray, ranges: int) -> np.ndarray:
    return range_of(part[:, 0] if part.shape[1] == 1 else prefix_key(part[:, 0], part[:, 1]), ranges)


def frequent_phrases(docs: DataFrame, least: int, longest: int, chunk_bytes: int, range_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (code, lang, word), words a language (lang, n), cuts of phrases, and the weights of their parts.

    Round one counts words and pairs by key; a phrase that is frequent is made of frequent ones, so
    every shard is told which of its own may matter. Round two builds each shard's automaton of
    what is left, cuts it by prefix range, and unites and sums the parts of each range. The parts of
    the frequent phrases are then looked up by composition with the automaton of their own range.
    """
    size = text_bytes(docs)
    chunks, ranges = max(1, -(-size // chunk_bytes)), max(1, -(-size // range_bytes))
    texts = dealt(docs, chunks, "lang")

    def read(table: pa.Table) -> Shard:
        return Shard(table.column("lang").to_pylist(), texts_of(table))

    def ask(table: pa.Table) -> pa.Table:
        own, chunk, rows = read(table), table.column("chunk")[0].as_py(), []
        order = np.argsort(own.codes)
        words = own.codes[order], own.counts[order]
        for kind, (keys, counts) in ((WORDS, words), (PAIRS, np.unique(own.pair_keys(), return_counts=True))):
            packed = counts.astype(np.uint32)
            rows += runs(chunk, kind, keys, ranges, lambda a, b, packed=packed: planes(packed[a:b]))
        return run_table(rows)

    def answer(table: pa.Table) -> pa.Table:
        kind, r = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
        keys = [unpacked_run(k) for k in table.column("keys").to_pylist()]
        counts = [unplaned(x, len(k), np.uint32) for x, k in zip(table.column("extra").to_pylist(), keys, strict=True)]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        totals = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), new)
        reply = np.empty(len(key), dtype=np.uint8)
        reply[order] = np.repeat((totals >= least).astype(np.uint8), np.diff(np.append(new, len(order))))
        ends = np.cumsum([len(k) for k in keys])
        chunk_of = table.column("chunk").to_pylist()
        return run_table(
            [(c, kind, r, b"", reply[e - len(k) : e].tobytes()) for c, e, k in zip(chunk_of, ends, keys, strict=True)]
        )

    def build(own_texts: pa.Table, replies: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if len(own_texts):
            own, chunk = read(own_texts), own_texts.column("chunk")[0].as_py()
            got = {k: np.frombuffer(v, dtype=np.uint8) > 0 for k, v in answers_of(replies).items()}
            known = np.zeros(len(own.codes), dtype=bool)
            known[np.argsort(own.codes)] = got.get(WORDS, known)
            keys = own.pair_keys()
            frequent = np.unique(keys)[got[PAIRS]] if PAIRS in got else keys[:0]
            at = np.searchsorted(frequent, keys)
            at[at == len(frequent)] = 0
            allowed = frequent[at] == keys if len(frequent) else np.zeros(len(keys), dtype=bool)
            rows = [
                (AUTOMATON, r, part.dumped([own.words[w] if known[w] else None for w in used]), None, None)
                for r, part, used in Transducer.of_shard(own, known, allowed, longest).by_range(ranges)
            ]
            totals: dict[str, int] = {}
            for (lang, _), count in zip(own.words, own.counts.tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + count
            rows += [(TOTAL, chunk % ranges, None, lang, n) for lang, n in totals.items()]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else columns
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64()]
        names = ["kind", "range", "data", "lang", "n"]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, columns, kinds, strict=True)})

    def unite(table: pa.Table) -> pa.Table:
        kind, r = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
        if kind == TOTAL:
            sums = table.group_by("lang").aggregate([("n", "sum")])
            return _table({"kind": [TOTAL] * len(sums), "lang": sums.column("lang").to_pylist(), "n": sums.column("n_sum").to_pylist()}, len(sums))
        sent = [Transducer.loaded(raw) for raw in table.column("data").to_pylist()]
        whole = Transducer.union([t for t, _ in sent], longest).pruned(least)
        names = {code: own for t, (labels,) in sent for code, own in zip(t.codes.tolist(), labels, strict=True) if own}
        out = [_table({"kind": [AUTOMATON], "range": [r], "data": [whole.dumped()]}, 1)]
        mine = np.flatnonzero(whole.weights[0] > 0)
        words = [names[c] for c in whole.codes[mine].tolist()]
        out.append(
            _table(
                {
                    "kind": [WORD] * len(mine),
                    "code": whole.codes[mine].view(np.int64),
                    "lang": [w[0] for w in words],
                    "word": [w[1].decode() for w in words],
                },
                len(mine),
            )
        )
        for n in range(2, longest + 1):
            paths = whole.paths(n)
            for k in range(1, n):
                first, rest = paths[:, :k], paths[:, k:]
                out.append(
                    _table(
                        {
                            "kind": np.full(len(paths), CUT, dtype=np.int32),
                            "words": _lists(paths),
                            "n": whole.weights[n - 1],
                            "k": np.full(len(paths), k, dtype=np.int32),
                            "first": _lists(first),
                            "first_range": _part_ranges(first, ranges).astype(np.int32),
                            "rest": _lists(rest),
                            "rest_range": _part_ranges(rest, ranges).astype(np.int32),
                        },
                        len(paths),
                    )
                )
        return pa.concat_tables(out)

    def compose(parts: pa.Table, automata: pa.Table) -> pa.Table:
        phrases = parts.column("part").to_pylist()
        weights = np.zeros(len(phrases), dtype=np.int64)
        if len(automata):
            weights = Transducer.loaded(automata.column("data")[0].as_py())[0].composed(phrases)
        return pa.table({"part": pa.array(phrases, pa.list_(pa.int64())), "weight": pa.array(weights, pa.int64())})

    known = written(texts.groupBy("chunk").applyInArrow(ask, RUNS).groupBy("kind", "range").applyInArrow(answer, RUNS), "phrase-keys")
    built = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(build, SENT)
    united = written(built.groupBy("kind", "range").applyInArrow(unite, UNITED), "phrase-automata")
    cuts = united.where(F.col("kind") == CUT).select("words", F.col("n").alias("a"), "k", "first", "first_range", "rest", "rest_range")
    parts = (
        cuts.select(F.col("first").alias("part"), F.col("first_range").alias("range"))
        .unionByName(cuts.select(F.col("rest").alias("part"), F.col("rest_range").alias("range")))
        .distinct()
    )
    automata = united.where(F.col("kind") == AUTOMATON).select("range", "data")
    weights = parts.groupBy("range").cogroup(automata.groupBy("range")).applyInArrow(compose, "part array<bigint>, weight bigint")
    words = united.where(F.col("kind") == WORD).select("code", "lang", "word")
    totals = united.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    return words, totals, cuts.select("words", "a", "k", "first", "rest"), weights


def _whole(count: Column) -> Column:
    return count.cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    percent: int = PERCENT,
    top: int = TOP,
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces and those at
    blanks and tabs into words. Counts are of all occurrences in the language, overlaps included.
    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times or more. A cut into
    first words (l times) and the rest (r times) scores floor(1000 a n / (l r)) with a the phrase's
    count and n all words of the language; the cut of the least score counts, of equals the one
    after fewer words. A candidate inside a longer one with ``percent`` of its occurrences goes. The
    order is score and a falling, then the phrase by its UTF-8 bytes. Products are exact to 38 digits.

    A null text has no words, a null lang is ``und``. Repeated rows count each time; a doc_id only
    helps to deal rows out and may be null or repeated. An empty table, or one without a phrase
    that is frequent enough, gives an empty result. Other columns are not read.

    A word or phrase in every document is one entry a shard, not one an occurrence. Words are
    compared by 64-bit codes; the counts of round one only decide what round two counts exactly.
    """
    ship(docs.sparkSession)
    words, totals, cuts, weights = frequent_phrases(docs, least, longest, chunk_bytes, range_bytes)
    weights = written(weights, "phrase-parts")
    first = weights.select(F.col("part").alias("first"), F.col("weight").alias("l"))
    rest = weights.select(F.col("part").alias("rest"), F.col("weight").alias("r"))
    lang_of = words.select(F.col("code"), "lang").join(totals, "lang")
    met = cuts.join(first, "first").join(rest, "rest").join(lang_of, F.col("words")[0] == F.col("code"))
    score = F.expr("(1000 * whole_a * whole_n) div (whole_l * whole_r)")
    scored = (
        met.withColumns({f"whole_{c}": _whole(F.col(c)) for c in "anlr"})
        .groupBy("lang", "n", "words", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    )
    scored = written(scored, "phrase-scores")
    inside = scored.where(F.size("words") > 2).select(
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), b -> slice(words, b, m))))"
            )
        ).alias("words"),
        F.col("a").alias("longer"),
    )
    around = inside.groupBy("words").agg(F.max("longer").alias("longer"))
    left = scored.join(around, "words", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    spelled = (
        left.select("lang", "n", "words", "a", "best", F.posexplode("words").alias("pos", "code"))
        .join(words.select("code", "word"), "code")
        .groupBy("lang", "n", "words", "a", "best")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("own"))
        .select("lang", "n", "a", "best.*", F.array_join(F.col("own.word"), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        spelled.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
