"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import packed, written

#: The weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated three times at most.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block and of an output shard.
BLOCK_WORDS = 500_000
SHARD_WORDS = 50_000_000
#: Words that are ordered together in one task.
BUCKET_WORDS = 1_000_000
#: Files of an output shard: ranges of the order inside it, so that one task writes no whole shard.
SHARD_FILES = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    The targets share the whole size by weight. A target above ``repeats`` times its source stops
    there and the excess goes to the others by weight, until none is above: with the sources in the
    order of cap over weight, each has the level at which it and all after it would share what the
    caps before it leave; that level rises while caps bind and falls after, so the highest holds.
    One row per source passes through the two windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).alias("weight"),
        (F.col("source_size") * repeats).alias("cap"),
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(after)
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source",
            "source_size",
            F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"),
        )
    )


def _draw(rest: str, own: str, want: str, uniform: str) -> str:
    """SQL: a hypergeometric draw, the number of ``own`` blocks among ``want`` taken from ``rest``.

    Inversion over the support within twelve standard deviations of the mode, whose weights follow
    from each other by ratios: upwards from the mode, then downwards.
    """
    ratio = (
        f"(({own} - {{x}}) * ({want} - {{x}}) / CAST(({{x}} + 1) * ({rest} - {own} - {want} + {{x}} + 1) AS DOUBLE))"
    )
    up = f"a.w * IF(x >= s.hi, 0D, {ratio.format(x='x')})"
    down = f"IF(x <= s.lo, 0D, a.w / {ratio.format(x='(x - 1)')})"
    upward, downward = "sequence(s.mode, s.hi)", "sequence(s.mode, s.lo, -1L)"

    def total(walk: str, step: str) -> str:
        return (
            f"aggregate({walk}, named_struct('w', 1D, 'c', 0D), "
            f"(a, x) -> named_struct('w', {step}, 'c', a.c + a.w), a -> a.c)"
        )

    def pick(walk: str, step: str, at: str) -> str:
        return (
            f"aggregate({walk}, named_struct('w', 1D, 'c', 0D, 'v', -1L), "
            f"(a, x) -> named_struct('w', {step}, 'c', a.c + a.w, "
            f"'v', IF(a.v < 0 AND {at} < a.c + a.w, x, a.v)), a -> IF(a.v < 0, s.mode, a.v))"
        )

    low, high = f"greatest(0L, {want} + {own} - {rest})", f"least({want}, {own})"
    mode = f"greatest({low}, least({high}, CAST(floor(({want} + 1D) * ({own} + 1D) / ({rest} + 2D)) AS BIGINT)))"
    reach = (
        f"CAST(12 + ceil(12 * sqrt({want} * 1D * {own} / {rest} * (1 - {own} * 1D / {rest}) "
        f"* ({rest} - {want}) / greatest(1D, {rest} - 1D))) AS BIGINT)"
    )
    span = (
        f"transform(array(named_struct('mode', {mode}, 'reach', {reach})), m -> named_struct('mode', m.mode, "
        f"'lo', greatest({low}, m.mode - m.reach), 'hi', least({high}, m.mode + m.reach)))[0]"
    )
    sums = (
        f"transform(array({span}), s -> named_struct('mode', s.mode, 'lo', s.lo, 'hi', s.hi, "
        f"'up', {total(upward, up)}, 'down', {total(downward, down)}))[0]"
    )
    aim = f"({uniform} * (s.up + s.down - 1))"
    chosen = (
        f"transform(array({sums}), s -> IF({aim} < s.up, {pick(upward, up, aim)}, "
        f"{pick(downward, down, f'({aim} - s.up + 1)')}))[0]"
    )
    return f"IF({own} = 0 OR {want} = 0, 0L, IF({own} = {rest}, {want}, {chosen}))"


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``quotas`` (source, blocks) dealt out: source, shard, blocks; sums by source are exact.

    The tree halves the range of shards. A node holds the block counts of all sources (the sources
    of a mix, one array); its left half gets its even share of the node's blocks, of each source as
    many as a draw without replacement finds, source after source. The draws hang on the seed, the
    node and the source's place alone, so reruns agree.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks")))
    tree = quotas.agg(ordered.alias("sources")).select(
        F.lit(0).cast("bigint").alias("lo"),
        F.lit(shards).cast("bigint").alias("hi"),
        F.transform("sources", lambda s: s["blocks"]).alias("blocks"),
    )
    uniform = f"(pmod(xxhash64({seed}L, lo, hi, size(acc.out)), 9007199254740992L) / 9007199254740992D)"
    step = (
        "(acc, own) -> transform(array(" + _draw("acc.rest", "own", "acc.want", uniform) + "), "
        "x -> named_struct('rest', acc.rest - own, 'want', acc.want - x, 'out', concat(acc.out, array(x))))[0]"
    )
    for _ in range((shards - 1).bit_length()):
        tree = (
            tree.withColumn("mid", F.expr("(lo + hi) DIV 2"))
            .withColumn("all", F.expr("aggregate(blocks, 0L, (a, b) -> a + b)"))
            .withColumn("want", F.expr("CAST(floor(all * ((mid - lo) / CAST(hi - lo AS DOUBLE))) AS BIGINT)"))
            .withColumn(
                "left",
                F.expr(
                    "IF(hi - lo < 2, blocks, aggregate(blocks, named_struct('rest', all, 'want', want, "
                    f"'out', CAST(array() AS ARRAY<BIGINT>)), {step}, acc -> acc.out))"
                ),
            )
            .select(
                F.explode(
                    F.expr(
                        "IF(hi - lo < 2, array(named_struct('lo', lo, 'hi', hi, 'blocks', blocks)), "
                        "array(named_struct('lo', lo, 'hi', mid, 'blocks', left), named_struct('lo', mid, 'hi', hi, "
                        "'blocks', zip_with(blocks, left, (b, l) -> b - l))))"
                    )
                ).alias("n")
            )
            .select("n.*")
        )
    names = quotas.agg(ordered.alias("sources")).select(F.posexplode("sources").alias("place", "s"))
    leaves = tree.select(F.col("lo").alias("shard"), F.posexplode("blocks").alias("place", "blocks"))
    return leaves.join(names, "place").select(F.col("s.source").alias("source"), "shard", leaves["blocks"])


def mix(
    docs: DataFrame,
    carry: tuple[str, ...] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = 17,
) -> DataFrame:
    """The draws of :func:`dealt_mix`."""
    return dealt_mix(docs, carry, weights, repeats, shard_words, block_words, seed)[0]


def dealt_mix(
    docs: DataFrame,
    carry: tuple[str, ...] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = 17,
) -> tuple[DataFrame, int]:
    """Rows of ``docs`` as struct ``row``, with size, source_size, target and one row per draw; and
    the number of shards.

    The documents of a source are put in a permuted order by hash. Its words in that order, over
    and over, form a stream; the first ``target`` words of it (rounded) are the mix's, so every
    source meets its target to the word and no document is taken more than ``repeats`` times. The
    stream is cut into blocks of ``block_words``; the splitting tree deals the blocks to shards, and
    each shard takes the next run of blocks of each source. A draw (``copy`` from 0, ``words``,
    ``shard``, ``place``: the order inside the shard) belongs to the block in which it begins; there
    is none where that block is not dealt, and no word past the dealt blocks is taken.
    The last draw of a source may be cut: ``words`` is how many of the document's first words it takes.

    A document without a draw has one row with null copy and 0 words; a null text or one without
    words has size 0 and never a draw. A null source is a source of its own, the last one. Equal
    rows are separate documents (``n`` numbers the rows inside ``bucket`` of a source). An empty
    table gives an empty result. ``carry`` names the columns of ``row``; without it all are kept.

    The order is found in hash buckets of about ``BUCKET_WORDS`` words, so a source with a third of
    all rows is spread like the others; windows over a whole source see one row per bucket or shard.
    What travels with a document goes through one shuffle: a bucket knows its place in the stream
    and the shards of the few blocks it meets, and joins its documents where they are.
    """
    sized = docs.select(
        (packed(docs) if carry is None else F.struct(*carry)).alias("row"),
        docs["source"].alias("source"),
        # Nulls would keep the join below from using the window's partitioning.
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("skey"),
        word_count(docs["text"]).alias("size"),
        F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("key"),
        docs["doc_id"].alias("id"),
    )
    targets = written(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "mix-targets"
    )
    whole = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()["words"]
    shards = max(1, -(-whole // shard_words))
    quotas = targets.select("source", F.ceil(F.round("target") / block_words).cast("bigint").alias("blocks"))
    by_shard = Window.partitionBy("source").orderBy("shard")
    dealt = (
        split_quotas(quotas, shards, seed)
        .withColumn("end", F.sum("blocks").over(by_shard))
        .withColumn("dealt", F.sum("blocks").over(Window.partitionBy("source")) * block_words)
        .where(F.col("blocks") > 0)
        .select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"),
            "shard",
            "dealt",
            F.explode(F.sequence(F.col("end") - F.col("blocks"), F.col("end") - 1)).alias("block"),
        )
    )
    targets = targets.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "source_size", "target"
    )
    bucket_of = F.pmod(F.shiftright("key", 8), F.ceil(F.col("source_size") / BUCKET_WORDS) + 1).alias("bucket")
    placed = sized.join(targets, "skey").select(
        "row", "source", "skey", "size", "key", "id", "source_size", "target", bucket_of
    )
    so_far = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        placed.groupBy("skey", "bucket", "source_size")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.sum("words").over(so_far) - F.col("words"))
    )
    passes = F.expr(
        f"explode(flatten(transform(sequence(0, {repeats} - 1), c -> sequence("
        f"(c * source_size + start) DIV {block_words}, "
        f"(c * source_size + start + greatest(words, 1L) - 1) DIV {block_words}))))"
    )
    met = (
        starts.select("skey", "bucket", passes.alias("block"))
        .distinct()
        .join(dealt, ["skey", "block"])
        .groupBy("skey", "bucket")
        .agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("shard", "dealt")))).alias("blocks"))
    )
    starts = starts.join(met, ["skey", "bucket"], "left").select("skey", "bucket", "start", "blocks")

    inside = Window.partitionBy("skey", "bucket").orderBy("key", "id", "size")
    draws = F.expr(
        f"filter(transform(sequence(0, {repeats} - 1), c -> transform(array(named_struct('begin', c * source_size + at, "
        f"'block', try_element_at(blocks, (c * source_size + at) DIV {block_words}))), b -> named_struct("
        "'copy', c, 'shard', b.block.shard, 'words', greatest(0L, least(size, "
        "least(b.block.dealt, CAST(round(target) AS BIGINT)) - b.begin))))[0]), d -> d.shard IS NOT NULL AND d.words > 0)"
    )
    drawn = (
        placed.withColumn("n", F.row_number().over(inside))
        .withColumn(
            "before",
            F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
        )
        .join(starts, ["skey", "bucket"])
        .withColumn("at", F.col("start") + F.col("before"))
        .withColumn("d", F.explode_outer(draws))
        .select(
            "row",
            "source",
            "bucket",
            "n",
            "size",
            "source_size",
            "target",
            F.col("d.copy").alias("copy"),
            F.coalesce("d.words", F.lit(0).cast("bigint")).alias("words"),
            F.col("d.shard").alias("shard"),
            F.xxhash64("key", "n", "d.copy").alias("place"),
        )
    )
    return drawn, shards


def in_shards(draws: DataFrame, shards: int) -> DataFrame:
    """``draws`` with a shard, by shard and by place inside it: written, ``SHARD_FILES`` files a shard in file order.

    A file holds an even range of places, which are hashes, so the files of a shard are alike in size.
    """
    piece = F.shiftright((F.shiftright("place", 32) + F.lit(1 << 31)) * SHARD_FILES, 32)
    return draws.repartitionById(shards * SHARD_FILES, (F.col("shard") * SHARD_FILES + piece).cast("int")).sortWithinPartitions(
        "shard", "place"
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to its word number ``words``; the whole text if it has no more."""
    blank = r"[\x20\x09-\x0D]"
    lead = text.rlike("^" + blank).cast("int")
    rest = F.get(F.split(text, blank + "+", words.cast("int") + lead + 1), words.cast("int") + lead)
    return F.when(rest.isNull(), text).otherwise(F.substring(text, F.lit(1), F.length(text) - F.length(rest)))
