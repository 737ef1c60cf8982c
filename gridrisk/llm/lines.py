"""Line dedup: lines that stand on many sites are boilerplate and are cut from every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import packed, written

LG_K = 12
MARGIN = 2


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\r\v\f")))


def wide_lines(occurrences: DataFrame, min_sites: int) -> DataFrame:
    """``h1``, ``h2`` of the lines that stand on at least ``min_sites`` different sites.

    One HyperLogLog sketch of sites per line hash, merged by aggregation. An estimate at least
    twice away from the threshold decides (some thirty standard errors); lines in between get an
    exact distinct count from their distinct (line, site) rows.
    """
    spread = written(
        occurrences.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
        .where(F.col("sites") * MARGIN >= min_sites),
        "line-spread",
    )
    near = spread.where(F.col("sites") < min_sites * MARGIN).select("h1", "h2")
    exact = (
        occurrences.select("h1", "h2", "site")
        .where(F.col("site").isNotNull())
        .distinct()
        .join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("h1", "h2")
    )
    return exact.unionByName(spread.where(F.col("sites") >= min_sites * MARGIN).select("h1", "h2"))


def dedup_lines(docs: DataFrame, min_sites: int = 6, site: str = "source") -> DataFrame:
    """``docs`` with ``cut``: struct of n_lines, n_removed and the text that is left.

    Lines are what stands between line feeds, compared without blanks, tabs and carriage returns
    at their ends. A line on ``min_sites`` or more different sites is removed wherever it stands;
    the others stay as they are. Empty lines are never removed. A null site counts as no site,
    but its documents lose boilerplate too. A null text stays null, with no lines. Repeated rows
    and equal doc_ids are kept and treated alike; an extra column called ``cut`` is replaced.

    A line is known by two hashes of together 96 bits. The occurrences travel as hashes only; a
    very common line is summed before the shuffle, and the join that marks it can be split.
    """
    text = docs["text"]
    key = F.xxhash64(text)
    occurrences = written(
        docs.where(text.isNotNull())
        .select(docs["doc_id"], key.alias("text_hash"), docs[site].alias("site"), F.posexplode(trimmed_lines(text)))
        .where("col <> ''")
        .select("doc_id", "text_hash", "site", "pos", F.xxhash64("col").alias("h1"), F.hash("col").alias("h2")),
        "line-hashes",
    )
    removed = (
        occurrences.join(wide_lines(occurrences, min_sites), ["h1", "h2"], "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("removed"))
    )
    rows = docs.select(
        packed(docs, "cut").alias("row"), key.alias("text_hash")
    )
    lines = F.split("r.row.text", "\n")
    left = F.filter(lines, lambda _, at: ~F.array_contains(F.coalesce("f.removed", F.array().cast("array<int>")), at))
    return rows.alias("r").join(
        removed.alias("f"),
        F.col("r.row.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash")),
        "left",
    ).select(
        "r.row.*",
        F.struct(
            F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
            F.coalesce(F.size("f.removed"), F.lit(0)).alias("n_removed"),
            F.array_join(left, "\n").alias("text"),
        ).alias("cut"),
    )
