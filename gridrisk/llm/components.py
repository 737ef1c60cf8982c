"""Connected components of links between documents, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (u, v) with u > v.

    large: every neighbour above u is linked to u's smallest neighbour (u itself included).
    small: u and its neighbours below are linked to the smallest of them.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    lowest = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    met = both.join(lowest, "u")
    if large:
        pairs = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
    return pairs.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node in ``links`` (a, b); isolated nodes are not listed.

    Links stay a table: each round is written to the shared scratch folder, and only its count and
    hash sum come to the driver, until a round changes nothing. Null ends and self-links are ignored.
    """
    now = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct(),
        "links",
    )

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    after = state(now)
    while after != before:
        now = written(_star(_star(now, large=True), large=False), "links")
        before, after = after, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
