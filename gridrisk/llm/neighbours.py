"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stopping test."""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import ship, written

#: Projected dimensions (even, so the chi-square distribution has a closed form) and vectors of a leaf.
DIMENSIONS, LEAF = 8, 64
#: Distinct vectors of an index shard, queries of a block.
SHARD, BLOCK = 8192, 4096
#: Chance that a neighbour is still unseen when a search stops.
MISS = 0.005


def chi_square_limit(miss: float, dimensions: int = DIMENSIONS) -> float:
    """Where the chi-square distribution function reaches ``1 - miss``."""
    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        term = total = 1.0
        for i in range(1, dimensions // 2):
            term *= mid / 2 / i
            total += term
        low, high = (mid, high) if exp(-mid / 2) * total > miss else (low, mid)
    return high


class ProjectedTree:
    """A kd-tree over projections of unit vectors; a search meets leaves by rising projected distance."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.normal = np.random.default_rng(seed).normal(size=(vectors.shape[1], DIMENSIONS))
        points = self.project(vectors, self.norms)
        self.leaves: list[np.ndarray] = []
        waiting = [np.arange(len(vectors))]
        while waiting:
            own = waiting.pop()
            if len(own) <= LEAF:
                self.leaves.append(own)
                continue
            axis = int(np.argmax(points[own].max(axis=0) - points[own].min(axis=0)))
            half = np.argpartition(points[own, axis], len(own) // 2)
            waiting += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.low = np.array([points[leaf].min(axis=0) for leaf in self.leaves])
        self.high = np.array([points[leaf].max(axis=0) for leaf in self.leaves])

    def project(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (vectors / norms[:, None]) @ self.normal

    def search(
        self, query: np.ndarray, least_ids: np.ndarray, k: int, limit: float, others: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest found (of those marked in ``others``); ties go to the smaller id.

        Leaves are verified in the order of their projected distance, twice as many each time. An
        unseen vector as near as the k-th one found would have a squared projected distance of that
        distance times a chi-square variable; the search ends when the next leaf lies beyond the
        limit of that variable (with a little room for rounding).
        """
        norm = np.sqrt((query * query).sum())
        point = self.project(query[None], np.array([norm]))[0]
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        distance = (gap * gap).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        places, scores, at, many = np.empty(0, dtype=np.int64), np.empty(0), 0, 2
        while at < len(order):
            if len(scores) == k and distance[order[at]] > max(0.0, 2 - 2 * scores[-1]) * limit + 1e-9:
                break
            own = np.concatenate([self.leaves[i] for i in order[at : at + many]])
            own = own if others is None else own[others[own]]
            cosine = (self.vectors[own] * query).sum(axis=1) / (self.norms[own] * norm)
            places, scores = np.concatenate([places, own]), np.concatenate([scores, cosine])
            best = np.lexsort((least_ids[places], -scores))[:k]
            places, scores = places[best], scores[best]
            at, many = at + many, many * 2
        return places, scores


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding", miss: float = MISS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearness is the cosine in double precision; ties go to the smaller id. Candidates are all rows
    but the query's own. Rows without an id, and vectors that are null, empty, zero or hold a null
    or non-finite component take no part. Repeated (id, vector) rows count once; one id with
    several vectors is several candidates and queries by that id, none of which finds the id itself.
    Vectors of another length are not compared. A query with fewer than ``k`` candidates gets them
    all; an empty table gives an empty result. Other columns are not read.

    Equal vectors are one class that carries only its ``k + 1`` smallest ids, so a vector that a
    third of all rows share is one point of the index. Every class is in a shard (by hash, of some
    8,000 classes), and each shard meets the query classes in blocks; the k-best lists of the shards
    are cut to k + 1 classes a query before ids are unfolded.
    """
    ship(vectors.sparkSession)
    x = F.transform(vectors[vector], lambda v: v.cast("double"))
    rows = vectors.select(vectors[id].cast("bigint").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull()
        & F.col("x").isNotNull()
        & F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
        & F.exists("x", lambda v: v != 0)
    )
    keyed = rows.select("id", "x", F.xxhash64("x").alias("h1"), F.hash("x").alias("h2")).dropDuplicates(["id", "h1", "h2"])
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    classes = written(
        keyed.withColumn("n", first)
        .where(F.col("n") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.first("x").alias("x"), F.array_sort(F.collect_list("id")).alias("ids")),
        "vector-classes",
    )
    # An id with several vectors asks for itself; others ask as their class, in which alone they stand.
    queried = keyed.where(F.col("id") % every == 0).select("id", "h1", "h2")
    several = queried.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("several"))
    asked = queried.join(several, "id").select("id", "h1", "h2", F.when(F.col("several"), F.col("id")).alias("asker"))
    targets = written(
        classes.select("h1", "h2", "x").join(asked.select("h1", "h2", "asker").distinct(), ["h1", "h2"]), "vector-queries"
    )
    shards = max(1, -(-classes.count() // SHARD))
    blocks = max(1, -(-targets.count() // BLOCK))
    dims = F.size("x").alias("dim")
    index = classes.select(
        "h1",
        "h2",
        "x",
        F.array_min("ids").alias("least"),
        (F.size("ids") == 1).alias("single"),
        dims,
        F.pmod(F.col("h2"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    queries = targets.select(
        "h1",
        "h2",
        "x",
        "asker",
        dims,
        F.pmod(F.xxhash64("h1", "asker"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    limit = chi_square_limit(miss)

    def search(points: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = ["q1", "q2", "asker", "c1", "c2", "score", "least"]
        if points.empty or own.empty:
            return pd.DataFrame({c: [] for c in columns})
        points = points.sort_values(["h1", "h2"])
        tree = ProjectedTree(np.stack(points["x"].to_numpy()).astype(np.float64), seed=5)
        h1, h2, least, single = (points[c].to_numpy() for c in ("h1", "h2", "least", "single"))
        found = []
        askers = own["asker"].astype("Int64")
        for q1, q2, asker, vector in zip(own["h1"], own["h2"], askers, own["x"], strict=True):
            # A class of the asker alone is no candidate; it leaves before the lists are cut.
            others = None if asker is pd.NA else ~(single & (least == asker))
            places, scores = tree.search(np.asarray(vector, dtype=np.float64), least, k + 1, limit, others)
            found.append(
                pd.DataFrame(
                    {"q1": q1, "q2": q2, "asker": pd.Series([asker] * len(places), dtype="Int64"), "c1": h1[places],
                     "c2": h2[places], "score": scores, "least": least[places]}
                )
            )
        return pd.concat(found)

    keys = ["dim", "shard", "block"]
    met = (
        index.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInPandas(search, "q1 bigint, q2 int, asker bigint, c1 bigint, c2 int, score double, least bigint")
    )
    best = F.row_number().over(Window.partitionBy("q1", "q2", "asker").orderBy(F.desc("score"), "least"))
    near = met.withColumn("n", best).where(F.col("n") <= k + 1).select("q1", "q2", "asker", "c1", "c2", "score")
    unfolded = near.join(
        classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.explode("ids").alias("vec_id")), ["c1", "c2"]
    )
    asking = asked.select(F.col("id").alias("query_id"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("asker").alias("own"))
    pairs = asking.join(
        unfolded, (F.col("a1") == F.col("q1")) & (F.col("a2") == F.col("q2")) & F.col("own").eqNullSafe(F.col("asker"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id"))
    return (
        pairs.where("vec_id <> query_id")
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
