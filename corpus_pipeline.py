"""The corpus pipeline: five stages over documents, each a written table for the next.

Language ID, near-dedup, benchmark decontamination, mixing to target weights, token-id files. All
but the last return the columns of documents. The cases the operators define hold here as well:
null and empty texts are rejected by the first stage (no language), repeated rows and rows with equal
or no doc_ids are judged by their texts in the second and leave one row a group, extra columns are
kept, and an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.llm.common import table, written
from gridrisk.llm.decontaminate import decontaminate
from gridrisk.llm.langid import UNKNOWN, ByteNet, identify_language, train_network, training_mask
from gridrisk.llm.mixing import dealt_mix, first_words, in_shards
from gridrisk.llm.near import drop_near_duplicates
from gridrisk.llm.tokens import decode_tokens, encode_tokens
from gridrisk.session import scratch_path

#: All but one in so many right predictions are taken for clear without doubt.
CLEAR = 2_000


def least_score(docs: DataFrame, network: ByteNet | None) -> float:
    """The least score of a clear language: three quarters of what all but one in ``CLEAR`` right predictions reach.

    Predictions are those of all labelled documents not learnt from; 0 without any.
    """
    others = docs.select("doc_id", "text", "lang").where(~training_mask(F.col("doc_id")) & F.col("lang").isNotNull())
    right = identify_language(others, network=network).where("lang = language.lang_pred")
    return 0.75 * (right.agg(F.percentile_approx("language.score", 1 / CLEAR, 100_000)).first()[0] or 0.0)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter at all, or no language with a clear score.

    What is clear follows from the scores of right predictions, whatever the number of languages.
    """
    network = train_network(docs)
    least = least_score(docs, network) if network else 0.0
    judged = identify_language(docs, network=network)
    clear = (F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= least)
    return judged.where(clear).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mix, one row each: whole documents, up to three times, and one cut one a source.

    They are written shard after shard, in the order of their places.
    """
    draws, shards = dealt_mix(docs)
    text = F.when(
        F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))
    ).otherwise(F.col("row.text"))
    cut = draws.where("copy IS NOT NULL").select(F.col("row").withField("text", text).alias("row"), "shard", "place")
    return in_shards(cut, shards).select("row.*").withColumns(
        {"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {}
    )


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files, read back: doc_id, start, n_tokens and ids_crc32 of every row."""
    path = scratch_path(spark, "token-ids")
    encode_tokens(docs, path)
    return decode_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("token_ids", token_files),
]

#: Trained networks, MinHash groups and hashed orders are beyond SQL; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
