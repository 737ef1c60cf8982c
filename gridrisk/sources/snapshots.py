"""Versioned tables: data folders that are never changed, and one commit row that points at them.

A table is split by a hash of its key into buckets. A write puts the buckets it touches into a new
folder and then commits a row that names the folder of every bucket; that row is one file, so it is
there or not. Readers follow the newest commit. A job that dies before its commit leaves the last
version as it was, and its folder unread.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
COMMIT = "version bigint, token string, buckets int, folders map<int, string>, schema string, committed_at timestamp"


class ConcurrentCommit(RuntimeError):
    """Another writer committed the same version."""


class SnapshotTable:
    """One versioned table below ``root``. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits/*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commit_row(self, version: int | None = None):
        commits = self._commits()
        if commits is None:
            return None
        if version is not None:
            commits = commits.where(F.col("version") == version)
        return commits.orderBy(F.desc("version")).limit(1).first()

    def version(self) -> int | None:
        """The newest committed version; None before the first."""
        row = self._commit_row()
        return row and row.version

    def bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _folders(self, row, wanted: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(row.schema))
        paths = [
            f"{self.root}/data/{folder}/{BUCKET}={bucket}"
            for bucket, folder in sorted(row.folders.items())
            if wanted is None or bucket in wanted
        ]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default. Its files stay, whatever is written later."""
        row = self._commit_row(version)
        if row is None:
            raise ValueError(f"{self.root}: no committed version" + ("" if version is None else f" {version}"))
        return self._folders(row)

    def _write(self, df: DataFrame, buckets: int) -> tuple[str, list[int]]:
        folder = uuid.uuid4().hex
        marked = df.withColumn(BUCKET, self.bucket_of(F.col(self.key), buckets))
        marked.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
        written = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.root}/data/{folder}")
        return folder, [r[0] for r in written.select(BUCKET).distinct().collect()]

    def _commit(self, before, buckets: int, folders: dict[int, str], schema: StructType) -> int:
        version, token = 1 if before is None else before.version + 1, uuid.uuid4().hex
        row = self.spark.createDataFrame([(version, token, buckets, folders, schema.json())], COMMIT.rpartition(",")[0])
        row = row.withColumn("committed_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits/{version}")
        same = self._commits().where(F.col("version") == version).orderBy("committed_at", "token").limit(1).first()
        if same.token != token:
            raise ConcurrentCommit(f"{self.root}: version {version}")
        return version

    def replace(self, df: DataFrame) -> int:
        """A new version with the rows of ``df`` alone. The version before stays readable, also while this runs."""
        before = self._commit_row()
        folder, found = self._write(df, self.buckets)
        return self._commit(before, self.buckets, dict.fromkeys(found, folder), df.schema)

    def rewrite(self, keys: DataFrame, merged: Callable[[DataFrame | None, Callable[[DataFrame], DataFrame]], DataFrame]) -> int:
        """A new version in which only the buckets of ``keys`` (a column named as the key) are written anew.

        ``merged(current, inside)`` gets the stored rows of those buckets, or None before the first
        version, and a filter for rows of those buckets; it returns their new rows. What it returns
        outside them is an error. Without keys nothing is written and the version stays.
        """
        before = self._commit_row()
        buckets = self.buckets if before is None else before.buckets
        own = self.bucket_of(F.col(self.key), buckets)
        touched = sorted(r[0] for r in keys.select(own.alias("b")).distinct().collect())
        if not touched and before is not None:
            return before.version
        current = None if before is None else self._folders(before, touched)
        rows = merged(current, lambda df: df.where(own.isin(touched)))
        folder, found = self._write(rows, buckets)
        if not set(found) <= set(touched):
            raise ValueError(f"{self.root}: rows outside the touched buckets")
        kept = {} if before is None else {b: f for b, f in before.folders.items() if b not in touched}
        return self._commit(before, buckets, kept | dict.fromkeys(found, folder), rows.schema)


class RunLog:
    """Audit rows of runs: one when a run opens, one when it closes; a run that died has only the first."""

    FIELDS = "run_id string, event string, status string, notes string, nvd_keyword_count bigint, nvd_cve_count bigint, kev_cve_count bigint"
    SCHEMA = f"{FIELDS}, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, run_id: str, event: str, status: str, notes: str, counts: tuple = (None, None, None)) -> None:
        row = self.spark.createDataFrame([(run_id, event, status, notes, *counts)], self.FIELDS)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def open(self, notes: str) -> str:
        run_id = uuid.uuid4().hex
        self._append(run_id, "opened", "running", notes)
        return run_id

    def close(self, run_id: str, notes: str, counts: tuple[int, int, int] | None = None, failed: bool = False) -> None:
        """``counts`` are searched keywords, listed CVEs and exploited CVEs; a failed run may have none."""
        self._append(run_id, "closed", "failed" if failed else "done", notes, counts or (None, None, None))

    def runs(self) -> DataFrame:
        """One row per run: run_id, started_at, completed_at (null while open), status, notes and counts."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        closing = F.col("event") == "closed"
        last = F.max(F.when(closing, F.struct("at", "status", "nvd_keyword_count", "nvd_cve_count", "kev_cve_count", "notes")))
        return (
            rows.groupBy("run_id")
            .agg(F.min(F.when(~closing, F.col("at"))).alias("started_at"), F.first(F.when(~closing, F.col("notes")), True).alias("own"), last.alias("c"))
            .select(
                "run_id",
                "started_at",
                F.col("c.at").alias("completed_at"),
                F.coalesce("c.status", F.lit("running")).alias("status"),
                F.coalesce("c.notes", "own").alias("notes"),
                "c.nvd_keyword_count",
                "c.nvd_cve_count",
                "c.kev_cve_count",
            )
        )
