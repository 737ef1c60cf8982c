"""Sinks for exports and intermediates, which are written whole. Tables that live on are in ``snapshots``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int | None = None) -> DataFrame:
    """Write Parquet and read it back: the default storage, and the way to cut lineage.

    ``rows_per_file`` bounds the files, for tables that are read often: small files are dealt evenly to the tasks.
    """
    sink = df.write.mode("overwrite").partitionBy(*partition_by)
    if rows_per_file:
        sink = sink.option("maxRecordsPerFile", rows_per_file)
    sink.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blanks_for_null(df: DataFrame) -> DataFrame:
    """Text form of a view with '' in place of null, as a service would send it."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def geojson_features(df: DataFrame, lat: str, lon: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON point feature per row."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select(F.to_json(feature).alias("feature"))
