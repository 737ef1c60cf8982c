"""Delimited files with quoted line breaks, read by as many tasks as their size asks for."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table

LINES = "file string, file_time timestamp, block bigint, at bigint, value string, quotes bigint, inside boolean, even bigint, odd bigint"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in their block and the parity of quotes before them.

    ``even`` counts the lines so far that start a record if the block starts outside quotes, ``odd``
    if it starts inside.
    """
    where, at, before, even, odd = None, 0, 0, 0, 0
    for batch in batches:
        files, blocks = (batch.column(c).to_pylist() for c in ("file", "block"))
        quotes = pc.fill_null(pc.count_substring(batch.column("value"), '"'), 0).to_pylist()
        rows: dict[str, list] = {"at": [], "inside": [], "even": [], "odd": []}
        for file, block, n in zip(files, blocks, quotes, strict=True):
            if (file, block) != where:
                where, at, before, even, odd = (file, block), 0, 0, 0, 0
            inside = before % 2 == 1
            even, odd = even + (not inside), odd + inside
            for name, value in (("at", at), ("inside", inside), ("even", even), ("odd", odd)):
                rows[name].append(value)
            at, before = at + 1, before + n
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("file_time"),
                batch.column("block"),
                pa.array(rows["at"], pa.int64()),
                batch.column("value"),
                pa.array(quotes, pa.int64()),
                pa.array(rows["inside"], pa.bool_()),
                pa.array(rows["even"], pa.int64()),
                pa.array(rows["odd"], pa.int64()),
            ],
            names=["file", "file_time", "block", "at", "value", "quotes", "inside", "even", "odd"],
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, file_time, record, text``: the records of files in which line breaks stand in quotes; ``record`` counts from 1 in a file.

    Files are split by bytes at line ends. Each block counts its quotes, the counts of the blocks
    before it say whether it starts inside a quoted text, and with that its records are numbered.
    Lines that are whole records stay where they are; only the others are brought together. Empty
    lines between records are no records. A file with an odd number of quotes is an error, as is one
    with quotes inside texts without quotes around them, if they change where records end.

    The lines are written once below the scratch folder: the blocks must not change between the
    count and the cut.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    numbered = write_table(lines.mapInArrow(_numbered, LINES), scratch_path(spark, "lines"))
    blocks = numbered.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.withColumn("starts_inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    records = F.when(F.col("starts_inside"), F.col("odd")).otherwise(F.col("even"))
    placed = write_table(
        opened.withColumn("records_before", F.coalesce(F.sum(records).over(earlier), F.lit(0))).select(
            "file", "block", "quotes", "starts_inside", "records_before"
        ),
        scratch_path(spark, "blocks"),
    )
    uneven = placed.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").select("file").first()
    if uneven:
        raise ValueError(f"{uneven.file}: a quote is not closed")
    starts = F.col("inside") == F.col("starts_inside")
    whole = starts & (F.col("quotes") % 2 == 0)
    own = numbered.join(placed.drop("quotes"), ["file", "block"]).select(
        "file",
        "file_time",
        (F.col("records_before") + F.when(F.col("starts_inside"), F.col("odd")).otherwise(F.col("even"))).alias("record"),
        "block",
        "at",
        "value",
        whole.alias("whole"),
    )
    broken = (
        own.where("NOT whole")
        .groupBy("file", "file_time", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
        .select("file", "file_time", "record", F.array_join(F.col("parts.value"), "\n").alias("text"))
    )
    every = own.where("whole").select("file", "file_time", "record", F.col("value").alias("text")).unionByName(broken)
    return every.select("file", "file_time", "record", F.regexp_replace("text", r"\r$", "").alias("text")).where("text <> ''")


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Large UTF-8 files with a header; the named columns as strings, wherever they stand in it, and ``file, file_time, record``.

    As ``read_csv_strings``, but a file is read by several tasks, also if it has quoted line breaks.
    A column that the header lacks is null; if it has none of them, that is an error, and so are
    files of one folder with different headers. Inside quotes a quote is doubled.
    """
    records = read_records(spark, path)
    heads = records.where("record = 1").select("text").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{path}: {'files with different headers' if heads else 'no header'}")
    names = [name.strip().strip("\ufeff") for name in next(csv.reader([heads[0].text.lstrip("\ufeff")], delimiter=sep))]
    if not any(c in names for c in columns):
        raise ValueError(f"{path}: none of {list(columns)} in the header {names}")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    parsed = records.where("record > 1").select("file", "file_time", "record", F.from_csv("text", schema, options).alias("r"))
    place = {name: i for i, name in reversed(list(enumerate(names)))}
    return parsed.select(
        *[F.col(f"r.c{place[c]}").alias(c) if c in place else F.lit(None).cast("string").alias(c) for c in columns],
        "file",
        "file_time",
        "record",
    )
