"""Readers of landed files. Text is read as strings first and typed by a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from gridrisk.functions.numbering import numbered
from gridrisk.functions.text import pad_geo_id, to_number
from gridrisk.session import scratch_path
from gridrisk.sources import schemas as S
from gridrisk.sources.delimited import read_delimited
from gridrisk.sources.writers import write_table


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                     encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Delimited file with a header; the named columns as strings, wherever they stand in it.

    Names are compared trimmed. A column that the header lacks is null; if it has none of them, that
    is an error, and so are files of one folder with different headers. Quoted line breaks are kept,
    so a file is read by one task; ``read_delimited`` splits large files.
    """
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )
    found = {c.strip().strip("\ufeff"): c for c in raw.columns}
    if not any(c in found for c in columns):
        raise ValueError(f"{path}: none of {list(columns)} in the header {raw.columns}")
    return raw.select(
        *[F.col(f"`{found[c]}`").alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in columns]
    )


def parse_documents(raw: DataFrame, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """JSON records of whole files in ``value``: one document, an array of records, or one document a line.

    Indentation and line breaks do not matter. A file that does not parse fails the job. ``line``
    and ``item`` say where in its file a record stands.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    by_line = F.forall(lines, lambda line: F.try_parse_json(line).isNotNull())
    docs = raw.select(*keep, F.posexplode(F.when(by_line, lines).otherwise(F.array("value"))).alias("line", "text"))
    body = F.trim("text", F.lit(" \t\r\n\ufeff"))
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    fields = f"array<struct<{StructType.fromDDL(schema).simpleString()[7:-1]}>>"
    parsed = docs.select(*keep, "line", F.from_json(listed, fields, {"mode": "FAILFAST"}).alias("records"))
    return parsed.select(*keep, "line", F.posexplode("records").alias("item", "r")).select(*keep, "line", "item", "r.*")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON document files, each small enough for one task."""
    return parse_documents(spark.read.text(path, wholetext=True), schema).drop("line", "item")


def required(column: str, what: str) -> Column:
    """The column, or a failed job where a document lacks it."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"no {column} in {what}")))


def typed(df: DataFrame, doubles: Sequence[str] = (), ints: Sequence[str] = (),
          longs: Sequence[str] = ()) -> DataFrame:
    """Coerce string columns; what does not parse becomes null."""
    casts: dict[str, Column] = {c: to_number(F.col(c)) for c in doubles}
    casts |= {c: F.expr(f"try_cast(`{c}` AS INT)") for c in ints}
    casts |= {c: F.expr(f"try_cast(`{c}` AS BIGINT)") for c in longs}
    return df.withColumns(casts) if casts else df


#: Bytes up to which a file is read whole, by one task; a larger one is read by lines, by several.
WHOLE_BYTES = 16 << 20
#: Where a document stands: its file, the block and line it begins at, and its place in a line's array.
PLACE = ["file_time", "file_path", "block", "line", "item"]


def page_files(raw: DataFrame) -> DataFrame:
    """Whole page files with their path and time, which stand in for what a page does not say."""
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def landed_texts(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Page files as text with their place: a row for a file of up to ``WHOLE_BYTES``, a row a line for a larger one.

    Spark leaves out the files of the other kind before it reads them. ``reader`` reads a table or a
    stream.
    """
    size = F.col("_metadata.file_size")
    whole = reader.format("text").option("lineSep", "\n").option("wholetext", True).load(path).where(size <= WHOLE_BYTES)
    lines = reader.format("text").option("lineSep", "\n").option("wholetext", False).load(path).where(size > WHOLE_BYTES)
    return page_files(whole).select("*", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("whole")).unionByName(
        lines.select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_block_start").alias("block"),
            F.lit(False).alias("whole"),
        )
    )


def parse_texts(texts: DataFrame, schema: str) -> DataFrame:
    """``landed_texts`` → the JSON records of each file with their ``PLACE``, as ``parse_documents`` finds them.

    A file read by lines whose every line is a record stays split. The lines of any other one are
    brought together again, as it is one document or an array over many lines.
    """
    columns = StructType.fromDDL(schema).names
    files = ["file_path", "file_time"]
    block = {"block": F.lit(0).cast("bigint"), "line": F.col("line").cast("bigint")}
    small = parse_documents(texts.where("whole"), schema, files).withColumns(block)
    # Lines of a block stand in one partition, in their order.
    lines = texts.where("NOT whole").withColumn("line", F.monotonically_increasing_id())
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r$", "")).where(F.trim("value") != "")
    body = F.trim("value", F.lit(" \t"))
    framed = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    # A line that does not even begin and end as a record is not parsed: most lines of indented files.
    sound = F.when(framed, F.try_parse_json("value").isNotNull()).otherwise(False)
    kinds = write_table(
        lines.groupBy("file_path").agg(F.bool_and(sound).alias("by_line")), scratch_path(texts.sparkSession, "kinds")
    )
    fields = f"array<struct<{StructType.fromDDL(schema).simpleString()[7:-1]}>>"
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    split = (
        lines.join(kinds.where("by_line"), "file_path", "left_semi")
        .select(*PLACE[:-1], F.posexplode(F.from_json(listed, fields, {"mode": "FAILFAST"})).alias("item", "r"))
        .select(*PLACE, *[F.col(f"r.`{c}`") for c in columns])
    )
    joined = (
        lines.join(kinds.where("NOT by_line"), "file_path", "left_semi")
        .groupBy(*files)
        .agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
        .select(*files, F.array_join(F.col("parts.value"), "\n").alias("value"))
    )
    large = parse_documents(joined, schema, files).withColumns(block)
    return small.select(*PLACE, *columns).unionByName(split).unionByName(large.select(*PLACE, *columns))


def parse_cve_pages(texts: DataFrame) -> DataFrame:
    """Parsed pages; without a ``keyword`` the folder ``keyword=…`` or else the file's stem is taken."""
    pages = parse_texts(texts, S.CVE_PAGE_SCHEMA)
    folder = F.nullif(F.regexp_extract("file_path", r"keyword=([^/]+)", 1), F.lit(""))
    stem = F.regexp_extract("file_path", r"([^/]*?)[-_.]?[0-9]*(\.[^./]*)?$", 1)
    return pages.withColumns(
        {
            "keyword": F.coalesce("keyword", F.url_decode(folder), F.url_decode(stem)),
            "vulnerabilities": required("vulnerabilities", "a page"),
        }
    )


def read_cve_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed vulnerability pages, one row per listed CVE: ``seq, keyword, cve``.

    Pages that carry no ``seq`` are numbered in load order: by file time, path and place. Only the
    keys of pages are numbered, range by range. The parsed pages are written once, as their keys are
    read several times.
    """
    texts = landed_texts(spark.read.option("recursiveFileLookup", True), path)
    pages = write_table(parse_cve_pages(texts), scratch_path(spark, "pages"))
    keys = pages.filter("seq IS NULL").select(*PLACE)
    if keys.isEmpty():
        return explode_cve_pages(pages)
    numbers = numbered(keys, "page", *[F.col(c).asc() for c in PLACE])
    known = pages.join(numbers.select(*PLACE[1:], "page"), PLACE[1:], "left")
    return explode_cve_pages(known, ["page"], PAGE_ROWS * F.col("page") + F.col("pos")).drop("page")


# More than any page lists, so that load order runs through pages, then through their rows.
PAGE_ROWS = 1_000_000


def explode_cve_pages(pages: DataFrame, keep: Sequence[str] = (), seq: Column | None = None, place: bool = False) -> DataFrame:
    """One row per listed CVE; ``seq`` stands in where a page has none. ``place`` adds ``pos``, the place in its page."""
    rows = pages.select("seq", "keyword", *keep, F.posexplode("vulnerabilities").alias("pos", "v"))
    number = F.col("seq") if seq is None else F.coalesce("seq", seq)
    return rows.select(number.alias("seq"), "keyword", *keep, *["pos"] * place, F.col("v.cve").alias("cve")).filter(
        F.coalesce(F.col("cve.id"), F.lit("")) != ""
    )


def read_kev_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exploited-vulnerability catalogue with ``seq``: the order of its files by time and path, then the order in a file."""
    rows = read_delimited(spark, path, S.KEV_COLUMNS)
    return numbered(rows, "seq", F.col("file_time").asc(), F.col("file").asc(), F.col("record").asc()).drop("file", "file_time", "record")


def read_kev_json(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as a JSON feed, with ``seq``: the order of its files by time and path, then the order in a file."""
    fields = ",".join(f"{c}:string" for c in S.KEV_COLUMNS)
    files = page_files(spark.read.text(path, wholetext=True))
    feed = parse_documents(files, f"vulnerabilities array<struct<{fields}>>", ["file_path", "file_time"])
    place = ["file_path", "file_time", "line", "item"]
    rows = feed.select(*place, F.posexplode(required("vulnerabilities", "the catalogue")).alias("pos", "v")).select(*place, "pos", "v.*")
    return numbered(rows, "seq", F.col("file_time").asc(), F.col("file_path").asc(), F.col("line").asc(), F.col("item").asc(), F.col("pos").asc()).drop(
        *place, "pos"
    )


def read_devices_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Device records of all 28 fields, one a line; ``multi_line`` for files that are one document or array.

    A record that does not parse fails the job.
    """
    if multi_line:
        return read_documents(spark, path, S.DEVICE_SCHEMA)
    return spark.read.schema(S.DEVICE_SCHEMA).option("mode", "FAILFAST").json(path)


def read_observations_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Observations, one a line; ``multi_line`` as for devices. A record that does not parse fails the job."""
    if multi_line:
        return read_documents(spark, path, S.OBSERVATION_SCHEMA)
    return spark.read.schema(S.OBSERVATION_SCHEMA).option("mode", "FAILFAST").json(path)


def header_matrix(df: DataFrame, payload: str, columns: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Array-of-arrays JSON whose first row is the header → one row per data row.

    ``columns`` maps header names to output names; positions come from each payload's own header.
    A header name that is absent gives null.
    """
    rows = df.select(*keep, F.from_json(F.col(payload), "array<array<string>>").alias("m"))
    body = rows.select(*keep, F.col("m")[0].alias("header"), F.posexplode("m").alias("pos", "r")).filter("pos > 0")
    picks = [
        F.try_element_at("r", F.nullif(F.array_position("header", source).cast("int"), F.lit(0))).alias(target)
        for source, target in columns.items()
    ]
    return body.select(*keep, *picks)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated centroids: names are trimmed, coordinates found by name part."""
    raw = (
        spark.read.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    )
    by_name = {c.strip(): c for c in raw.columns}

    def column(part: str) -> Column:
        name = next(n for n in by_name if part in n.upper())
        return F.col(f"`{by_name[name]}`")

    return raw.select(
        pad_geo_id(F.col(f"`{by_name['GEOID']}`")).alias("geo_id"),
        to_number(column("INTPTLAT")).alias("lat"),
        to_number(column("INTPTLONG")).alias("lon"),
    ).dropna()


def read_capacity(spark: SparkSession, path: str) -> DataFrame:
    """Capacity responses → ``location, capacity`` (MW as text)."""
    responses = read_documents(spark, path, S.CAPACITY_SCHEMA)
    return responses.select(F.explode(required("response.data", "a capacity response")).alias("d")).select(
        "d.location", "d.capacity"
    )


def vendor_dictionary(df: DataFrame, text: str, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Vendor dictionary documents → vendor, vendor×CVE, vendor×firmware and keyword tables."""
    parsed = df.select(*keep, F.from_json(F.col(text), S.VENDOR_DICTIONARY_SCHEMA).alias("d")).select(*keep, "d.*")
    vendors = parsed.select(*keep, F.explode("vendors").alias("vendor_key", "v"))
    return {
        "vendors": vendors.select(*keep, "vendor_key", F.col("v.risk_level").alias("risk_level")),
        "cves": vendors.select(
            *keep, "vendor_key", F.posexplode(F.map_entries("v.cves")).alias("position", "e")
        ).select(*keep, "vendor_key", "position", F.col("e.key").alias("cve_id"), F.col("e.value.cvss").alias("cvss")),
        "firmware": vendors.select(
            *keep, "vendor_key", F.posexplode(F.map_entries("v.firmware_intel")).alias("position", "e")
        ).select(*keep, "vendor_key", "position", F.col("e.key").alias("firmware"), F.col("e.value").alias("status")),
        "keywords": parsed.select(
            *keep, F.posexplode(F.map_entries("keyword_to_vendor_map")).alias("position", "e")
        ).select(*keep, "position", F.col("e.key").alias("keyword"), F.col("e.value").alias("vendor_key")),
    }


def grid_dimension(spark: SparkSession) -> DataFrame:
    """Country and state capacities as a table of ``code, scope, solar_gw, grid_critical``."""
    from gridrisk import constants as C

    rows = [(c, "country", gw, crit) for c, gw, crit in C.EUROPE_GRID]
    rows += [(c, "state", gw, crit) for c, gw, crit in C.STATE_GRID]
    return spark.createDataFrame(rows, "code string, scope string, solar_gw double, grid_critical boolean")
