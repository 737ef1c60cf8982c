"""Joins of texts with rules whose condition is that a text contains a pattern.

The rules are a table of any length. Each pattern is filed under one of its q-grams, the one that
the fewest texts have, and meets only texts with that gram, in an equi-join. Each distinct text and
pattern is judged once. No nested loop, and no rule in the plan.

Rules are unpacked from files that are far smaller than their rows, so the planner is not left to
judge by file size which of them the driver can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table

#: Characters of a gram. A pattern is filed under grams of the greatest size that fits into it, at least half of it up
#: to the last size, so that patterns with short parts in common, as numbered names, do not meet each other's texts.
SIZES = (1, 2, 3, 4, 8, 16, 32)
#: Characters of a piece of text from which grams are cut.
PIECE = 256
#: Patterns up to which every text is judged by every pattern of its scope, which is less work than its grams.
FEW = 64
#: Rows, or entries of their lists, up to which a table may be broadcast.
SMALL = 10_000


def _is_small(table: DataFrame) -> bool:
    return table.limit(SMALL + 1).count() <= SMALL


def _unbroadcast(table: DataFrame, small: bool) -> DataFrame:
    """``table``; a join does not send it to the driver unless it is small."""
    return table if small else table.hint("merge")


def _size(pattern: Column) -> Column:
    """Characters of a pattern's grams; 0 of the empty one."""
    return F.coalesce(*[F.when(F.length(pattern) >= n, F.lit(n)) for n in reversed(SIZES)], F.lit(0))


def _cut(text: Column, size: Column) -> Column:
    """The hashes of all substrings of a size that is not above the text's."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.transform(at, lambda i: F.xxhash64(F.substring(text, i, size)))


def _grams(text: Column, sizes: list[int]) -> Column:
    """The hashes of the distinct grams of a text at the given sizes.

    Grams are cut from pieces, because reaching a character costs as much as its place in the string.
    """
    none = F.array().cast("array<bigint>")
    over = sizes[-1] - 1
    pieces = F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(1), F.length(text), F.lit(PIECE)), lambda b: F.substring(text, b, F.lit(PIECE + over))),
    ).otherwise(F.array().cast("array<string>"))

    def of_piece(piece: Column) -> Column:
        cut = [F.when(F.length(piece) >= n, _cut(piece, F.lit(n))).otherwise(none) for n in sizes if n]
        return F.array_distinct(F.concat(none, *cut))

    empty = F.array(F.xxhash64(F.lit(""))) if 0 in sizes else none
    return F.array_distinct(F.concat(empty, F.flatten(F.transform(pieces, of_piece))))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct ``scope, text, pattern`` where a text contains a pattern of its scope.

    Both tables have ``scope`` and their string; null strings and scopes match nothing, the empty
    pattern is in every text of its scope. Repeated rows count once; other columns are not read.
    """
    own = texts.select("scope", "text").where("scope IS NOT NULL AND text IS NOT NULL").distinct()
    rules = patterns.select("scope", "pattern").where("scope IS NOT NULL AND pattern IS NOT NULL").distinct()
    size = _size(F.col("pattern"))
    known = rules.agg(
        F.count(F.lit(1)).alias("rules"),
        F.sort_array(F.collect_set(size)).alias("sizes"),
        F.coalesce(F.sum(F.length("pattern") - size + 1), F.lit(0)).alias("grams"),
    ).first()
    if known["rules"] <= FEW:
        return own.join(F.broadcast(rules), "scope").where(F.contains("text", "pattern")).select("scope", "text", "pattern")
    keyed = own.withColumn("digest", F.unhex(F.md5("text")))
    # Two grams of one hash give a candidate more, which its text then judges.
    return (
        _candidates(keyed, rules, known["sizes"], known["grams"] <= SMALL)
        .join(keyed.hint("merge"), ["scope", "digest"])
        .where(F.contains("text", "pattern"))
        .select("scope", "text", "pattern")
    )


def _candidates(keyed: DataFrame, rules: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """``scope, digest, pattern`` where a text has the gram under which the pattern is filed.

    Texts travel as grams and a digest; the text itself joins only its candidates. ``small``: the
    patterns have few grams, which are sent to the texts.
    """
    filed = keyed.select("scope", "digest", F.explode(_grams(F.col("text"), sizes)).alias("gram"))
    cut = F.array_distinct(_cut(F.col("pattern"), _size(F.col("pattern"))))
    choices = rules.select("scope", "pattern", F.explode(cut).alias("gram"))
    wanted = choices.select("scope", "gram").distinct()
    met = filed.join(F.broadcast(wanted) if small else wanted.hint("merge"), ["scope", "gram"])
    held = met.groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("texts"))
    # A pattern with a gram that no text has is in none of them.
    known = choices.join(_unbroadcast(held, small), ["scope", "gram"], "left")
    rarest = known.groupBy("scope", "pattern").agg(
        F.min(F.struct("texts", "gram")).alias("best"), F.count_if(F.col("texts").isNull()).alias("missing")
    )
    index = rarest.where("missing = 0").select("scope", "pattern", F.col("best.gram").alias("gram"))
    return met.join(_unbroadcast(index, small), ["scope", "gram"]).select("scope", "digest", "pattern")


def vendor_keys(devices: DataFrame, keywords: DataFrame, vendor: str = "vendor") -> DataFrame:
    """``devices`` with ``vendor_key``: of the first keyword, by position, that the vendor text contains, else null.

    ``keywords`` has position, keyword, vendor_key; of equal positions the smaller keyword counts.
    Texts are compared lower-cased, keywords as they are; a null vendor is the empty text.
    """
    text = F.lower(F.coalesce(F.col(f"`{vendor}`"), F.lit("")))
    hits = contained(
        devices.select(F.lit(0).alias("scope"), text.alias("text")),
        keywords.select(F.lit(0).alias("scope"), F.col("keyword").alias("pattern")),
    )
    rules = keywords.select("position", F.col("keyword").alias("pattern"), "vendor_key")
    first = (
        hits.join(_unbroadcast(rules, _is_small(rules)), "pattern")
        .groupBy("text")
        .agg(F.min(F.struct("position", "pattern", "vendor_key")).alias("rule"))
        .select(F.col("text").alias("_text"), F.col("rule.vendor_key").alias("vendor_key"))
    )
    rows = devices.drop("vendor_key")
    return rows.withColumn("_text", text).join(first, "_text", "left").drop("_text")


def firmware_risks(devices: DataFrame, firmware: DataFrame, version: str = "firmware_version") -> DataFrame:
    """``devices`` (with ``vendor_key``) with ``firmware_risk`` of the first listed firmware that fits, else null.

    ``firmware`` has vendor_key, position, firmware, status. A listed version fits a device of its
    vendor if either text contains the other, lower-cased; a device without version fits none, and a
    status without a risk is passed over. Of equal positions the smaller text counts.
    """
    own = F.lower(F.coalesce(F.col(f"`{version}`"), F.lit("")))
    status = F.create_map(*[F.lit(x) for pair in C.FIRMWARE_STATUS_RISK.items() for x in pair])
    listed = firmware.select(
        F.col("vendor_key").alias("scope"), "position", F.lower("firmware").alias("listed"), F.try_element_at(status, F.col("status")).alias("risk")
    ).where("risk IS NOT NULL")
    # Read several times, and found by a join of all texts.
    seen = write_table(
        devices.select(F.col("vendor_key").alias("scope"), own.alias("own")).where("scope IS NOT NULL AND own <> ''").distinct(),
        scratch_path(devices.sparkSession, "versions"),
    )
    as_text = contained(seen.select("scope", F.col("own").alias("text")), listed.select("scope", F.col("listed").alias("pattern")))
    as_pattern = contained(listed.select("scope", F.col("listed").alias("text")), seen.select("scope", F.col("own").alias("pattern")))
    pairs = as_text.select("scope", F.col("text").alias("own"), F.col("pattern").alias("listed")).unionByName(
        as_pattern.select("scope", F.col("pattern").alias("own"), F.col("text").alias("listed"))
    )
    first = (
        pairs.join(_unbroadcast(listed, _is_small(listed)), ["scope", "listed"])
        .groupBy(F.col("scope").alias("_scope"), F.col("own").alias("_own"))
        .agg(F.min(F.struct("position", "listed", "risk")).alias("rule"))
        .select("_scope", "_own", F.col("rule.risk").alias("firmware_risk"))
    )
    rows = devices.drop("firmware_risk").withColumn("_version", own)
    return rows.join(first, (F.col("vendor_key") == F.col("_scope")) & (F.col("_version") == F.col("_own")), "left").drop(
        "_scope", "_own", "_version"
    )


def vendor_cve_tables(vendors: DataFrame, cves: DataFrame) -> DataFrame:
    """``vendor_key, cve_risk, cve_ids``: the band of each vendor's worst CVE, and its CVEs in order.

    A score that is no number counts as 7. A vendor without CVEs goes by its risk level.
    """
    score = F.coalesce(F.expr("try_cast(cvss AS DOUBLE)"), F.lit(7.0))
    band = F.when(score >= 9, 1.0).when(score >= 7, 0.7).when(score >= 4, 0.4).otherwise(0.0)
    known = cves.groupBy("vendor_key").agg(
        F.max(band).alias("worst"), F.array_sort(F.collect_list(F.struct("position", "cve_id"))).alias("listed")
    )
    return vendors.select("vendor_key", "risk_level").distinct().join(_unbroadcast(known, _is_small(cves)), "vendor_key", "left").select(
        "vendor_key",
        F.coalesce("worst", F.when(F.col("risk_level") == "CRITICAL", 1.0).otherwise(0.7)).alias("cve_risk"),
        F.coalesce(F.col("listed.cve_id"), F.array().cast("array<string>")).alias("cve_ids"),
    )


def matched_rules(rows: DataFrame, key: str, rules: DataFrame, text: Column, title: Column, ports: Column) -> DataFrame:
    """``key, rule_vendor, rule`` for every row and rule all of whose conditions hold.

    ``rules`` has position (unique), vendor, rule, words, titles (arrays of lower-case texts that
    the row's text or title must contain) and ports (an array of which the row must have one; empty:
    any). A rule without any condition fits every row. ``key`` names a unique column of ``rows``.

    A rule meets rows by the one of its texts that the fewest have, or by its ports where it has no
    texts; what it meets is then judged by all its conditions.
    """
    listed = rules.select("position", "vendor", "rule", "words", "titles", "ports")
    bare = F.size("words") + F.size("titles") == 0
    pairs = F.concat(
        F.transform("words", lambda w: F.struct(F.lit("text").alias("scope"), w.alias("pattern"))),
        F.transform("titles", lambda w: F.struct(F.lit("title").alias("scope"), w.alias("pattern"))),
        F.when(bare & (F.size("ports") == 0), F.array(F.struct(F.lit("title").alias("scope"), F.lit("").alias("pattern")))).otherwise(
            F.array().cast("array<struct<scope:string,pattern:string>>")
        ),
    )
    terms = listed.select("position", F.explode(F.array_distinct(pairs)).alias("t")).select("position", "t.*")
    own = rows.select(
        F.col(f"`{key}`").alias("_key"),
        F.coalesce(ports, F.array().cast("array<int>")).alias("_ports"),
        F.lower(F.coalesce(text, F.lit(""))).alias("_text"),
        F.lower(F.coalesce(title, F.lit(""))).alias("_title"),
    )
    both = own.select("_key", F.explode(F.create_map(F.lit("text"), F.col("_text"), F.lit("title"), F.col("_title"))).alias("scope", "text"))
    hits = contained(both, terms)
    held = hits.groupBy("scope", "pattern").agg(F.count(F.lit(1)).alias("texts"))
    entry = (
        terms.join(held, ["scope", "pattern"], "left")
        .groupBy("position")
        .agg(F.min(F.struct("texts", "scope", "pattern")).alias("e"), F.count_if(F.col("texts").isNull()).alias("missing"))
        .where("missing = 0")
        .select("position", "e.scope", "e.pattern")
    )
    spoken = hits.join(entry, ["scope", "pattern"]).select("scope", "text", "position")
    by_text = both.join(spoken, ["scope", "text"]).select("_key", "position")
    by_port = (
        own.select("_key", F.explode("_ports").alias("_port"))
        .join(listed.where(bare).select("position", F.explode("ports").alias("_port")), "_port")
        .select("_key", "position")
        .distinct()
    )
    return (
        by_text.unionByName(by_port)
        .join(listed, "position")
        .join(own, "_key")
        .where(F.forall("words", lambda w: F.contains(F.col("_text"), w)) & F.forall("titles", lambda w: F.contains(F.col("_title"), w)))
        .where((F.size("ports") == 0) | F.coalesce(F.arrays_overlap("_ports", "ports"), F.lit(False)))
        .select(F.col("_key").alias(key), F.col("vendor").alias("rule_vendor"), "rule")
    )


def dictionary_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in vendor dictionary as the tables that ``vendor_dictionary`` reads from a landed one."""
    cves, firmware, place = [], [], {}
    for vendor, cve_id, cvss in C.VENDOR_CVES:
        cves.append((vendor, sum(c[0] == vendor for c in cves), cve_id, cvss))
    for position, (vendor, version, status) in enumerate(C.VENDOR_FIRMWARE):
        firmware.append((vendor, position, version, status))
    for position, (word, vendor) in enumerate(C.VENDOR_KEYWORDS):
        place.setdefault(word, (position, word, vendor))
    return {
        "vendors": spark.createDataFrame(list(C.VENDOR_RISK_LEVEL.items()), "vendor_key string, risk_level string"),
        "cves": spark.createDataFrame(cves, "vendor_key string, position int, cve_id string, cvss string"),
        "firmware": spark.createDataFrame(firmware, "vendor_key string, position int, firmware string, status string"),
        "keywords": spark.createDataFrame(list(place.values()), "position int, keyword string, vendor_key string"),
    }


def banner_rule_table(spark: SparkSession) -> DataFrame:
    """The built-in banner rules as the table that ``matched_rules`` takes."""
    rows = [(i, v, name, list(words), list(titles), list(ports)) for i, (v, name, words, titles, ports) in enumerate(C.BANNER_RULES)]
    return spark.createDataFrame(
        rows, "position int, vendor string, rule string, words array<string>, titles array<string>, ports array<int>"
    )


def vendor_risks(devices: DataFrame, dictionary: dict[str, DataFrame]) -> DataFrame:
    """``devices`` with vendor_key, firmware_risk, cve_component and matched_cves by the tables of a vendor dictionary.

    The component is the known firmware's risk, else the vendor's worst CVE, else 0.3. A vendor that
    no keyword names has no CVEs.

    Distinct vendor texts and versions are judged, step by step in written tables; devices join the verdicts once.
    """
    spark = devices.sparkSession
    names = {"_named": F.coalesce("vendor", F.lit("")), "_release": F.coalesce("firmware_version", F.lit(""))}
    seen = write_table(devices.select(*[c.alias(n) for n, c in names.items()]).distinct(), scratch_path(spark, "devices"))
    keyed = write_table(vendor_keys(seen, dictionary["keywords"], "_named"), scratch_path(spark, "vendors"))
    small = _is_small(dictionary["vendors"]) and _is_small(dictionary["cves"])
    known = _unbroadcast(vendor_cve_tables(dictionary["vendors"], dictionary["cves"]), small)
    judged = firmware_risks(keyed, dictionary["firmware"], "_release").join(known, "vendor_key", "left").select(
        *names,
        "vendor_key",
        "firmware_risk",
        F.coalesce("firmware_risk", "cve_risk", F.lit(0.3)).alias("_component"),
        F.coalesce("cve_ids", F.array().cast("array<string>")).alias("_cves"),
    )
    verdicts = write_table(judged, scratch_path(spark, "verdicts"))
    entries = verdicts.agg(F.coalesce(F.sum(F.size("_cves") + 1), F.lit(0))).first()[0]
    rows = devices.drop("vendor_key", "firmware_risk").withColumns(names)
    return rows.join(_unbroadcast(verdicts, entries <= SMALL), list(names), "left").select(
        *devices.columns, "vendor_key", "firmware_risk", F.col("_component").alias("cve_component"), F.col("_cves").alias("matched_cves")
    )
