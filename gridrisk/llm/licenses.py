"""License scans: canonical digests of whole texts, looked up among the digests of known licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import ascii_lower

#: Spellings that licenses use alike, as (found, canonical).
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("noncommercial", "non commercial"),
    ("percent", "per cent"),
    ("whilst", "while"),
    ("https", "http"),
)
#: A line that names a holder: the word with a sign, ``(c)`` or a year behind it, or the sign or ``(c)`` and a year;
#: or the line that reserves all rights.
COPYRIGHT = r"^[ \t\r]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved[.]?[ \t\r]*$)"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without copyright lines and empty ones."""

    def canonical(line: Column) -> Column:
        # Doubled spaces give every word its own pair, so neighbours are both replaced.
        words = F.concat(F.lit(" "), F.regexp_replace(line, PUNCTUATION, "  "), F.lit(" "))
        for found, wanted in SPELLINGS:
            words = F.replace(words, F.lit(f" {found} "), F.lit(f" {wanted} "))
        return F.trim(F.regexp_replace(words, " +", " "))

    lines = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda line: ~line.rlike(COPYRIGHT))
    return F.filter(F.transform(lines, canonical), lambda line: line != "")


def license_digests(known: DataFrame) -> DataFrame:
    """``digest``, ``license_id`` of the known texts; of equal texts the smallest id. Empty texts are left out."""
    whole = F.array_join(canonical_lines(known["text"]), " ")
    return (
        known.select(F.sha2(whole, 256).alias("digest"), "license_id", whole.alias("whole"))
        .where("whole <> '' AND license_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, digest, license_id of the whole text, notices.

    ``digest`` is of the whole canonical text, ``license_id`` the known license with that digest
    or null. ``notices`` lists, sorted and comma-joined, the licenses whose entire text is a single
    line of the document (short notices stand in longer texts); empty if there is none.

    A null text counts as empty; an empty canonical text matches nothing. Repeated rows give
    repeated results. Other columns of ``docs`` are not read.

    The lines travel only as digests, are met with the digests of known licenses in a hash join,
    and only those found are grouped; a row is known by its doc_id and digest, so equal rows share
    one group and no text is shuffled.
    """
    digests = license_digests(known)
    lines = canonical_lines(docs["text"])
    rows = docs.select("doc_id", F.sha2(F.array_join(lines, " "), 256).alias("digest"), F.size(lines).alias("n"), lines.alias("lines"))
    found = (
        rows.select("doc_id", "digest", F.explode(F.array_distinct("lines")).alias("line"))
        .select("doc_id", "digest", F.sha2("line", 256).alias("line_digest"))
        .join(digests.withColumnsRenamed({"digest": "line_digest", "license_id": "notice"}), "line_digest")
        .groupBy("doc_id", "digest")
        .agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    )
    left = rows.select("doc_id", "digest", "n").alias("r")
    return (
        left.join(digests.alias("k"), (F.col("r.digest") == F.col("k.digest")) & (F.col("r.n") > 0), "left")
        .select("r.doc_id", "r.digest", "k.license_id")
        .alias("w")
        .join(
            found.alias("f"),
            F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.digest") == F.col("f.digest")),
            "left",
        )
        .select("w.doc_id", "w.digest", "w.license_id", F.coalesce("f.notices", F.lit("")).alias("notices"))
    )
