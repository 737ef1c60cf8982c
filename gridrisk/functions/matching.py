"""Ordered first-match rules over short fixed lists, as native expressions.

The rule lists are program constants of a dozen entries, so they are literals in the plan: no
join, no shuffle, and the first match by list position is the first branch that holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.text import contains_any, empty_to_null, whole_word_pattern


def first_match(branches: Sequence[tuple[Column, Column]], default: Column) -> Column:
    if not branches:
        return default
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def identify_vendor(
    banner: Column,
    product: Column,
    title: Column,
    html: Column,
    fallback: Column | None = None,
    rules: Sequence[tuple[str, Sequence[str]]] = C.BANNER_VENDOR_KEYWORDS,
) -> Column:
    """Vendor named by an observation, reading the whole page."""
    text = F.lower(
        F.concat_ws(" ", *[F.coalesce(part, F.lit("")) for part in (banner, product, title, html)])
    )
    default = F.lit("Unknown") if fallback is None else F.coalesce(fallback, F.lit("Unknown"))
    return first_match([(contains_any(text, words), F.lit(v)) for v, words in rules], default)


def default_credentials(banner: Column) -> Column:
    return contains_any(F.lower(F.coalesce(banner, F.lit(""))), C.DEFAULT_CREDENTIAL_HINTS)


def firmware_version(banner: Column, headers: Column, html: Column) -> Column:
    """First version number found; all patterns are tried on one text before the next text."""
    hits = [
        empty_to_null(F.regexp_extract(text, "(?i)" + pattern, 1))
        for text in (banner, headers, html)
        for pattern in C.FIRMWARE_PATTERNS
    ]
    return F.coalesce(*hits)


def vendor_key(
    vendor: Column,
    keywords: Sequence[tuple[str, str]] = C.VENDOR_KEYWORDS,
    whole_word: bool = False,
) -> Column:
    """Dictionary key of the first keyword contained in the vendor text, else null."""
    text = F.lower(F.coalesce(vendor, F.lit("")))

    def hit(word: str) -> Column:
        return text.rlike(whole_word_pattern([word])) if whole_word else text.contains(word)

    return first_match([(hit(word), F.lit(key)) for word, key in keywords], F.lit(None).cast("string"))


def firmware_risk(
    key: Column,
    firmware: Column,
    intel: Sequence[tuple[str, str, str]] = C.VENDOR_FIRMWARE,
) -> Column:
    """Risk of the first listed firmware where either text contains the other, else null."""
    text = F.lower(F.coalesce(firmware, F.lit("")))
    branches = []
    for vendor, listed, status in intel:
        known = F.lit(listed.lower())
        risk = F.lit(C.FIRMWARE_STATUS_RISK[status])
        branches.append(((key == vendor) & (text != "") & (text.contains(known) | known.contains(text)), risk))
    return first_match(branches, F.lit(None).cast("double"))


def worst_cve_risk(
    key: Column,
    cves: Sequence[tuple[str, str, str]] = C.VENDOR_CVES,
    levels: dict[str, str] = C.VENDOR_RISK_LEVEL,
) -> Column:
    """Risk band of a vendor's worst CVE; a vendor without CVEs goes by its risk level."""
    branches = []
    for vendor, level in levels.items():
        scores = [_score(text) for v, _, text in cves if v == vendor]
        if scores:
            risk = max(_band(s) for s in scores)
        else:
            risk = 1.0 if level == "CRITICAL" else 0.7
        branches.append((key == vendor, F.lit(risk)))
    return first_match(branches, F.lit(None).cast("double"))


def _score(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 7.0


def _band(score: float) -> float:
    return 1.0 if score >= 9.0 else 0.7 if score >= 7.0 else 0.4 if score >= 4.0 else 0.0


def vendor_cves(key: Column, cves: Sequence[tuple[str, str, str]] = C.VENDOR_CVES) -> Column:
    """CVE ids of a vendor in dictionary order; empty when none is known."""
    listed: dict[str, list[str]] = {}
    for vendor, cve_id, _ in cves:
        listed.setdefault(vendor, []).append(cve_id)
    branches = [(key == v, F.array(*[F.lit(i) for i in ids])) for v, ids in listed.items()]
    return first_match(branches, F.array().cast("array<string>"))


def matched_keywords(text: Column, vendors: Sequence[str]) -> Column:
    """The configured vendors contained in a text, in configured order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(lowered.contains(v.lower()), F.lit(v)) for v in vendors]
    return F.array_compact(F.array(*hits))


def matched_banner_rules(
    text: Column,
    title: Column,
    ports: Column,
    rules: Sequence[tuple[str, str, list[str], list[str], list[int]]] = C.BANNER_RULES,
) -> Column:
    """Array of ``(vendor, rule)`` for every rule an observation satisfies, in rule order."""
    body = F.lower(F.coalesce(text, F.lit("")))
    head = F.lower(F.coalesce(title, F.lit("")))
    hits = []
    for vendor, name, words, titles, wanted in rules:
        condition = F.lit(True)
        for word in words:
            condition = condition & body.contains(word)
        for word in titles:
            condition = condition & head.contains(word)
        if wanted:
            condition = condition & F.arrays_overlap(ports, F.array(*[F.lit(p) for p in wanted]))
        hits.append(F.when(condition, F.struct(F.lit(vendor).alias("vendor"), F.lit(name).alias("rule"))))
    return F.array_compact(F.array(*hits))
