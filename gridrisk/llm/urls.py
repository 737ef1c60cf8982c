"""URL filters: allow and block entries in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.llm.common import ascii_lower, packed, ship, written

#: Entries of one broadcast trie; a longer list is walked in several tries, one after the other.
BLOCK_RULES = 200_000

MATCH = T.StructType(
    [
        T.StructField("length", T.IntegerType()),
        T.StructField("host_length", T.IntegerType()),
        T.StructField("blocks", T.IntegerType()),
        T.StructField("rule", T.StringType()),
    ]
)


class RuleTrie:
    """Host labels from the right, then path segments; a rule may end inside a segment.

    A node is ``(children, paths)``; a path node is ``(children, rule, tails)``, where ``tails``
    maps the begun last segment of a rule to that rule.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: tuple[dict, list] = ({}, [])
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, ({}, []))
            if not node[1]:
                node[1].append([{}, None, {}])
            at = node[1][0]
            *segments, tail = path.split("/")
            for segment in segments:
                at = at[0].setdefault(segment, [{}, None, {}])
            entry = (len(host) + len(path), len(host), int(verdict == "block"), host + path)
            if tail:
                at[2][tail] = max(entry, at[2].get(tail, entry))
            else:
                at[1] = max(entry, at[1] or entry)

    def longest(self, host: str, path: str) -> tuple[int, int, int, str] | None:
        best, node, end = None, self.root, len(host)
        while True:
            if node[1]:
                best = max(filter(None, (best, self._along(node[1][0], path))), default=None)
            if end <= 0:
                return best
            begin = host.rfind(".", 0, end)
            node = node[0].get(host[begin + 1 : end])
            if node is None:
                return best
            end = begin

    @staticmethod
    def _along(at: list, path: str) -> tuple[int, int, int, str] | None:
        best, begin = None, 0
        while True:
            if at[1]:
                best = max(best or at[1], at[1])
            end = path.find("/", begin)
            if at[2]:
                segment = path[begin:] if end < 0 else path[begin:end]
                for cut in range(1, len(segment) + 1):
                    if found := at[2].get(segment[:cut]):
                        best = max(best or found, found)
            if end < 0 or not (at := at[0].get(path[begin:end])):
                return best
            begin = end + 1


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.coalesce(F.substring(url, F.length(rest) + 4, F.length(url)), F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def trie_udf(shared):
    """Longest match of (host, path) columns among the broadcast rules; the trie is built once per partition."""

    @F.pandas_udf(MATCH)
    def longest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = RuleTrie(shared.value)
        for hosts, paths in parts:
            found = [trie.longest(h, p) or (None,) * 4 for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=MATCH.names).astype(
                {"length": "Int32", "host_length": "Int32", "blocks": "Int32", "rule": object}
            )

    return longest


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES
) -> DataFrame:
    """``pages`` with ``judged``: struct of host, path, rule and verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest host and path together wins,
    then the longer host, then ``block``. Without a fitting rule the verdict is ``default``.

    A null URL or one without ``://`` has an empty host and path. Rules without a host or a path
    take the empty one, those without a verdict are left out. Repeated rows are judged alike and
    stay. An extra column called ``judged`` is replaced; all others are kept.

    The list is split by hash into tries of about ``block_rules`` entries; each trie is broadcast
    alone, and a written table stands between two of them.
    """
    ship(pages.sparkSession)
    rules = rules.select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where(F.col("verdict").isNotNull())
    blocks = max(1, -(-rules.count() // block_rules))
    none = F.lit(None).cast(MATCH)
    out = pages.select(
        packed(pages, "judged").alias("row"),
        *[part.alias(name) for part, name in zip(url_parts(pages[url]), ("host", "path"), strict=True)],
        none.alias("best"),
    )
    for block in range(blocks):
        mine = rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == block)
        shared = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])

        longest = trie_udf(shared)
        # A match without a rule is a struct of nulls; a null struct loses against any other.
        match = longest("host", "path")
        out = out.withColumn("match", match).withColumn(
            "best", F.greatest("best", F.when(F.col("match.length").isNotNull(), F.col("match")))
        ).drop("match")
        if block + 1 < blocks:
            out = written(out, "judged-urls")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks") == 1, "block").otherwise("allow")
    return out.select(
        "row.*", F.struct("host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")).alias("judged")
    )
