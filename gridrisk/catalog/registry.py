"""Query registry: each id has a Spark callable and, where SQL can say it, a checking text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridrisk import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, tuple[str, Sequence[str]]] = {}
STEPS: dict[str, str] = {}
PLACES = 6


class Inputs:
    """Sample tables and derived views of one session and folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapters.VIEWS:
            return adapters.view(self.spark, self.sf_dir, name)
        if name in adapters.TABLES:
            return adapters.table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums of doubles differ in the last bits between engines."""
    picks = [
        F.round(F.col(f"`{f.name}`"), PLACES).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*picks)


def with_steps(body: str) -> str:
    """Prefix a SELECT with every named step and view it mentions, in dependency order."""
    known = {**{n: adapters.view_text(n) for n in adapters.VIEWS}, **STEPS}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in order) + "\n" + body.strip()


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register a query. ``doubles`` names the columns rounded on the checking side."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Inputs(spark, sf_dir)))
        if sql is not None:
            _CHECKS[name] = (sql, doubles)
        return build

    return add


def oracles() -> dict[str, str]:
    """Checking text of every query that has one; steps are resolved here, once all are known."""
    texts = {}
    for name, (sql, doubles) in _CHECKS.items():
        texts[name] = with_steps(sql)
        if doubles:
            swaps = ", ".join(f"round({c}, {PLACES}) AS {c}" for c in doubles)
            texts[name] = f"SELECT * REPLACE ({swaps}) FROM (\n{texts[name]}\n) q"
    return texts


# --- checking text fragments ---------------------------------------------------------------
def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_text(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def sql_digits(x: str, width: int) -> str:
    d = f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"
    return f"CASE WHEN {d} = '' THEN '' ELSE lpad(substring({d}, 1, {width}), {width}, '0') END"


def sql_state(x: str) -> str:
    return f"trim(upper(coalesce({x}, '')))"


def sql_contains_any(x: str, terms: Sequence[str]) -> str:
    quoted = [t.replace("'", "''") for t in terms]
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in quoted) + ")"


def sql_clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def sql_case(pairs: Sequence[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"
