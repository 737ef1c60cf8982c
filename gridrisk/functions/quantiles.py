"""Exact quantiles, global or per group, that never hold a large group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one hash map: right for
groups of bounded size, impossible once one group owns a large part of the table. So group sizes are
counted first. Groups up to the bound take the built-in, all columns and probabilities in one
aggregation. For the others a mergeable sketch brackets each quantile, then one more pass counts
what lies below the bracket and keeps only the values inside it. Both passes combine on the map
side, so a hot key leaves each task as a few rows, and the ordered step sees about ``2 * margin`` of
a group. Both ways give the same values; where no group is large, only the first is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table

_ACCURACY = 10_000
_MARGIN = 5e-4
_BELOW = float("-inf")
# Rows of a group whose values one task may hold.
_DIRECT = 100_000


def _picked(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str],
    accuracy: int,
) -> DataFrame:
    """One row ``(*by, name, n, slot, q)`` per group, column and probability."""
    by = list(by)
    margin = _MARGIN * _ACCURACY / accuracy
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    values = (
        df.select(*by, F.explode(pairs).alias("pair"))
        .select(*by, "pair.name", "pair.value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    keys = [*by, "name"]

    low = [max(0.0, p - margin) for p in probs]
    high = [min(1.0, p + margin) for p in probs]
    brackets = (
        values.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("value", low + high, accuracy).alias("cuts"),
        )
        .select(*[F.col(k).alias(f"_b_{k}") for k in keys], "n", "cuts")
    )

    # One row per (value, quantile it may be); values under a bracket only need to be counted.
    small = F.col("n") <= F.lit(accuracy)  # the sketch is exact anyway, and holds so many values
    slots = []
    for i, p in enumerate(probs):
        lo, hi = F.col("cuts")[i], F.col("cuts")[len(probs) + i]
        candidate = (
            F.when(small, F.col("value"))
            .when(F.col("value") < lo, F.lit(_BELOW))
            .when(F.col("value") <= hi, F.col("value"))
        )
        slots.append(
            F.struct(
                F.lit(i).alias("slot"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("at"),
                candidate.alias("candidate"),
            )
        )
    condition = F.col("name") == F.col("_b_name")
    for k in by:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    counted = (
        # Only groups above the bound have a bracket, so these rows are few; values must not go to one task a name.
        values.join(F.broadcast(brackets), condition)
        .select(*keys, "n", F.explode(F.array(*slots)).alias("s"))
        .select(*keys, "n", "s.slot", "s.at", "s.candidate")
        .filter(F.col("candidate").isNotNull())
        .groupBy(*keys, "n", "slot", "at", "candidate")
        .agg(F.count(F.lit(1)).alias("c"))
    )

    order = Window.partitionBy(*keys, "n", "slot", "at").orderBy("candidate")
    ranked = counted.withColumn("upto", F.sum("c").over(order)).withColumn("before", F.col("upto") - F.col("c"))
    first, second = F.floor("at"), F.ceil("at")

    def holds(index):
        return (F.col("before") <= index) & (index < F.col("upto"))

    return (
        ranked.filter(holds(first) | holds(second))
        .groupBy(*keys, "n", "slot", "at")
        .agg(F.min("candidate").alias("a"), F.max("candidate").alias("b"))
        .select(
            *keys,
            "n",
            "slot",
            (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q"),
        )
    )


def _direct(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``(*by, name, n, q)`` by the built-in, one wide aggregation for all columns."""
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    stats = [
        F.struct(
            F.lit(c).alias("name"),
            F.count(v).alias("n"),
            F.percentile(v, F.array(*[F.lit(float(p)) for p in probs])).alias("q"),
        )
        for c, v in values.items()
    ]
    wide = df.groupBy(*by).agg(*[s.alias(f"_s{i}") for i, s in enumerate(stats)])
    listed = F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(stats))]))
    return wide.select(*by, listed.alias("s")).select(*by, "s.*").filter("n > 0")


def _quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], accuracy: int,
               direct: int) -> DataFrame:
    columns = list(dict.fromkeys(columns))
    # The input is computed once; what follows reads the written columns, and only as often as its groups ask for.
    rows = write_table(df.select(*dict.fromkeys([*by, *columns])), scratch_path(df.sparkSession, "quantiles"))
    sizes = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in by]).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= direct:
        return _direct(rows, columns, probs, by)
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))

    def part(condition: str) -> DataFrame:
        if not by:
            return rows.withColumn("_rows", sizes.scalar()).filter(condition)
        return rows.join(sizes.filter(condition), same)

    bracketed = _picked(part(f"_rows > {direct}"), columns, probs, by, accuracy).groupBy(*by, "name", "n").agg(
        F.array(*[F.max(F.when(F.col("slot") == i, F.col("q"))) for i in range(len(probs))]).alias("q")
    )
    return _direct(part(f"_rows <= {direct}"), columns, probs, by).unionByName(bracketed)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = _ACCURACY,
    direct: int = _DIRECT,
) -> DataFrame:
    """Rows ``(*by, name, n, q)``: ``q`` holds one linearly interpolated quantile per probability.

    Nulls and NaN are skipped. A group without any value of a column has no row for it.
    """
    return _quantiles(df, columns, probs, by, accuracy, direct)


def exact_medians(
    df: DataFrame, medians: dict[str, str], by: Sequence[str] = (), accuracy: int = _ACCURACY, direct: int = _DIRECT
) -> DataFrame:
    """One row per group with ``{output name: input column}`` medians."""
    found = _quantiles(df, list(medians.values()), [0.5], by, accuracy, direct)
    picks = [
        F.max(F.when(F.col("name") == source, F.col("q")[0])).alias(target) for target, source in medians.items()
    ]
    return found.groupBy(*by).agg(*picks)
