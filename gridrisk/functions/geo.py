"""ZIP to state, state weights and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridrisk import constants as C

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def zip3_state(geo_id: Column, fill_gaps: bool = False) -> Column:
    """State of the three leading ZIP digits; null for unmapped prefixes.

    The range table becomes one constant array of 1,000 entries, indexed by the prefix.
    """
    states = [""] * 1000
    for lo, hi, state in C.ZIP3_RANGES + (C.ZIP3_GAP_RANGES if fill_gaps else []):
        states[lo : hi + 1] = [state] * (hi + 1 - lo)
    table = F.split(F.lit(",".join(states)), ",")
    prefix = F.regexp_extract(geo_id, "^([0-9]{3})", 1).try_cast("int")
    return F.nullif(F.get(table, prefix), F.lit(""))


def state_capacity() -> dict[str, float]:
    """Reported state capacity, with estimates only where no report exists."""
    reported = {code: gw for code, gw, _ in C.STATE_GRID}
    return {**C.STATE_GRID_ESTIMATES, **reported}


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a key in a short constant table."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    value = F.try_element_at(entries, key)
    return value if default is None else F.coalesce(value, default)


def state_weight(state: Column, capacity: dict[str, float] | None = None) -> Column:
    """Log-scaled capacity weight in [0.1, 1]; unmapped states get the floor."""
    table = capacity or state_capacity()
    top = math.log1p(max(table.values()))
    weights = {s: max(C.MIN_STATE_WEIGHT, round(math.log1p(gw) / top, 4)) for s, gw in table.items()}
    return lookup(state, weights, F.lit(C.MIN_STATE_WEIGHT))


def region_capacity(code: Column) -> Column:
    """GW of a country or state code: countries first, then states, else the fallback.

    ``CA`` is therefore California, and ``US`` gets the fallback.
    """
    table = {c: gw for c, gw, _ in C.STATE_GRID} | {c: gw for c, gw, _ in C.EUROPE_GRID}
    return lookup(code, table, F.lit(C.UNKNOWN_REGION_GW))


def critical_regions() -> list[str]:
    """Grid-critical countries together with the critical states."""
    countries = [code for code, _, critical in C.EUROPE_GRID if critical]
    return sorted(set(countries) | set(C.EXTRA_CRITICAL_STATES))


def is_critical_region(code: Column) -> Column:
    return F.coalesce(code.isin(critical_regions()), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))
