"""Parcels, valuations and geography → enriched parcels → community features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridrisk import constants as C
from gridrisk.functions import text as X
from gridrisk.functions.numeric import as_count, share
from gridrisk.functions.quantiles import exact_medians


def land_use_flags(df: DataFrame) -> DataFrame:
    use = F.lower(F.coalesce(F.col("land_use"), F.lit("")))
    return df.withColumns(
        {
            "is_residential": use.contains("residential"),
            "is_single_family": use.contains("single family"),
        }
    )


def property_age(year_built: Column, reference_year: int = C.REFERENCE_YEAR) -> Column:
    return F.lit(reference_year) - year_built


def _clean_address_key(address: str) -> Column:
    """Address key over columns whose state and ZIP are normalised already."""
    return F.concat_ws("|", X.norm_text(F.col(address)), X.norm_text(F.col("city")), "state", "zip_code")


def normalize_parcels(df: DataFrame, reference_year: int = C.REFERENCE_YEAR) -> DataFrame:
    """Clean keys, derive the two join keys, the land-use flags and the age."""
    keyed = df.withColumns(
        {
            "state": X.norm_state(F.col("state")),
            "zip_code": X.norm_zip(F.col("zip_code")),
            "zip4": X.norm_zip4(F.col("zip4")),
            "fips_code": X.norm_fips(F.col("fips_code")),
        }
    )
    return land_use_flags(keyed).withColumns(
        {
            "address_key": _clean_address_key("property_address"),
            "geo_join_key": F.concat_ws("|", "state", "zip_code", "zip4"),
            "property_age": property_age(F.col("year_built"), reference_year),
        }
    )


def normalize_avm(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "state": X.norm_state(F.col("state")),
            "zip_code": X.norm_zip(F.col("zip_code")),
        }
    ).withColumn("address_key", _clean_address_key("address"))


def normalize_geo(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "geo_fips_code": X.norm_fips(F.col("geo_fips_code")),
            "geo_join_key": X.geo_join_key(F.col("state"), F.col("zip_code"), F.col("zip4")),
        }
    )


def semi_avm_prefilter(avm: DataFrame, parcels: DataFrame) -> DataFrame:
    """Valuations whose state occurs among the parcels and whose ZIP does, independently.

    One distinct (state, zip) pass feeds both lists. There is no hint: Spark broadcasts a list whose
    measured size allows it and splits a skewed valuation side otherwise.
    """
    places = parcels.select("state", "zip_code").distinct()
    zips, states = places.select("zip_code").distinct(), places.select("state").distinct()
    return avm.join(zips, "zip_code", "left_semi").join(states, "state", "left_semi")


def first_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark limits each key before the shuffle, so hot keys stay small."""
    keys = [key] if isinstance(key, str) else key
    return (
        df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("_rank") <= 1)
        .drop("_rank")
    )


def latest_avm(avm: DataFrame) -> DataFrame:
    """Newest valuation per address; undated ones last, ties by lowest id."""
    return first_per_key(
        avm, "address_key", F.col("valuation_date").desc_nulls_last(), F.col("record_id_avm").asc()
    )


def first_geo(geo: DataFrame) -> DataFrame:
    return first_per_key(geo, "geo_join_key", F.col("record_id_geo").asc_nulls_last())


def join_parcel_avm(parcels: DataFrame, avm: DataFrame) -> DataFrame:
    """Left join to the one valuation of each address; the row count never grows."""
    right = avm.select(
        "address_key",
        F.col("record_id_avm").alias("avm_record_id"),
        F.col("final_value").alias("final_value"),
        F.col("high_value").alias("avm_high_value"),
        F.col("low_value").alias("avm_low_value"),
        F.col("valuation_date").alias("avm_valuation_date"),
    )
    return parcels.join(right, "address_key", "left")


def join_parcel_geo(parcels: DataFrame, geo: DataFrame) -> DataFrame:
    right = geo.select(
        "geo_join_key",
        "geo_fips_code",
        "geo_census_key",
        "geo_census_key_decennial",
        "geo_latitude",
        "geo_longitude",
    )
    return parcels.join(right, "geo_join_key", "left")


def match_flags(df: DataFrame) -> DataFrame:
    """``matched_geo`` asks for a census key, not merely for a joined row."""
    return df.withColumns(
        {
            "matched_avm": F.col("avm_record_id").isNotNull(),
            "matched_geo": F.col("geo_census_key").isNotNull(),
        }
    )


def effective_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "effective_fips_code": F.when(F.col("fips_code") != "", F.col("fips_code")).otherwise(
                F.col("geo_fips_code")
            ),
            "effective_census_key": F.coalesce("census_key", "geo_census_key"),
            "effective_census_key_decennial": F.coalesce("census_key_decennial", "geo_census_key_decennial"),
            "effective_latitude": F.coalesce("latitude", "geo_latitude"),
            "effective_longitude": F.coalesce("longitude", "geo_longitude"),
        }
    )


def value_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "value_spread": F.col("avm_high_value") - F.col("avm_low_value"),
            "assessed_to_avm_ratio": F.try_divide(F.col("total_assessed_value"), F.col("final_value")),
        }
    )


def parcel_flags(df: DataFrame) -> DataFrame:
    worth = F.coalesce(F.col("final_value"), F.col("total_assessed_value"))
    return df.withColumns(
        {
            "has_garage": F.coalesce(F.col("garage_cars"), F.lit(0)) > 0,
            "high_value_home": F.coalesce(worth >= C.HIGH_VALUE_HOME, F.lit(False)),
            "solar_candidate_home": F.coalesce(F.col("is_residential"), F.lit(False))
            & (F.coalesce(F.col("number_of_units"), F.lit(0)) <= 2)
            & F.col("effective_latitude").isNotNull()
            & F.col("effective_longitude").isNotNull(),
        }
    )


ENRICHED_COLUMNS = [
    "record_id", "property_address", "city", "state", "zip_code", "zip4", "effective_fips_code",
    "effective_census_key", "effective_census_key_decennial", "effective_latitude",
    "effective_longitude", "land_use", "total_assessed_value", "assessment_year", "sales_price",
    "final_value", "avm_high_value", "avm_low_value", "value_spread", "avm_valuation_date",
    "lot_size", "lot_size_unit", "year_built", "property_age", "rooms", "bedrooms", "baths",
    "partial_baths", "stories", "number_of_buildings", "number_of_units", "garage_cars",
    "has_security_alarm", "is_residential", "is_single_family", "has_garage", "high_value_home",
    "solar_candidate_home", "matched_avm", "matched_geo", "assessed_to_avm_ratio",
]


def enrich_parcels(parcels: DataFrame, avm: DataFrame, geo: DataFrame, state: str | None = None) -> DataFrame:
    """The 41-column parcel table from the three raw tables."""
    left = normalize_parcels(parcels)
    if state:
        left = left.filter(F.col("state") == state.upper())
    values = latest_avm(semi_avm_prefilter(normalize_avm(avm), left))
    joined = join_parcel_geo(join_parcel_avm(left, values), first_geo(normalize_geo(geo)))
    full = parcel_flags(value_features(effective_columns(match_flags(joined))))
    return full.select(*[c for c in ENRICHED_COLUMNS if c in full.columns])


def filter_valid_group_key(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))


COMMUNITY_MEDIANS = {
    "median_assessed_value": "total_assessed_value",
    "median_final_value": "final_value",
    "median_lot_size": "lot_size",
    "median_year_built": "year_built",
    "median_property_age": "property_age",
    "median_bedrooms": "bedrooms",
    "median_baths": "baths",
}


def community_agg(parcels: DataFrame, key: str) -> DataFrame:
    """19 aggregates and 5 rates per community key; hot keys combine before every shuffle."""
    return _community(filter_valid_group_key(parcels, key), [key])


def community_agg_levels(parcels: DataFrame, levels: dict[str, str]) -> DataFrame:
    """``level, geo_id`` and the aggregates of ``community_agg`` for several keys (level → column) in one pass.

    Every row stands once for each of its keys, and all levels are aggregated together.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).cast("string").alias("geo_id")) for n, c in levels.items()]))
    rows = parcels.withColumn("_key", keys).withColumns({"level": F.col("_key.level"), "geo_id": F.col("_key.geo_id")}).drop("_key")
    return _community(filter_valid_group_key(rows, "geo_id"), ["level", "geo_id"])


def _community(valid: DataFrame, by: list[str]) -> DataFrame:
    counts = valid.groupBy(*by).agg(
        F.count("record_id").alias("parcel_count"),
        as_count(F.col("is_residential")).alias("residential_parcel_count"),
        as_count(F.col("is_single_family")).alias("single_family_count"),
        as_count(F.col("solar_candidate_home")).alias("solar_candidate_count"),
        as_count(F.col("matched_avm")).alias("matched_avm_count"),
        as_count(F.col("matched_geo")).alias("matched_geo_count"),
        F.avg("total_assessed_value").alias("mean_assessed_value"),
        F.avg("final_value").alias("mean_final_value"),
        F.avg("number_of_units").alias("avg_units"),
        F.avg("number_of_buildings").alias("avg_buildings"),
        share(F.col("has_garage")).alias("garage_share"),
        share(F.col("high_value_home")).alias("high_value_share"),
    )
    medians = exact_medians(valid, COMMUNITY_MEDIANS, by=by)

    def rate(column: str) -> Column:
        return F.try_divide(F.col(column).cast("double"), F.col("parcel_count"))

    return counts.join(medians, by, "left").withColumns(
        {
            "residential_share": rate("residential_parcel_count"),
            "single_family_share": rate("single_family_count"),
            "solar_candidate_share": rate("solar_candidate_count"),
            "avm_match_rate": rate("matched_avm_count"),
            "geo_match_rate": rate("matched_geo_count"),
        }
    )


def sort_parcels(df: DataFrame) -> DataFrame:
    """State, ZIP, city, address; ties by record id."""
    return df.orderBy("state", "zip_code", "city", F.col("property_address").asc_nulls_last(), "record_id")
