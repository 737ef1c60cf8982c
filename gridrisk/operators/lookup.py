"""Address splitting, property response flattening and community lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk import constants as C
from gridrisk.functions.numeric import half_even
from gridrisk.functions.text import empty_to_null, to_number


def address_split(address: Column) -> Column:
    """``street, city, ST zip`` → struct of four texts; missing parts are ''."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))

    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    pattern = r"^([A-Za-z]{2})\s*(\d{5})?"
    return F.struct(
        part(0).alias("street"),
        part(1).alias("city"),
        F.upper(F.regexp_extract(part(2), pattern, 1)).alias("state"),
        F.coalesce(F.regexp_extract(part(2), pattern, 2), F.lit("")).alias("zip"),
    )


def filter_result_codes(records: DataFrame, column: str = "Results") -> DataFrame:
    """Records whose result string has any match code."""
    return records.filter(F.coalesce(F.col(column), F.lit("")).rlike("|".join(C.PROPERTY_MATCH_CODES)))


def _positive(value: Column) -> Column:
    number = to_number(value)
    return F.when(number > 0, number)


def _positive_int(value: Column) -> Column:
    number = F.trim(value).try_cast("bigint")
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$") & (number > 0), number)


def property_flatten(responses: DataFrame) -> DataFrame:
    """First record of each response → typed property row; unmatched responses are left out."""
    first = responses.select("request_id", F.get("Records", F.lit(0)).alias("r")).filter(F.col("r").isNotNull())
    matched = filter_result_codes(first, "r.Results")

    def pick(*paths: str) -> Column:
        return F.coalesce(*[empty_to_null(F.col(f"r.{p}")) for p in paths], F.lit(""))

    occupied = pick("OwnerOccupied", "PrimaryOwner.OwnerOccupied")
    return matched.select(
        "request_id",
        pick("AddressLine1", "Address.AddressLine1").alias("address"),
        F.substring(pick("PostalCode", "Address.PostalCode"), 1, 5).alias("zip_code"),
        pick("City", "Address.City").alias("city"),
        pick("State", "Address.State").alias("state"),
        _positive(pick("Latitude", "GeoCode.Latitude")).alias("lat"),
        _positive(pick("Longitude", "GeoCode.Longitude")).alias("lon"),
        _positive_int(pick("YearBuilt", "PropertyUseInfo.YearBuilt")).alias("year_built"),
        pick("PropertyType", "PropertyUseInfo.PropertyType").alias("property_type"),
        pick("StructureStyle", "PropertyUseInfo.StructureStyle").alias("structure_style"),
        _positive_int(pick("Bedrooms", "IntRoomInfo.BedroomsCount")).alias("bedrooms"),
        _positive(pick("BathsTotal", "IntRoomInfo.BathCount")).alias("baths"),
        _positive_int(pick("AreaBuilding", "PropertySize.AreaBuilding")).alias("sq_ft"),
        _positive(pick("LotAcres", "PropertySize.AreaLotAcres")).alias("lot_size"),
        _positive_int(pick("Stories", "IntRoomInfo.StoriesCount")).alias("stories"),
        pick("OwnerName1", "PrimaryOwner.Name1Full").alias("owner_name"),
        F.when(occupied.isin("Y", "O"), F.lit(True)).when(occupied.isin("N", "R"), F.lit(False)).alias("owner_occupied"),
        _positive(pick("AssessedValueTotal", "Tax.AssessedValueTotal")).alias("assessed_value"),
        _positive(pick("MarketValueTotal", "Tax.MarketValueTotal", "Valuation.EstimatedValue")).alias("market_value"),
        _positive(pick("SaleAmount", "SaleInfo.DeedLastSalePrice", "SaleInfo.AssessorLastSaleAmount")).alias(
            "last_sale_price"
        ),
        pick("SaleDate", "SaleInfo.DeedLastSaleDate", "SaleInfo.AssessorLastSaleDate").alias("last_sale_date"),
    )


def join_zip_lookup(properties: DataFrame, communities: DataFrame, zip_column: str = "zip_code") -> DataFrame:
    """Community figures of each property's ZIP, rounded as the service shows them.

    The planner broadcasts the community side when it measures small enough, else it shuffles.
    """
    info = communities.select(
        F.col("geo_id"),
        "state",
        half_even(F.col("community_risk_prior_score"), 1).alias("risk_score"),
        half_even(F.col("solar_readiness_score"), 1).alias("solar_readiness"),
        half_even(F.col("solar_cyber_pressure_score"), 1).alias("cyber_pressure"),
        half_even(F.col("solar_candidate_share"), 3).alias("solar_candidate_share"),
        half_even(F.col("single_family_share"), 3).alias("single_family_share"),
        half_even(F.col("owner_occupancy_rate"), 3).alias("owner_occupancy_rate"),
        "median_home_value",
        F.col("median_household_income").alias("median_income"),
        F.col("total_housing_units").cast("bigint").alias("total_units"),
    )
    left = properties.drop("state") if "state" in properties.columns else properties
    return left.join(info, left[zip_column] == info["geo_id"], "left")
