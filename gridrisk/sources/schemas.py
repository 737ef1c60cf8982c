"""Declared schemas of the landed inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    """All-string landing schema; types are applied by the projection that follows."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CPE_MATCH = (
    "criteria string, vulnerable boolean, versionStartIncluding string, versionStartExcluding string, "
    "versionEndIncluding string, versionEndExcluding string"
)

_METRIC = (
    "array<struct<source:string,baseSeverity:string,cvssData:struct<version:string,"
    "vectorString:string,baseScore:double,baseSeverity:string>>>"
)

# Configuration nodes nest without limit, so they stay JSON text until products are exploded.
CVE_PAGE_SCHEMA = (
    "seq bigint, keyword string, "
    "vulnerabilities array<struct<cve:struct<id:string,published:string,lastModified:string,"
    "vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    "references:array<struct<url:string,source:string,tags:array<string>>>,"
    "weaknesses:array<struct<source:string>>,configurations:string>>>"
)

KEV_COLUMNS = [
    "cveID", "vendorProject", "product", "shortDescription", "requiredAction", "dateAdded",
    "dueDate", "knownRansomwareCampaignUse",
]

OBSERVATION_SCHEMA = (
    "seq bigint, query_vendor string, ip_str string, port int, transport string, data string, "
    "product string, os string, org string, isp string, asn string, hostnames array<string>, "
    "ports array<int>, timestamp string, observation_id string, "
    "http struct<title:string,status:int,html:string,headers:string>, "
    "ssl struct<cert:struct<subject:struct<CN:string>>>, "
    "location struct<country_code:string,country_name:string,region_code:string,city:string,"
    "latitude:double,longitude:double>"
)

DEVICE_SCHEMA = (
    "ingest_seq bigint, ip string, port int, transport string, vendor string, query_vendor string, "
    "product string, os string, country string, country_name string, region string, city string, "
    "lat double, lon double, org string, isp string, asn string, hostnames array<string>, "
    "http_title string, http_status int, has_tls boolean, tls_cert_subject string, "
    "open_ports array<int>, has_modbus boolean, has_mqtt boolean, default_creds_indicator boolean, "
    "firmware_version string, last_seen string, observation_id string"
)

CAPACITY_SCHEMA = "response struct<data:array<struct<location:string,capacity:string>>>"

VENDOR_DICTIONARY_SCHEMA = (
    "vendors map<string,struct<risk_level:string,cves:map<string,struct<cvss:string>>,"
    "firmware_intel:map<string,string>>>, keyword_to_vendor_map map<string,string>"
)

# Flat keys come first, then the nested groups that may hold the same value.
PROPERTY_RECORD_SCHEMA = (
    "Results string, AddressLine1 string, PostalCode string, City string, State string, "
    "Latitude string, Longitude string, YearBuilt string, PropertyType string, "
    "StructureStyle string, Bedrooms string, BathsTotal string, AreaBuilding string, "
    "LotAcres string, Stories string, OwnerName1 string, OwnerOccupied string, "
    "AssessedValueTotal string, MarketValueTotal string, SaleAmount string, SaleDate string, "
    "Address struct<AddressLine1:string,PostalCode:string,City:string,State:string>, "
    "GeoCode struct<Latitude:string,Longitude:string>, "
    "PropertyUseInfo struct<YearBuilt:string,PropertyType:string,StructureStyle:string>, "
    "IntRoomInfo struct<BedroomsCount:string,BathCount:string,StoriesCount:string>, "
    "PropertySize struct<AreaBuilding:string,AreaLotAcres:string>, "
    "PrimaryOwner struct<Name1Full:string,OwnerOccupied:string>, "
    "Tax struct<AssessedValueTotal:string,MarketValueTotal:string>, "
    "Valuation struct<EstimatedValue:string>, "
    "SaleInfo struct<DeedLastSalePrice:string,AssessorLastSaleAmount:string,"
    "DeedLastSaleDate:string,AssessorLastSaleDate:string>"
)
PROPERTY_RESPONSE_SCHEMA = f"request_id bigint, Records array<struct<{PROPERTY_RECORD_SCHEMA.replace(' string', ':string').replace(' struct', ':struct')}>>"
