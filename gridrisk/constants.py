"""Fixed values shared by the operators.

Everything in this module is a fixed lookup value: it has to equal the published rule set for
the scores to come out the same, so it is stated plainly and nowhere else.
"""

from __future__ import annotations

# --- fixed values: curation of vulnerable products -----------------------------------------
VENDOR_ALLOWLIST = {
    "growatt": "Growatt",
    "sungrowpower": "Sungrow",
    "sungrow": "Sungrow",
    "sma": "SMA",
    "sma_solar_technology_ag": "SMA",
    "solarview": "SolarView",
    "goodwe": "GoodWe",
    "enphase": "Enphase",
    "ginlong": "Ginlong",
    "solis": "Solis",
    "deye": "Deye",
    "bosswerk": "Bosswerk",
    "fronius": "Fronius",
    "solaredge": "SolarEdge",
    "tesla": "Tesla",
    "huawei": "Huawei",
    "fusionsolar": "Huawei",
}

VENDOR_DENYLIST = [
    "canonical", "linux", "oracle", "sun", "solarwinds", "envoyproxy",
    "austin_group", "redhat", "cncf", "cilium", "pomerium", "istio",
]

# Matched as whole words.
RELEVANT_TERMS = [
    "growatt", "sungrow", "sma", "solarview", "goodwe", "enphase", "ginlong", "solis", "deye",
    "fusionsolar", "sunny portal", "sunny webbox", "isolarcloud", "winet", "shinelan",
    "shinewifi", "solaredge", "fronius", "bosswerk", "revolt", "microinverter",
]

# Matched as substrings.
KEV_TERMS = [
    "solar", "photovoltaic", "inverter", "growatt", "shinewifi", "shinelan", "sungrow",
    "isolarcloud", "winet", "sma", "sunny", "solarview", "fusionsolar", "goodwe", "sems",
    "solis", "ginlong", "enphase", "envoy", "deye",
]

ALERT_VENDORS = ["sungrow", "growatt", "sma", "solaredge", "enphase", "solarview"]
ALERT_MIN_CVSS = 7.0
ALERT_TOP_N = 10

# --- fixed values: device vendor and banner rules ------------------------------------------
# Ordered: the first vendor with any keyword wins.
BANNER_VENDOR_KEYWORDS = [
    ("Growatt", ["growatt", "shinewifi", "shinelan"]),
    ("Sungrow", ["sungrow", "isolarcloud", "winet"]),
    ("SMA", ["sma", "sunnyportal", "sunny webbox"]),
    ("SolarView", ["solarview", "solar view"]),
]

DEFAULT_CREDENTIAL_HINTS = ["123456", "default password", "admin/admin", "password: admin"]

# Tried in this order inside each text.
FIRMWARE_PATTERNS = [
    r"firmware[:\s/]+v?([\d.]+)",
    r"version[:\s/]+v?([\d.]+)",
    r"fw[:\s/]+v?([\d.]+)",
]

# (vendor, rule, required text terms, title terms, ports); every non-empty part has to match.
BANNER_RULES = [
    ("Growatt", "growatt_web", ["growatt"], [], [80, 443, 8080]),
    ("Growatt", "growatt_title", [], ["growatt"], []),
    ("Growatt", "growatt_server", ["server.growatt.com"], [], []),
    ("Sungrow", "sungrow_web", ["sungrow"], [], [80, 443]),
    ("Sungrow", "isolarcloud_title", [], ["isolarcloud"], []),
    ("Sungrow", "winet_web", ["winet"], [], [80]),
    ("SMA", "webbox_title", [], ["sunny webbox"], []),
    ("SMA", "sunnyportal_title", [], ["sunnyportal"], []),
    ("SMA", "sma_solar_web", ["sma", "solar"], [], [80, 443]),
    ("SolarView", "solarview_title", [], ["solarview compact"], []),
    ("Generic_Industrial", "modbus_solar", ["solar"], [], [502]),
    ("Generic_Industrial", "mqtt_solar", ["solar"], [], [1883]),
    ("Generic_Industrial", "inverter_8899", ["inverter"], [], [8899]),
    ("Generic_Solar", "pv_monitor_title", [], ["pv monitor"], []),
    ("Generic_Solar", "pv_system_title", [], ["pv system"], []),
]

MODBUS_PORT = 502
MQTT_PORT = 1883

# --- fixed values: device risk dictionary --------------------------------------------------
# Ordered: the first keyword contained in the vendor text wins.
VENDOR_KEYWORDS = [
    ("growatt", "Growatt"),
    ("shinewifi", "Growatt"),
    ("shinelan", "Growatt_ShineLan"),
    ("sungrow", "Sungrow"),
    ("isolarcloud", "Sungrow"),
    ("winet", "Sungrow"),
    ("sma", "SMA"),
    ("sunnyportal", "SMA"),
    ("sunny webbox", "SMA"),
    ("solarview", "SolarView"),
    ("solar view", "SolarView"),
]

VENDOR_RISK_LEVEL = {
    "Growatt": "CRITICAL",
    "Sungrow": "HIGH",
    "SMA": "CRITICAL",
    "SolarView": "CRITICAL",
    "Growatt_ShineLan": "HIGH",
}

# (vendor key, CVE id, score text), in dictionary order.
VENDOR_CVES = [
    ("Sungrow", "CVE-2024-50685", "7.5"),
    ("Sungrow", "CVE-2024-50692", "9.8"),
    ("Sungrow", "CVE-2024-50693", "7.5"),
    ("Sungrow", "CVE-2024-50686", "7.5"),
    ("SMA", "CVE-2025-0731", "9.8"),
    ("SolarView", "CVE-2022-29303", "9.8"),
    ("SolarView", "CVE-2023-23333", "9.8"),
    ("Growatt_ShineLan", "CVE-2025-36753", "HIGH"),
]

# (vendor key, firmware text, status), in dictionary order.
VENDOR_FIRMWARE = [
    ("Growatt", "ShineWiFi-X v3.2.1", "VULNERABLE"),
    ("Growatt", "ShineWiFi-X v3.4.0", "PATCHED"),
    ("Growatt", "ShineLan-X (all known)", "VULNERABLE"),
    ("Sungrow", "WiNet-S v1.1.0", "VULNERABLE"),
    ("Sungrow", "WiNet-S v1.3.2", "PATCHED"),
    ("SolarView", "SolarView Compact v6.0", "CRITICAL"),
    ("SolarView", "SolarView Compact v8.0", "CRITICAL"),
]

FIRMWARE_STATUS_RISK = {"CRITICAL": 1.0, "VULNERABLE": 0.8, "PATCHED": 0.2}

OLD_FIRMWARE_HINTS = ["1.0", "1.1", "1.2", "2.0", "2.1", "3.0", "3.1", "3.2", "v6.0"]

# --- fixed values: grid capacity in GW -----------------------------------------------------
EUROPE_TOTAL_GW = 336.0
# (code, GW, grid critical)
EUROPE_GRID = [
    ("DE", 90.0, True), ("ES", 32.0, True), ("IT", 30.0, True), ("NL", 24.0, True),
    ("PL", 18.0, False), ("FR", 21.0, True), ("GB", 17.0, False), ("BE", 10.0, False),
    ("AT", 6.5, False), ("PT", 5.5, False), ("GR", 7.0, False), ("CZ", 3.5, False),
    ("HU", 6.5, False), ("RO", 3.0, False), ("SE", 4.5, False), ("DK", 4.0, False),
]
STATE_GRID = [
    ("CA", 50.0, True), ("TX", 25.0, True), ("FL", 14.0, False), ("AZ", 10.0, False),
    ("NC", 9.0, False), ("NY", 7.0, False), ("NV", 6.5, False), ("NJ", 5.5, False),
    ("MA", 4.5, False), ("VA", 4.0, False),
]
EXTRA_CRITICAL_STATES = ["CA", "TX"]
UNKNOWN_REGION_GW = 10.0
AVG_INVERTER_KW = 10.0
DESTABILIZATION_PCT = 2.0
HIGH_EXPOSURE_PCT = 0.5

# Estimates used only for states missing from STATE_GRID.
STATE_GRID_ESTIMATES = {
    "GA": 7.5, "SC": 3.0, "CO": 4.5, "MD": 3.5, "PA": 2.0, "OH": 2.0, "IL": 2.5, "MN": 2.5,
    "OR": 2.0, "WA": 1.5, "IN": 2.0, "UT": 3.0, "CT": 1.5, "HI": 2.0, "NM": 2.5, "MS": 1.0,
    "AL": 1.0, "TN": 1.0, "MO": 1.0, "LA": 1.0, "AR": 1.0, "WI": 0.8, "MI": 1.0, "KY": 0.5,
    "IA": 1.0, "KS": 0.5, "NE": 0.3, "OK": 1.0, "WV": 0.1, "SD": 0.2, "ND": 0.1, "MT": 0.2,
    "WY": 0.1, "ID": 0.8, "ME": 0.5, "NH": 0.3, "VT": 0.4, "RI": 0.5, "DE": 0.3, "DC": 0.2,
    "AK": 0.05,
}
MIN_STATE_WEIGHT = 0.1

# --- fixed values: geography ---------------------------------------------------------------
# (first, last, state) over the three leading ZIP digits.
ZIP3_RANGES = [
    (10, 27, "MA"), (28, 29, "RI"), (30, 38, "NH"), (39, 49, "ME"), (50, 54, "VT"),
    (55, 55, "MA"), (60, 69, "CT"),
    (100, 149, "NY"), (150, 196, "PA"), (197, 199, "DE"), (200, 205, "DC"), (206, 212, "MD"),
    (213, 213, "VA"), (214, 219, "MD"), (220, 246, "VA"), (247, 268, "WV"), (270, 289, "NC"),
    (290, 299, "SC"), (300, 319, "GA"), (320, 349, "FL"), (350, 369, "AL"), (370, 385, "TN"),
    (386, 397, "MS"), (400, 427, "KY"), (430, 459, "OH"), (460, 479, "IN"), (480, 499, "MI"),
    (500, 528, "IA"), (530, 549, "WI"), (550, 567, "MN"), (570, 577, "SD"), (580, 588, "ND"),
    (590, 599, "MT"), (600, 629, "IL"), (630, 658, "MO"), (660, 679, "KS"), (680, 693, "NE"),
    (700, 714, "LA"), (716, 729, "AR"), (730, 749, "OK"), (750, 799, "TX"), (800, 816, "CO"),
    (820, 831, "WY"), (832, 838, "ID"), (840, 847, "UT"), (850, 865, "AZ"), (870, 884, "NM"),
    (889, 898, "NV"), (900, 961, "CA"), (967, 968, "HI"), (970, 979, "OR"), (980, 994, "WA"),
    (995, 999, "AK"),
]
# Not part of the published table; used only with ``fill_gaps``.
ZIP3_GAP_RANGES = [(70, 89, "NJ")]

STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09",
    "DE": "10", "FL": "12", "GA": "13", "HI": "15", "ID": "16", "IL": "17", "IN": "18",
    "IA": "19", "KS": "20", "KY": "21", "LA": "22", "ME": "23", "MD": "24", "MA": "25",
    "MI": "26", "MN": "27", "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32",
    "NH": "33", "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38", "OH": "39",
    "OK": "40", "OR": "41", "PA": "42", "RI": "44", "SC": "45", "SD": "46", "TN": "47",
    "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54", "WI": "55",
    "WY": "56",
}
HIGH_SOLAR_STATES = [
    "CA", "TX", "FL", "AZ", "NC", "NV", "NJ", "GA", "VA", "NY",
    "MA", "SC", "CO", "MD", "PA", "OH", "IL", "MN", "WA", "OR",
]
ALERT_ZCTA_RANGES = {"CA": ("90001", "96162")}

CENSUS_VARIABLES = {
    "B01003_001E": "total_population",
    "B25001_001E": "total_housing_units",
    "B25002_002E": "occupied_units",
    "B25003_001E": "tenure_total",
    "B25003_002E": "owner_occupied_units",
    "B25003_003E": "renter_occupied_units",
    "B25024_002E": "single_family_detached_units",
    "B25024_003E": "single_family_attached_units",
    "B25035_001E": "median_year_built",
    "B25077_001E": "median_home_value",
    "B19013_001E": "median_household_income",
}
CENSUS_ZCTA_COLUMN = "zip code tabulation area"
CENSUS_MISSING_BELOW = -600000.0

# --- fixed values: thresholds --------------------------------------------------------------
REFERENCE_YEAR = 2026
HIGH_VALUE_HOME = 1_000_000.0
ALERT_HIGH_VALUE_HOME = 750_000.0
EMPTY_CORPUS_PRESSURE = 50.0
CRITICAL_CVSS = 9.0
HIGH_CVSS = 7.0
RISK_TIER_EDGES = [0.0, 55.0, 63.0, 70.0, 100.0]
RISK_TIER_LABELS = ["Low (<55)", "Medium (55–63)", "High (63–70)", "Very High (>70)"]
CLUSTER_LABELS = ["MINIMAL", "LOW", "MODERATE", "ELEVATED", "CRITICAL"]
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
PROPERTY_MATCH_CODES = ["AS01", "AS02", "YS02", "YC01"]
