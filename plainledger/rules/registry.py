"""Fixed values for registry rows: codes, roles, ranks, places, quotas."""

from __future__ import annotations

# Use code and site types that admit a registry row.
USE_CODE = "PU"
SITE_TYPES = ("A", "C")

# Bounds of a believable runway, and closed marks.
RUNWAY_MIN_LENGTH = 500
RUNWAY_WIDTH = (20, 400)
CLOSED_MARKS = ("CLSD", "CLOSED")

# Fuel tokens in reading order, each with its label.
FUEL_TOKENS = (
    (" A1+ ", "Jet A-1+"), (" A+ ", "Jet A+"), (" A1 ", "Jet A-1"), (" JET A ", "Jet A"),
    (" A ", "Jet A"), (" B ", "Jet B"), (" 100LL ", "100LL"), (" MOGAS ", "mogas"),
    (" 100 ", "100"), (" 80 ", "80"),
)

# Hub codes and service levels to role names.
HUB_ROLES = {"L": "large_hub", "M": "medium_hub", "S": "small_hub", "N": "nonhub"}
SERVICE_ROLES = {
    "P": "primary", "R": "reliever", "CS": "commercial_service", "GA": "general_aviation",
}

# Rank of a site type, lower is better; other types rank 5.
TYPE_RANK = {
    "large_airport": 0, "medium_airport": 1, "small_airport": 2, "seaplane_base": 3,
    "balloonport": 6, "heliport": 8, "closed": 9,
}
OTHER_RANK = 5

# Ownership labels.
OWNERSHIP_LABELS = {
    "PU": "publicly owned", "PR": "privately owned", "MA": "Air Force", "MN": "Navy",
    "MR": "Army", "CG": "Coast Guard",
}
# Words that already name a county-level place.
COUNTY_WORDS = ("county", "parish", "borough", "census area", "municipality", "municipio")

# Completeness phrases.
COMPLETENESS_PHRASE = {
    "complete": "Official link and a saved copy are both on file.",
    "link_only": "Official link listed. No saved copy yet.",
    "preserved_only": "Saved copy on file. Official link is missing or dead.",
    "missing": "No master plan or Airport Layout Plan listed yet.",
    "no_plan_known": "No master plan or Airport Layout Plan is known.",
}

# Postal codes by state and territory name.
PLACE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN",
    "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
    "American Samoa": "AS", "Guam": "GU", "Pacific Islands": "MP", "Puerto Rico": "PR",
    "Virgin Islands": "VI", "District of Columbia": "DC",
}
TERRITORY_CODES = ("AS", "GU", "MP", "PR", "VI", "DC")

# Regions and their places.
REGION_PLACES = {
    "alaskan": ("AK",),
    "central": ("IA", "KS", "MO", "NE"),
    "eastern": ("DC", "DE", "MD", "NJ", "NY", "PA", "VA", "WV"),
    "great_lakes": ("IL", "IN", "MI", "MN", "ND", "OH", "SD", "WI"),
    "new_england": ("CT", "ME", "MA", "NH", "RI", "VT"),
    "northwest_mountain": ("CO", "ID", "MT", "OR", "UT", "WA", "WY"),
    "southern": ("AL", "FL", "GA", "KY", "MS", "NC", "SC", "TN"),
    "southwest": ("AR", "LA", "NM", "OK", "TX"),
    "western_pacific": ("AZ", "CA", "HI", "NV"),
}

# Sample quota per region and size, and the default search scope.
SAMPLE_QUOTA = {"large": 3, "medium": 6, "small": 13}
DEFAULT_SCOPE = ("OR",)
ALL_SCOPE = ("*", "ALL")

# Intake form labels.
REPORT_TYPES = {
    "Add a missing document": "add",
    "Official URL is stale or dead": "stale",
    "Listed document is wrong (wrong airport, kind, or file)": "wrong",
    "Edition is out of date": "outdated",
    "Other": "other",
}
FORM_KINDS = {
    "Airport master plan": "master_plan",
    "Airport Layout Plan (ALP)": "alp",
    "State aviation or land-use statute": "statute",
    "Dead or replaced official URL": "other",
    "Other planning document": "other",
}
FORM_CLOSING = ("preserved", "dead", "not_plan", "ssi")
