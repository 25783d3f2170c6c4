"""Fixed values for funding rows: levels, categories, patterns, labels."""

from __future__ import annotations

from dataclasses import dataclass, field

# Funding levels in display order, with labels and empty texts.
LEVELS = ("federal", "state", "local", "other")
LEVEL_LABELS = {"federal": "Federal", "state": "State", "local": "Local", "other": "Other"}

# Spend categories in display order, with labels.
CATEGORIES = ("maintenance", "growth", "planning", "other")
CATEGORY_LABELS = {
    "maintenance": "Maintenance",
    "growth": "Growth and expansion",
    "planning": "Planning studies",
    "other": "Other",
}

# Budget line groups and labels.
BUDGET_GROUP_LABELS = {"program": "By program", "fund": "By fund type", "project": "Projects"}

# Patterns that decide a spend category.
PLANNING = r"(?iu)\bmaster plan\b|\bairport layout plan\b|\balp\b|\bplanning study\b"
GROWTH = (
    r"(?iu)\b(?:"
    r"new\s+(?:runway|terminal|hangar|apron|taxiway|building|gate|facility)|"
    r"(?:add|adding)\s+(?:a\s+)?(?:new\s+)?(?:runway|terminal|gate|hangar|apron)|"
    r"expand(?:ing|s|ion)?|extension|extend(?:ing)?|lengthen(?:ing)?|widen(?:ing)?|"
    r"additional\s+(?:runway|terminal|gate|hangar|apron)"
    r")\b"
)
MAINTENANCE = (
    r"(?iu)\b(?:"
    r"rehabilitat(?:e|ion)|reseal(?:ing)?|resurface|repav(?:e|ing)?|"
    r"overlay|reconstruct(?:ion)?|repair(?:ing)?|"
    r"replace(?:ment)?|maintain(?:ance|ing)?|"
    r"pavement\s+(?:rehab|overlay|treatment)|improve(?:ment)?"
    r")\b"
)
AMBIGUOUS = r"(?iu)\b(?:improve|upgrade|moderniz|renov|equip|infrastructure|environment)\b"

# Award page parts.
AWARD_URL = "https://www.usaspending.gov/award/ASST_NON_{key}_069"
YEAR_SUMMARY_URL = "https://www.faa.gov/airports/aip/grant_histories/{year}"

# Header texts of a grant sheet, best alias first.
GRANT_HEADERS = {
    "entity": ("locid", "loc id", "location id", "airport id", "arpt id"),
    "state": ("state",),
    "description": (
        "project summary", "brief description of work", "brief description",
        "description of work", "project description", "description",
    ),
    "total": ("total amount", "aip federal funds", "federal funds", "total aip", "total"),
    "entitlement": ("entitlement",),
    "discretionary": ("discretionary",),
    "aig": ("aig", "aig amount"),
    "cares": ("cares amount", "cares"),
    "grant_number": ("grant number", "grant seq number", "grant sequence number", "grant seq"),
    "award_date": ("award date",),
}


@dataclass(frozen=True)
class SpendRules:
    """Patterns a caller may swap for its own vocabulary."""

    planning: str = PLANNING
    growth: str = GROWTH
    maintenance: str = MAINTENANCE
    ambiguous: str = AMBIGUOUS
    categories: tuple[str, ...] = field(default=CATEGORIES)
