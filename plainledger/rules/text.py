"""Fixed values for page text: fact patterns, labels, surfaces, outlook signals."""

from __future__ import annotations

from dataclasses import dataclass, field

# A page shorter than this, or full of dots, is not body text.
MIN_PAGE_CHARS = 40
CONTENTS = r"(?iU)\.{4,}|table of contents"
CONTENTS_DOTS = 80

# Routing of a page to native text or recognition.
MIN_NATIVE_CHARS = 40
MIN_IMAGE_PIXELS = 1_000_000

# Runway phrases.
RWY_LONG_WIDE = (
    r"(?iU)runway\s+(\d{1,2}\s*[/–-]\s*\d{1,2}[LCR]?)\s+is\s+([\d,]+)\s+feet\s+long"
    r"\s+and\s+([\d,]+)\s+feet\s+wide"
)
RWY_BY = (
    r"(?iU)runway\s+(\d{1,2}[LCR]?\s*[/–-]\s*\d{1,2}[LCR]?)\s*[,:]?\s*"
    r"([\d,]+)\s*(?:feet|ft)\s*(?:by|x)\s*([\d,]+)"
)
RWY_ID = (
    r"(?iU)(?:has\s+one\s+(?:paved\s+)?runway|one\s+(?:paved\s+)?runway)\s*[,:(]?\s*"
    r"(\d{1,2}\s*[/–-]\s*\d{1,2}[LCR]?)"
)
RWY_USABLE = r"(?iU)usable\s+length(?:\s+is|\s+of)?\s+([\d,]+)\s+feet"
RWY_WIDE = r"(?iU)(?:the\s+)?runway\s+is\s+([\d,]+)\s+feet\s+wide"
RWY_PAIR = r"(?iU)runways?\s+(\d{1,2}[LCR]?)\s*[/–-]\s*(\d{1,2}[LCR]?)"
RWY_PRIME = r"(?iU)([\d,]+)\s*['′]\s*[x×]\s*([\d,]+)\s*['′]"
RWY_COUNT = r"(?iU)\bhas\s+(one|two|three|four|\d+)\s+(?:parallel\s+)?runways?\b"
RWY_LINE = r"(?i)(\d{1,2}[LCR]?/\d{1,2}[LCR]?),\s*([\d,]+)\s+by\s+([\d,]+)\s+ft"

# Aircraft, operations and hangar phrases.
BASED_NOW = r"(?iU)currently\s+([\d,]+)\s+based aircraft"
BASED_AT = r"(?iU)([\d,]+)\s+based aircraft at the airport"
MAX_BASED = 5000
HANGARED = r"(?iU)([\d,]+)\s+(?:are |were )?stored in hangars"
TIEDOWN_REST = r"(?iU)stored in hangars,\s+while the remaining\s+(\w+)\s+are stored"
OPS_ANNUAL = r"(?iU)([\d,]+)\s+annual(?: aircraft)? operations(?:\s+in\s+(\d{4}))?"
OPS_OVER = r"(?iU)over\s+([\d,]+)\s+annual operations"
OPS_FORECAST = ("forecast", "projected", "increase from")
MIN_OPS = 100
HANGAR_BUILDINGS = r"(?iU)([\d,]+)\s+hangar buildings"
T_UNIT = r"(?iU)(?:T-hangar\s+\((\d+)\s+unit|\((\d+)\s+unit\)\s+T-hangar|(\d+)-unit\s+T-hangar)"

# Facility phrases in display order; the first of a pair wins.
NO_TOWER = r"non-towered|no control tower"
FUEL = r"aviation fuel|fuel tank|aircraft fuel"
NO_FBO = r"no fixed based operators|no fbo"
FBO = r"\bfbo\b|fixed base operator"

# Order of fact labels.
FACT_ORDER = (
    "Runways", "Elevation", "Hangars", "Based aircraft", "Hangared aircraft", "Operations",
    "Facilities",
)
# Surface codes and labels, longest code first.
SURFACES = {
    "ASPH-CONC": "Asphalt and concrete", "CONC-ASPH": "Concrete and asphalt", "ASPH": "Asphalt",
    "CONC": "Concrete", "GRAVEL": "Gravel", "GRVL": "Gravel", "TURF": "Turf", "DIRT": "Dirt",
    "WATER": "Water", "TREATED": "Treated", "MATS": "Mats", "SNOW": "Snow", "ICE": "Ice",
}

# Outlook passages, signals and limits.
PREFERRED = (
    r"(?is)(?:include alternative [a-e].{0,220}"
    r"|preferred(?: development)? alternative.{0,220}"
    r"|recommended (?:development )?(?:alternative|plan|program|concept).{0,200}"
    r"|selected alternative.{0,200}|master plan concept.{0,200}|pac voted.{0,200})"
)
NEGATIONS = ("no", "not", "never", "without", "neither", "nor")
NEGATION_REACH = 48
MAX_HITS = 2
MIN_OUTLOOK_CHARS = 80
PREFERRED_WEIGHT = 3
BAND_EDGE = 0.35
MIN_SIGNAL = 3
EDITION_WEIGHTS = (4, 3, 1)

# Fixed values: (group, pattern, weight, negatable).
SIGNALS = (
    ("decline", r"\b(?:close|closing|closure of) (?:the )?airport\b|\bairport clos(?:e|ing|ure)\b", 4, True),
    ("decline", r"\b(?:shorten(?:ed|ing)?|reduc(?:e|ed|ing) (?:the )?length of) (?:the )?runway\b"
                r"|\breduced runway length\b", 3, True),
    ("decline", r"\b(?:[\d,]+\s+acres of )?industrial development\b"
                r"|\bnon-aeronautical (?:use|development)\b|\bmore commercial/industrial\b"
                r"|\bland release\b|\bsurplus property\b", 2, True),
    ("decline", r"\bless aviation\b|\bdownsiz(?:e|ing)\b", 3, True),
    ("decline", r"\bconvert(?:ing)? all .{0,48}(?:commercial|industrial)"
                r"|\brelocat(?:e|ing) the airport\b"
                r"|\bdecommission(?:ing)? (?:the )?(?:airport|runway)\b", 3, True),
    ("grow", r"\brunway extension\b|\b(?:extend(?:ed|ing)?|lengthen(?:ed|ing)?) the runway\b", 3, True),
    ("grow", r"\b(?:new|parallel|second|third) runway\b|\badditional runways\b", 3, True),
    ("grow", r"\b(?:additional|new|future|proposed) (?:t-)?hangars?\b"
             r"|\b(?:t-|conventional |future |new |proposed |additional )hangar development\b"
             r"|\bhangar expansion\b", 2, True),
    ("grow", r"\bmore aviation\b|\bless commercial/industrial\b", 3, True),
    ("grow", r"\b(?:terminal expansion|expand(?:ed|ing)? (?:the )?terminal|new terminal)\b"
             r"|\b(?:capacity expansion|expand(?:ed|ing)? capacity)\b"
             r"|\bimprove terminal\b|\bconcourse extension\b"
             r"|\bnew concourse\b|\bgate expansion\b|\badditional gates\b", 2, True),
    ("grow", r"\b(?:apron expansion|new apron|expand(?:ed|ing)? (?:the )?apron)\b"
             r"|\b(?:taxiway|taxilane) extension\b|\bnew (?:taxiway|taxilane)\b", 2, True),
    ("hold", r"\bmaintain(?:ing)? existing(?: length| runway| facilities| airport)?\b", 2, False),
    ("hold", r"\bcontinue to (?:operate|serve|manage)\b|\bremain(?:s)? a(?:n)? (?:reliever|general aviation)\b", 2, False),
    ("hold", r"\bno plans to extend\b|\bwill not extend\b|\bnot extend the runway\b", 2, False),
    ("hold", r"\bno(?:-|\s+)(?:action|build) alternative\b", 1, False),
    ("hold", r"\b(?:reconstruct|rehabilitat(?:e|ion of)) (?:the )?(?:runway|pavement)\b", 1, False),
)


@dataclass(frozen=True)
class OutlookRules:
    """Signals a caller may swap for its own vocabulary."""

    signals: tuple[tuple[str, str, int, bool], ...] = field(default=SIGNALS)
    preferred: str = PREFERRED
