"""Fixed values for evidence scoring: patterns, stop words, weights, thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

FIELDS = ("same_airport", "kind", "confirm", "explore", "publish")

# Path parts that are no entity key, and words that are no name.
PATH_STOP = (
    "pdfs", "docs", "files", "file", "page", "pages", "html", "news", "about", "sites", "data",
    "pdf", "cms", "img", "css", "js", "src", "api", "maps", "list", "lists", "wp", "uploads",
    "content", "static", "media", "images", "image", "assets", "themes", "default", "user",
    "nodes", "view", "documents", "document", "library", "publications", "aero", "airports",
    "airport", "aviation", "business", "passengers", "planning", "projects", "app", "wiki", "org",
    "gov", "com", "net",
)
NAME_STOP = (
    "airport", "international", "regional", "municipal", "field", "airfield", "the", "and",
    "state", "county", "city", "port",
)

# Evidence patterns.
AMP = r"(?iu)(?:^|[^a-z0-9])amp(?:[^a-z0-9]|$)|airport master plan|final amp|master[_\s-]?plan"
ALP = r"(?iu)(?:^|[^a-z0-9])alp(?:[^a-z0-9]|$)|airport layout plan|airport diagram"
CHAPTER = (
    r"(?iu)\bchapters?\b|(?:^|[^a-z0-9])chp\s*\d|\bappendix\b|introduction|inventory|forecast|"
    r"existing conditions|executive summary|facility requirement|conditions.?report"
)
EA = r"(?iu)environmental assessment|\bNEPA\b|\bFONSI\b|\bEA\b"
ECON = r"(?iu)economic impact|\bIMPLAN\b|payroll and output|\bAEIS\b"
BUDGET = r"(?iu)legislatively adopted budget|\bPFC\b|passenger facility"
PAVE = r"(?iu)pavement (?:management|condition)|\bPCI\b"
STATEWIDE = (
    r"(?iu)\bSASP\b|aviation system plan|state aviation system|"
    r"statewide airport|statewide aviation|statewide economic impact"
)
APPENDIX = r"(?iu)\bappendix\b"
NOT_PLAN = (
    r"(?iu)environmental assessment|\bNEPA\b|\bFONSI\b|legislatively adopted budget|"
    r"\bnewsletter\b|wikipedia\.org|pavement (?:management|condition)"
)
PDF_HREF = r"(?i)href=[\"']([^\"']+\.pdf[^\"']*)[\"']"
ABSTRACT = r"(?iu)^[0-9a-f]{8,}|oda_doc_|appendix [a-z]\.\d|_a11y\b"
GUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
OTHER_KEY = r"(?i)/([A-Z0-9]{3,4})(?:/|$)"
MINUTES = r"(?iu)\bminutes\b|\bagenda\b"
NOTICE = r"(?iu)\bnotice\b|\bpress\b|NOTAM"
DIAGRAM = r"(?iu)airport diagram"
PFC_NAME = r"(?iu)\bpfc\b|passenger.facility"
PAGE_END = r"\.(html?|aspx|shtml)$"
SHAPES = {
    "inventory": r"(?iu)\binventory\b|existing conditions",
    "forecasts": r"(?iu)\bforecast",
    "facility_requirements": r"(?iu)facility requirement|demand.?capacity",
    "alternatives": r"(?iu)\balternatives?\b",
    "alp": r"(?iu)airport layout plan|\balp\b",
    "implementation": r"(?iu)implementation|capital improvement|\bcip\b",
}

# Alternatives of the patterns that meet whole texts, each with the word its matches begin with
# or have one character before; none where the word alone is the alternative.
PARTS = {
    AMP: (("final amp", None), ("master", r"(?iu)master[_\s-]?plan"), ("amp", r"(?iu)(?:^|[^a-z0-9])amp(?:[^a-z0-9]|$)")),
    ALP: (("airport layout plan", None), ("airport diagram", None), ("alp", r"(?iu)(?:^|[^a-z0-9])alp(?:[^a-z0-9]|$)")),
    EA: (("environmental assessment", None), ("nepa", r"(?iu)\bNEPA\b"), ("fonsi", r"(?iu)\bFONSI\b"), ("ea", r"(?iu)\bEA\b")),
    ECON: (("economic impact", None), ("payroll and output", None), ("implan", r"(?iu)\bIMPLAN\b"), ("aeis", r"(?iu)\bAEIS\b")),
    BUDGET: (("legislatively adopted budget", None), ("passenger facility", None), ("pfc", r"(?iu)\bPFC\b")),
    PAVE: (("pavement management", None), ("pavement condition", None), ("pci", r"(?iu)\bPCI\b")),
    STATEWIDE: (
        ("aviation system plan", None), ("state aviation system", None), ("statewide airport", None), ("statewide aviation", None),
        ("statewide economic impact", None), ("sasp", r"(?iu)\bSASP\b")),
    SHAPES["inventory"]: (("existing conditions", None), ("inventory", r"(?iu)\binventory\b")),
    SHAPES["forecasts"]: (("forecast", SHAPES["forecasts"]),),
    SHAPES["facility_requirements"]: (("facility requirement", None), ("demand", r"(?iu)demand.?capacity")),
    SHAPES["alternatives"]: (("alternative", SHAPES["alternatives"]),),
    SHAPES["alp"]: (("airport layout plan", None), ("alp", r"(?iu)\balp\b")),
    SHAPES["implementation"]: (("implementation", None), ("capital improvement", None), ("cip", r"(?iu)\bcip\b")),
}

# Linear weights of the three decisions.
CONFIRM = {
    "lid_in_url": 2.0, "lid_in_text": 1.5, "lid_in_filename": 1.5, "lid_in_label": 1.0,
    "name_in_text": 1.0, "name_in_filename": 1.0, "name_token_host": 0.6, "other_lid_in_url": -6.0,
    "host_encyclopedia": -12.0, "ssi_name": -25.0, "news_path": -8.0, "filename_amp": 4.0,
    "filename_alp": 4.0, "filename_ea": -8.0, "filename_chapter": 3.0, "filename_abstract": 0.0,
    "path_master_plan": 2.5, "label_minutes": -8.0, "label_notice": -4.0, "label_diagram": 3.0,
    "label_amp": 2.5, "label_alp": 2.5, "label_chapter": 2.0, "label_appendix": -2.0,
    "label_statewide": -5.0, "filename_pfc": -6.0, "text_amp": 3.0, "first_page_amp": 2.0,
    "label_economic_impact": -6.0, "packet_not_plan": -6.0, "body_nepa": -5.0,
    "body_economic_impact": -6.0, "body_budget": -6.0, "body_pavement": -6.0,
    "body_statewide": -5.0, "shape_count": 0.8, "outline_n": 0.2, "scanned_pdf": 0.8,
    "media_pdf": 1.5, "sharepoint": 0.5,
}
EXPLORE = {
    "media_html": 3.0, "path_master_plan": 3.0, "lid_in_url": 1.5, "lid_in_text": 1.5,
    "lid_in_filename": 1.0, "name_in_text": 1.0, "name_token_host": 0.5,
    "host_encyclopedia": -12.0, "ssi_name": -25.0, "news_path": -4.0, "media_pdf": -4.0,
    "label_minutes": -6.0, "label_notice": -4.0, "packet_not_plan": -3.0, "html_pdf_links": 0.3,
    "html_amp_links": 1.2, "html_alp_links": 1.2, "html_plan_hrefs": 2.0, "label_amp": 1.5,
}
PUBLISH = {
    "ssi_name": -25.0, "host_encyclopedia": -12.0, "other_lid_in_url": -8.0, "filename_ea": -10.0,
    "body_nepa": -8.0, "packet_not_plan": -8.0, "body_economic_impact": -8.0, "body_budget": -8.0,
    "body_pavement": -8.0, "label_minutes": -10.0, "news_path": -10.0, "filename_amp": 4.0,
    "text_amp": 2.5, "first_page_amp": 1.5, "label_amp": 2.5, "filename_alp": 4.0,
    "label_alp": 2.5, "filename_chapter": 3.0, "label_chapter": 2.0, "label_diagram": 3.0,
    "label_statewide": -8.0, "filename_pfc": -8.0, "body_statewide": -6.0, "path_master_plan": 2.0,
    "shape_count": 1.2, "outline_n": 0.2, "scanned_pdf": 1.0, "lid_in_url": 2.0,
    "lid_in_text": 1.5, "media_pdf": 1.0, "media_html": -3.0,
}
# Weights per kind; among equal scores the first kind wins.
KINDS = {
    "not_plan": {
        "filename_ea": 8.0, "body_nepa": 6.0, "packet_not_plan": 6.0, "body_economic_impact": 6.0,
        "label_economic_impact": 5.0, "body_budget": 6.0, "body_pavement": 6.0,
        "filename_pfc": 8.0, "label_statewide": 6.0, "body_statewide": 5.0,
        "host_encyclopedia": 10.0, "filename_abstract": 8.0, "other_lid_in_url": 4.0,
        "label_appendix": 3.0,
    },
    "notice": {"news_path": 8.0, "label_minutes": 6.0, "label_notice": 6.0},
    "alp": {
        "filename_alp": 6.0, "label_diagram": 5.0, "label_alp": 5.0, "scanned_pdf": 2.0,
        "body_short": 1.5, "html_alp_links": 1.0,
    },
    "chapter": {"filename_chapter": 7.0, "label_chapter": 5.0, "shape_count": 0.3, "outline_n": 0.2},
    "master_plan": {
        "filename_amp": 6.0, "label_amp": 5.0, "text_amp": 4.0, "first_page_amp": 3.0,
        "path_master_plan": 3.0, "shape_count": 1.0, "body_long": 2.0, "filename_chapter": -4.0,
        "filename_alp": -4.0, "label_chapter": -2.0,
    },
    "hub": {
        "media_html": 5.0, "path_master_plan": 3.0, "html_plan_hrefs": 3.0, "html_pdf_links": 0.4,
        "html_amp_links": 1.0, "media_pdf": -5.0,
    },
}
# Thresholds, first-page window and size limits.
THRESHOLDS = {"confirm": 2.5, "explore": 2.5, "publish": 3.5, "kind": 2.0}
FIRST_PAGE = 4000
FIRST_LINES = 1500
SHORT_BODY = 400
LONG_BODY = 8000
SCANNED_BYTES = 2_000_000
SCANNED_BODY = 800


@dataclass(frozen=True)
class EvidenceRules:
    """Patterns a caller may swap for its own vocabulary."""

    amp: str = AMP
    alp: str = ALP
    chapter: str = CHAPTER
    ea: str = EA
    econ: str = ECON
    budget: str = BUDGET
    pave: str = PAVE
    statewide: str = STATEWIDE
    appendix: str = APPENDIX
    not_plan: str = NOT_PLAN
    shapes: dict = field(default_factory=lambda: dict(SHAPES))
    # Alternatives by pattern (`values.found`); a pattern may have none.
    parts: dict = field(default_factory=lambda: dict(PARTS))


@dataclass(frozen=True)
class ScoreConfig:
    """Weights and thresholds of one scoring variant."""

    confirm: dict = field(default_factory=lambda: dict(CONFIRM))
    explore: dict = field(default_factory=lambda: dict(EXPLORE))
    publish: dict = field(default_factory=lambda: dict(PUBLISH))
    kinds: dict = field(default_factory=lambda: {k: dict(w) for k, w in KINDS.items()})
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
