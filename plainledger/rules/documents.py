"""Fixed values for document records: kinds, statuses, ranks, markers."""

from __future__ import annotations

# Kinds that form a lineage, and plan kinds awaiting review.
WORK_KINDS = ("master_plan", "alp")
PENDING_KINDS = ("master_plan", "alp", "chapter", "other")
PASS_KINDS = ("statute", "sasp", "notice")
VETTED_KINDS = ("master_plan", "alp", "chapter")

# Review statuses.
LISTED = ("curated", "published", "auto_pass")
REVIEWS = ("pending", "curated", "auto_pass", "needs_human", "published")
MACHINE_REVIEWS = ("pending", "auto_pass")
KEPT_REVIEWS = ("published", "auto_pass", "needs_human")

# Rank of a completeness status; kind order on a page.
COMPLETENESS_RANK = {
    "complete": 4, "link_only": 3, "preserved_only": 2, "no_plan_known": 1, "missing": 0,
}
KIND_ORDER = {"alp": 0, "master_plan": 1, "other": 2}

# Words of a title that mark a chapter, and a volume of a set.
CHAPTER_WORDS = (
    "inventory", "forecast", "alternative", "facility requirement", "implementation",
    "introduction", "chapter", "appendix",
)
VOLUME_WORDS = (
    "existing condition", "inventory", "chapter", "sheet", "appendix", "forecast", "alternative",
    "facility requirement", "implementation", "introduction", "table of contents",
)
# The tail of a part's title that is not the work's name.
PART_TAIL = (
    r"(?i)\s+(?:chapters?\s+\d+(?:\s*-\s*\d+)?\b.*"
    r"|chapter\s+(?:one|two|three|four|five|six|seven|eight|nine|ten)\b.*"
    r"|appendix\s+[a-z]\b.*|existing\s+conditions?\b.*|introduction\b.*|inventory\b.*"
    r"|table\s+of\s+contents\b.*)$"
)
CHAPTER_NUMBER = r"(?i)chapter\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten)"
APPENDIX_LETTER = r"(?i)appendix\s+([a-z])"

# Recheck windows in days, and HTTP codes.
LIVE_RECHECK_DAYS = 7
DEAD_RECHECK_DAYS = 30
DEAD_HTTP = (404, 410, 451)

# Notes on a replaced file.
NOTE_SAME = "Official file was replaced; text and drawings are unchanged."
NOTE_CHANGED = "Text or drawings changed at the official URL."
NOTE_BYTES = "Preserved bytes changed at the official URL."
