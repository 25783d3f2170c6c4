"""Fixed values for web pages and links: patterns, hosts, codes, replacements."""

from __future__ import annotations

from dataclasses import dataclass

# Sensitive names and news paths.
SENSITIVE = r"(?i)(?:^|[^a-z0-9])ssi(?:[^a-z0-9]|$)|sensitive.?security|security.?identification"
NEWS = r"(?i)newsletter|port_news|(?:^|[_./-])news(?:[_./-]|$)"
MAX_BYTES = 500 * 1024 * 1024

# Host lists.
ENCYCLOPEDIA_HOSTS = ("wikipedia.org",)
SKIP_HOSTS = (
    "wikipedia.org", "facebook.com", "twitter.com", "x.com", "youtube.com", "instagram.com",
    "linkedin.com",
)
REDIRECT_PARTS = (
    "vertexaisearch.cloud.google.com", "google.com", "googleusercontent.com",
    "grounding-api-redirect",
)
REDIRECT_SUFFIXES = (".google.com", ".googleusercontent.com")

# Patterns that decide the role of a link.
NOT_PLAN = (
    r"(?iu)environmental assessment|\bNEPA\b|\bFONSI\b|legislatively adopted budget|"
    r"pavement (?:management|condition)"
)
ALP = r"(?iu)\balp\b|airport layout plan|airport diagram"
PART = (
    r"(?iu)chapter|appendix|appendices|inventory|forecast|alternative|facility requirement|"
    r"existing conditions|introduction|cip\b|implementation"
)
PLAN = r"(?iu)master plan|\bamp\b|airport master plan"
SKIP_HREF = r"(?i)^(mailto:|tel:|javascript:|#)"

# Labels that are not worth a fetch, and kinds that are.
SKIP_LABEL = (
    r"(?iu)\bminutes\b|\bagenda\b|privacy statement|economic impact|"
    r"newsletter|meeting packet|board packet|\bpresentations?\b|commission agenda|open house"
)
DATE_LABEL = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"
CONFIRM_KINDS = ("master_plan", "alp", "chapter")
CLOSED_ROLES = ("not_plan", "notice", "followup", "hub_page")
JOB_KIND = {"master_plan": "master_plan", "alp": "alp", "chapter": "master_plan", "unknown": "other"}

# A year and a bare host inside text.
YEAR = r"\b(19[89]\d|20[0-2]\d)\b"
BARE_HOST = r"(?i)\b(?:https?://)?(?:www\.)?([a-z0-9-]+\.(?:gov|org|com|net|us))\b"

# Keys and tokens to take out of saved pages, in order.
REDACTIONS = (
    (r"AIzaSy[A-Za-z0-9_-]+", "REDACTED"),
    (r"pk_(?:live|test)_[A-Za-z0-9]+", "REDACTED"),
    (r"sk_(?:live|test)_[A-Za-z0-9]+", "REDACTED"),
    (r'"apiKey"\s*:\s*"[^"]+"', '"apiKey":"REDACTED"'),
    (r'licenseKey"\s*:\s*"[^"]+"', 'licenseKey":"REDACTED"'),
    (r'licenseKey":"[^"]+"', 'licenseKey":"REDACTED"'),
    (r'name="csrf-token"\s+content="[^"]+"', 'name="csrf-token" content="REDACTED"'),
    (r'data-sitekey="[^"]+"', 'data-sitekey="REDACTED"'),
    (r'RecaptchaSiteKey:\s*"[^"]+"', 'RecaptchaSiteKey: "REDACTED"'),
    (r'AntiForgeryToken:\s*"[^"]+"', 'AntiForgeryToken: "REDACTED"'),
    (r'"token":"[a-f0-9]{32}"', '"token":"REDACTED"'),
    (r'stripeAccount:\s*"acct_[A-Za-z0-9]+"', 'stripeAccount: "REDACTED"'),
    (r"\}\)\('([0-9a-f-]{36})'\);", "})('REDACTED');"),
)
LEFT_SECRET = (
    r"AIzaSy[A-Za-z0-9_-]+|pk_(?:live|test)_[A-Za-z0-9]+|sk_(?:live|test)_[A-Za-z0-9]+|"
    r'"apiKey"\s*:\s*"(?!REDACTED)[^"]+"|licenseKey"\s*:\s*"(?!REDACTED)[^"]+"|'
    r'data-sitekey="(?!REDACTED)[^"]+"|RecaptchaSiteKey:\s*"(?!REDACTED)[^"]+"|'
    r'AntiForgeryToken:\s*"(?!REDACTED)[^"]+"|stripeAccount:\s*"(?!REDACTED)[^"]+"'
)
LOG_REDACTIONS = (
    (r"(?i)socks5h?://[^\s]+", "socks5h://redacted"),
    (r"(?i)(Bearer\s+)\S+", "$1redacted"),
    (r"(?i)(X-Api-Key:\s*)\S+", "$1redacted"),
)

# Block pages and sizes of a payload that is no original.
BLOCK_MARKS = ("request rejected", "access denied")
MIN_PAGE_BYTES = 800


@dataclass(frozen=True)
class LinkRules:
    """Patterns a caller may swap for its own vocabulary."""

    not_plan: str = NOT_PLAN
    news: str = NEWS
    alp: str = ALP
    part: str = PART
    plan: str = PLAN
    skip_label: str = SKIP_LABEL
