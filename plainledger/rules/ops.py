"""Fixed values for audit and status tables: buckets, stages, tiers, quotas, texts."""

from __future__ import annotations

from dataclasses import dataclass

# Outcome buckets and the job statuses behind them.
BUCKETS = ("accepted", "uncertain", "needs_human", "failed")
FAILED_JOBS = ("dead", "ssi", "not_plan", "not_file")
ACCEPTED_REVIEWS = ("curated", "auto_pass", "published")
THRESHOLDS = {"confirm_score": 2.5, "publish_score": 3.5, "explore_score": 2.5}
NEAR = 1.0
TRAINING_LIMITS = {"accepted": 20, "uncertain": 80, "needs_human": 80, "failed": 80}

# Columns an outcome or reject row may show.
OUTCOME_COLUMNS = (
    "at", "bucket", "id", "job_id", "job_kind", "document_id", "lid", "name", "state", "url",
    "label", "job_status", "review_status", "expected_content_sha256", "requested_by", "reason",
    "source", "scored", "gold", "shape", "reject_sha256", "reject_reason", "reject_expires_at",
    "reject_stored",
)
REJECT_COLUMNS = (
    "at", "expires_at", "sha256", "suffix", "bytes", "stored", "reason", "url", "label", "lid",
    "state", "job_id", "job_kind", "http_status",
)
BANNED_COLUMNS = ("excerpt", "body", "source_bytes", "text", "bytes")
RETENTION_DAYS = 90
TRAIN_REASONS = ("not_plan", "not_file", "ssi")

# Coverage stages, their display order, labels and banners.
STAGES = ("untouched", "searched", "explored", "snapshot_pending", "published", "no_plan_found")
STAGE_ORDER = ("untouched", "searched", "explored", "snapshot_pending", "no_plan_found", "published")
STAGE_LABELS = {
    "untouched": "Not searched yet", "searched": "Searched", "explored": "Hub explored",
    "snapshot_pending": "Awaiting review", "published": "Published",
    "no_plan_found": "No plan found yet",
}
STAGE_BANNERS = {
    "untouched": "Not reviewed yet. Empty plan sections do not mean none exist.",
    "searched": "A web search for official plans ran on {date}. Nothing is published yet.",
    "explored": "Likely hub pages were explored on {date}. Nothing is published yet.",
    "snapshot_pending": "One or more files are preserved and awaiting review. They are not published yet.",
    "no_plan_found": "Searched and explored on {date}. No official plan is listed yet.",
}
NO_DATE = "a recent pass"
PANEL_ALONE = "No master plan is listed yet. An Airport Layout Plan can stand on its own."
PANEL_EMPTY = {
    "untouched": "Not searched yet. Whether one exists is unknown.",
    "searched": "A web search ran; none is published here yet.",
    "explored": "Hub pages were explored; none is published here yet.",
    "snapshot_pending": "Files are preserved and awaiting review. Nothing is published here yet.",
    "no_plan_found": "Searched. No official one is listed yet.",
}
NO_PLAN_STATUSES = ("dead", "not_plan", "ssi")
TOUCH_KINDS = {"explore": "explored_at", "fetch": "snapshot_at", "vet": "vetted_at", "discovery": "discovery_at"}

# Tiers of the work ranking, the levels that count, recency in days.
TIER_FUNDED_STALE, TIER_STALE, TIER_FUNDED_RECENT = 0, 1, 2
TIER_RECENT, TIER_NO_PLAN, TIER_PUBLISHED = 3, 4, 5
FUNDED_LEVELS = ("federal", "state", "local")
RECENCY_DAYS = 30

# Rows a review list shows and may show at most, jobs a status report names.
LISTED, MAX_LISTED = 200, 2000
RECENT_CLASSIFICATIONS = 50
SHOWN_JOBS = 10
WEDGED = "active job with no worker log lines"

# Dataset statuses that can be used.
USABLE = ("ready", "stale")


@dataclass(frozen=True)
class Provider:
    """Monthly query budget of one metered provider."""

    name: str
    budget: float
    credit: float = 0.0
    rate_per_1k: float = 5.0
    free: int = 0
    per_prompt: float = 1.0
    cap: int | None = None

    def monthly_cap(self) -> int:
        if self.rate_per_1k <= 0:
            return max(self.free, 0)
        money = max(self.budget, 0.0) + max(self.credit, 0.0)
        paid = int(money / self.rate_per_1k * 1000 / max(self.per_prompt, 1.0))
        queries = max(self.free, 0) + max(paid, 0)
        return queries if self.cap is None else min(queries, self.cap)


# Budgets of the providers.
PROVIDERS = (
    Provider("brave", budget=25.0, credit=5.0, rate_per_1k=5.0),
    Provider("gemini", budget=25.0, rate_per_1k=14.0, free=5000, per_prompt=4.0),
    Provider("google", budget=25.0, credit=5.0, rate_per_1k=5.0),
)
