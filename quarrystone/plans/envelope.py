"""Answers that fail closed: results, issues and one status, from rules over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Closed vocabularies (fixed values).
ERRORS = (
    "NOT_FOUND", "AMBIGUOUS_VERSION", "SOURCE_MISSING", "HASH_MISMATCH", "DRIFT_DETECTED", "CURRENT_CONFLICT", "SOURCE_UNAVAILABLE",
    "INDEX_STALE", "PROVENANCE_BROKEN", "SOURCE_CHANGED_SINCE_PIN",
    "SEMANTIC_INDEX_NOT_BUILT", "SEMANTIC_INDEX_CORRUPT", "SEMANTIC_INDEX_STALE",
)
HARD = frozenset(ERRORS) - {"SOURCE_CHANGED_SINCE_PIN", "CURRENT_CONFLICT"}
AXES = ("execution", "data", "research", "scientific", "task", "review")


@dataclass
class Envelope:
    """status is fail_closed, warning or success; a fail_closed answer has no rows."""

    query: str
    results: DataFrame
    authority: str = "index"
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    watermark: dict = field(default_factory=dict)

    def __post_init__(self):
        for code in self.errors:
            if code not in ERRORS:
                raise ValueError(f"{code} isn't an error of the closed vocabulary")
        if self.status == "fail_closed":  # the gate empties the answer before any job runs
            self.results = self.results.sparkSession.createDataFrame([], self.results.schema)

    @property
    def hard(self) -> list[str]:
        return [c for c in self.errors if c in HARD]

    @property
    def status(self) -> str:
        return "fail_closed" if self.hard else "warning" if self.errors or self.warnings else "success"

    @property
    def error_semantic(self) -> str | None:
        return (self.hard or self.errors or [None])[0]


def fresh(watermark: dict, fingerprint: str, last_event: str | None) -> str | None:
    """None if an index's watermark stands for the tree and events as they are, else the error."""
    if not watermark:
        return "NOT_FOUND"
    same = watermark.get("complete") and not watermark.get("drift") and watermark.get("fingerprint") == fingerprint and watermark.get("last_event") == last_event
    return None if same else "INDEX_STALE"
