"""Campaigns: a manifest that moves along legal edges only, its fields bound once, and a chained log of the moves."""

from __future__ import annotations

import hashlib

from ..functions.hashing import strict

# Fields in order; a state needs the first of them, and those after them are null (fixed values).
FIELDS = (
    "campaign_schema_version", "campaign_id", "release_digest", "state", "isolation_profile_digest", "network_policy_digest", "created_at_attestation",
    "participant_artifact_digests_sorted", "artifact_set_digest", "campaign_digest", "private_root_commitment", "hidden_root_commitment", "commitment_digest",
    "materialization_evidence_digest", "evidence_digest", "disclosure_digest", "retired_reason",
)
NEEDED = {"DRAFT": 7, "ARTIFACTS_FROZEN": 10, "ROOTS_CREATED": 12, "COMMITTED": 13, "MATERIALIZED": 14, "EXECUTING": 14, "EVIDENCE_FROZEN": 15, "COMPLETED_UNDISCLOSED": 15, "DISCLOSED_RETIRED": 17}
# Legal moves and the fields that each binds (fixed values).
MOVES = {
    ("DRAFT", "ARTIFACTS_FROZEN"): ("artifact_set_digest", "campaign_digest", "campaign_id", "participant_artifact_digests_sorted"),
    ("ARTIFACTS_FROZEN", "ROOTS_CREATED"): ("hidden_root_commitment", "private_root_commitment"),
    ("ROOTS_CREATED", "COMMITTED"): ("commitment_digest",),
    ("COMMITTED", "MATERIALIZED"): ("materialization_evidence_digest",),
    ("MATERIALIZED", "EXECUTING"): (),
    ("EXECUTING", "EVIDENCE_FROZEN"): ("evidence_digest",),
    ("EVIDENCE_FROZEN", "COMPLETED_UNDISCLOSED"): (),
    ("EVIDENCE_FROZEN", "DISCLOSED_RETIRED"): ("disclosure_digest", "retired_reason"),
    ("COMPLETED_UNDISCLOSED", "DISCLOSED_RETIRED"): ("disclosure_digest", "retired_reason"),
}


class CampaignError(ValueError):
    pass


def validate(manifest: dict) -> dict:
    """The manifest, if it has just its fields, filled as far as its state needs and no further; a draft has no campaign id yet."""
    if set(manifest) != set(FIELDS) or manifest["state"] not in NEEDED:
        raise CampaignError("fields or state")
    due = set(FIELDS[: NEEDED[manifest["state"]]]) - ({"campaign_id"} if manifest["state"] == "DRAFT" else set())
    wrong = [f for f in FIELDS if (manifest[f] is not None) != (f in due)]
    if wrong:
        raise CampaignError(f"{manifest['state']}: {wrong}")
    return manifest


def move(manifest: dict, to: str, **bound) -> dict:
    """The manifest in its next state; what was bound before can't be bound again."""
    binds = MOVES.get((manifest["state"], to))
    if binds is None or set(bound) != set(binds) or any(manifest[f] is not None for f in binds):
        raise CampaignError(f"{manifest['state']} to {to}: {sorted(bound)}")
    return validate(manifest | bound | {"state": to})


def record(manifest: dict, log: list[dict]) -> list[dict]:
    """The log with an event for the manifest's state, its digest over the event before."""
    event = {"sequence": len(log), "state": manifest["state"], "previous_digest": log[-1]["digest"] if log else None, "manifest_digest": "sha256:" + hashlib.sha256(strict(manifest)).hexdigest()}
    return [*log, event | {"digest": "sha256:" + hashlib.sha256(strict(event)).hexdigest()}]
