import pytest

from quarrystone.plans import campaign, generator

FAMILY = generator.Family("F01", "1", (("origin", 3, 2), ("chain", 2, 4)))
NAMES = {"context": "c", "release": "r", "generator": "g"}


def test_instances_are_the_same_for_the_same_key(spark):
    a, b = (generator.instance(bytes(32), FAMILY, "public", 0, **NAMES) for _ in range(2))
    assert a == b and not generator.gates(a)
    many = [generator.instance(bytes(32), FAMILY, s, k, **NAMES) for k in range(6) for s in generator.SPLITS[::-1]]
    assert len({m["digest"] for m in many}) == len(many)
    rows = generator.lockfile(many)
    assert [r[1] for r in rows[::6]] == list(generator.SPLITS) and [r[2] for r in rows[:6]] == list(range(6))
    with pytest.raises(ValueError):
        generator.lockfile([many[0], many[0]])
    assert generator.tables(spark, a)["objects"].count() == len(a["objects"])


def test_gates_tell_faults():
    u = generator.instance(bytes(32), FAMILY, "public", 0, **NAMES)
    e = u["relations"][-1]
    assert generator.gates(u | {"relations": [*u["relations"], {**e, "source_ref": e["target_ref"], "target_ref": e["source_ref"]}]}) == ["acyclic"]
    assert "subjects_exist" in generator.gates(u | {"facts": [{"subject": "none"}]})
    assert "unique_refs" in generator.gates(u | {"objects": u["objects"] * 2})


def test_campaign_moves():
    m = dict.fromkeys(campaign.FIELDS) | {"campaign_schema_version": "1", "release_digest": "r", "state": "DRAFT", "isolation_profile_digest": "i", "network_policy_digest": "n", "created_at_attestation": "t"}
    log = campaign.record(campaign.validate(m), [])
    frozen = campaign.move(m, "ARTIFACTS_FROZEN", artifact_set_digest="a", campaign_digest="c", campaign_id="id", participant_artifact_digests_sorted=["p"])
    log = campaign.record(frozen, log)
    assert log[1]["previous_digest"] == log[0]["digest"] != log[1]["digest"]
    for to, bound in (("COMMITTED", {"commitment_digest": "x"}), ("ROOTS_CREATED", {}), ("ROOTS_CREATED", {"hidden_root_commitment": "h", "private_root_commitment": None})):
        with pytest.raises(campaign.CampaignError):
            campaign.move(frozen, to, **bound)
    with pytest.raises(campaign.CampaignError):
        campaign.validate(frozen | {"evidence_digest": "e"})
