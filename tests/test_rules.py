"""The tier cascade under other configurations, and what it refuses."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from attestor.operators import rules

AXES = "customer_facing_functional_product boolean, operating_company boolean, software_centrality string, firm_structure string, commercial_materiality string, customer_value_archetypes array<string>, contradictions array<string>, boundary_flags array<string>, baseline_filing_date string, codes array<string>"
CORE = dict(customer_facing_functional_product=True, operating_company=True, software_centrality="CO_ESSENTIAL", firm_structure="PURE_PLAY", commercial_materiality="DOMINANT", customer_value_archetypes=["FUNCTIONAL_SOFTWARE"], contradictions=[], boundary_flags=["edge"], baseline_filing_date="2022-09-15", codes=[])


def decide(spark, config=rules.RULES, **more):
    df = spark.createDataFrame([CORE | more], AXES)
    return rules.derive_tier(df, "codes", config).select("tier.*").first()


def changed(**parts):
    config = copy.deepcopy(rules.DEFAULTS)
    for path, value in parts.items():
        part, key = path.split("__")
        config[part][key] = value
    return config


def test_review_follows_the_configuration(spark):
    assert decide(spark).review_reasons == ["software_centrality_is_CO_ESSENTIAL", "boundary_flag_present"]
    one = decide(spark, changed(tier_a_core__manual_review_if=["boundary_flag_present"]))
    assert one.review_reasons == ["boundary_flag_present"] and [e.rule_id for e in one.trace][7:] == ["tier_a_core.manual_review_if.boundary_flag_present"]
    none = decide(spark, changed(tier_a_core__manual_review_if=[]))
    assert none.review_reasons == [] and not none.needs_manual_review and len(none.trace) == 7
    mixed = dict(firm_structure="MIXED_SEPARABLE", boundary_flags=[])
    assert decide(spark, **mixed).review_reasons == ["outcome_analysis_requires_segment_mapping"]
    assert decide(spark, changed(tier_b_extension__outcome_analysis_requires_segment_mapping=False), **mixed).review_reasons == []


def test_boundary_conditions_follow_the_configuration(spark):
    odd = dict(customer_value_archetypes=["OTHER"], firm_structure="MIXED_NONSEPARABLE")
    assert decide(spark, **odd).derived_tier == "TIER_C_BOUNDARY"
    less = decide(spark, changed(tier_c_boundary__also_include_if=["software_centrality_is_ENABLING"]), **odd)
    assert (less.derived_tier, less.reasons, less.review_reasons) == ("UNCERTAIN", ["contradictory_axis_classification"], ["no_tier_rule_matched"])


def test_details_version_and_hash(spark):
    got = decide(spark, changed())
    detail = {e.rule_id: e.detail for e in got.trace}
    assert detail["tier_a_core.operating_company_required"] == "operating_company=True" and detail["tier_a_core.allowed_archetypes"] == "archetypes=['FUNCTIONAL_SOFTWARE']" and detail["tier_a_core.baseline_annual_filing_required"] == "baseline_filing_date=2022-09-15"
    assert got.rules_version == "0.2.0" and got.rules_hash == rules.RULES.digest
    other = rules.Rules.of(changed() | {"rules_version": "9"})
    assert decide(spark, other).rules_version == "9" and other.digest != rules.RULES.digest
    out = decide(spark, customer_facing_functional_product=False, codes=["ASSET_BACKED_ISSUER"])
    assert (out.derived_tier, out.exclusion_provenance, out.reasons) == ("EXCLUDED", "economic_classification", ["ASSET_BACKED_ISSUER", rules.NO_PRODUCT])
    assert [e.detail for e in out.trace] == ["Classification found no customer-facing digital product.", f"reason_codes=['ASSET_BACKED_ISSUER', '{rules.NO_PRODUCT}']"]


def test_unknown_names_and_codes_are_refused(spark):
    with pytest.raises(ValueError, match="manual_review_if: phase_of_the_moon"):
        rules.Rules.of(changed(tier_a_core__manual_review_if=["phase_of_the_moon"]))
    with pytest.raises(ValueError, match="no uncertain"):
        rules.Rules.of({k: v for k, v in rules.DEFAULTS.items() if k != "uncertain"})
    with pytest.raises(Exception, match="Reason codes not in the rule config: MADE_UP"):
        decide(spark, codes=["MADE_UP"])
    with pytest.raises(Exception, match="Uncertain conditions not in the rule config: odd"):
        spark.range(1).select(rules.uncertainty(F.array(F.lit("odd")), rules.RULES).alias("t")).collect()


def test_load_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(rules.DEFAULTS))
    got = rules.Rules.load(spark, str(tmp_path / "r.json"))
    import hashlib

    assert got.config == rules.DEFAULTS and got.digest == hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest()
    yaml = pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(rules.DEFAULTS))
    assert rules.Rules.load(spark, str(tmp_path / "r.yaml")).config == rules.DEFAULTS


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([CORE, CORE], AXES)
    assert rules.derive_tier(df.limit(0)).count() == 0 and rules.derive_tier(df).count() == 2
    nothing = {k: None for k in CORE}
    got = decide(spark, **nothing)
    assert got.derived_tier == "UNCERTAIN" and got.reasons == ["insufficient_baseline_evidence", "unresolved_operating_status"]
