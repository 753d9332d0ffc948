"""The universe run over an invented bundle, with a case for each branch."""

import datetime
import json
from pathlib import Path

import pytest

from attestor.plans import universe as U

CUT = datetime.date(2022, 12, 31)
DAY = datetime.date(2022, 9, 15)
TEXT = "Harbour Ledger sells planning software to ports. The firm runs a service desk."
QUOTE = "sells planning software to ports"


def firm(n, **more):
    flags = dict.fromkeys(["investment_company", "asset_backed_issuer", "non_operating_trust", "shell_company", "blank_check_precombination"], False) | more.pop("flags", {})
    return dict(cik=str(n), canonical_name=f"Firm {n}", accession_number=f"{n:010d}-22-000001", filing_date=DAY, form="10-K", sic="7372", exchange="X", ticker="T", source_ids=["s"], issuer_status_flags=flags) | more


def screen(n, status="LIKELY_ELIGIBLE", quote=QUOTE):
    seen = [dict(source_id="s", passage_id="p", quote=quote, supported_claim="c")] if quote else []
    return dict(cik=str(n), screen_status=status, candidate_customer_value_archetypes=["OTHER"], positive_evidence=seen, negative_or_boundary_evidence=[], confidence="low")


def axes(n, quote=QUOTE, **more):
    base = dict(cik=str(n), baseline_cutoff=CUT, baseline_filing_date=DAY, customer_facing_functional_product=True, operating_company=True, customer_value_archetypes=["FUNCTIONAL_SOFTWARE"], software_centrality="CORE", firm_structure="PURE_PLAY")
    base |= dict(commercial_materiality="DOMINANT", contradictions=[], boundary_flags=[], exclusion_reason_codes=None, candidate_tier="TIER_A_CORE", evidence=[dict(claim="c", source_id="s", passage_id="p", quote=quote)] if quote else [])
    return base | more


def bundle():
    ids = [*range(1, 12), 14]
    filers = [firm(n) for n in ids]
    filers[1]["flags_"] = None
    filers += [firm(1, filing_date=datetime.date(2022, 1, 5), accession_number="0000000001-22-000000")]  # an earlier share class
    filers += [firm(12, filing_date=datetime.date(2023, 4, 1)), firm(13, filing_date=None, form=None)]
    by = {int(f["cik"]): f for f in filers if f["filing_date"] != datetime.date(2022, 1, 5)}
    by[2]["issuer_status_flags"] |= {"shell_company": True, "blank_check_precombination": True}
    by[3]["issuer_status_flags"] |= {"investment_company": None}
    filers[1].pop("flags_")
    passages = [dict(cik=str(n), passage_id=f"p{n}", source_id="s", section="ITEM1_OVERVIEW", publication_date=DAY, text=TEXT) for n in ids if n != 4]
    passages += [dict(cik="5", passage_id="late", source_id="s", section="CUSTOMERS", publication_date=datetime.date(2023, 1, 1), text=TEXT)]
    screens = [screen(n) for n in (1, 7, 8, 9, 10, 11, 14)] + [screen(6, "LIKELY_INELIGIBLE", None)]
    screens[1]["positive_evidence"][0]["quote"] = "a sentence that is nowhere"
    rows = [axes(1), axes(9, software_centrality="CO_ESSENTIAL"), axes(10, customer_facing_functional_product=False), axes(11, quote=None), axes(14, customer_value_archetypes=["ECOMMERCE_RETAIL"], firm_structure="MIXED_NONSEPARABLE", candidate_tier="TIER_C_BOUNDARY")]
    adj = [("a1", "case-0000000009", "CONFIRM_RULE_TIER", "TIER_A_CORE", datetime.datetime(2023, 1, 1)), ("a2", "case-0000000009", "OVERRIDE_RULE_TIER", "TIER_B_EXTENSION", datetime.datetime(2023, 2, 1))]
    return {
        "filers": filers, "passages": passages, "screens": screens, "classifications": rows, "adjudications": [dict(zip(("adjudication_id", "case_id", "decision", "final_candidate_tier", "recorded_at"), a)) for a in adj],
        "audits": [dict(cik=n, audit_status="confirmed", reviewer="r") for n in ("2", "6", "13")], "events": [dict(cik="1", exit_type="acquired")], "lineage": [],
    }


@pytest.fixture(scope="module")
def frames(spark):
    return {n: spark.createDataFrame(rows, U.SCHEMAS[n]) for n, rows in bundle().items()}


@pytest.fixture(scope="module")
def done(spark, frames):
    return U.run(spark, frames, "2022-12-31", ["10-K"], 42, version="v1")


def test_each_branch_decides_its_firm(done):
    got = {int(r["cik"]): (r["derived_tier"], r["provenance"]) for r in done.tables["tier_decisions"].collect()}
    assert got == {
        1: ("TIER_A_CORE", None), 2: ("EXCLUDED", "deterministic"), 3: ("UNCERTAIN", None), 4: ("UNCERTAIN", None), 5: ("UNCERTAIN", None), 6: ("EXCLUDED", "screen_derived"), 7: ("UNCERTAIN", None),
        8: ("UNCERTAIN", None), 9: ("TIER_A_CORE", None), 10: ("EXCLUDED", "economic_classification"), 11: ("UNCERTAIN", None), 13: ("EXCLUDED", "deterministic"), 14: ("TIER_C_BOUNDARY", None),
    }
    reasons = {int(r["cik"]): r["tier_reasons"] for r in done.tables["tier_decisions"].collect()}
    assert reasons[2] == ["SHELL_OR_PRECOMBINATION_SPAC"] and reasons[13] == [U.NO_FORM] and reasons[10] == ["NO_CUSTOMER_FACING_DIGITAL_PRODUCT"]
    failed = {int(r["cik"]): r["screen_error"] for r in done.tables["screen_failures"].collect()}
    assert failed == {7: "unresolved_quote"}
    assert {int(r["cik"]): r["classification_error"] for r in done.tables["classification_failures"].collect()} == {8: "missing_output", 11: "claims_without_evidence"}
    assert {int(r["cik"]): r["packet_status"] for r in done.tables["packet_failures"].collect()} == {4: "NO_PASSAGES", 5: "TEMPORAL_LEAKAGE"}


def test_review_audit_and_counts(done):
    case = done.tables["review_queue"].first()
    assert case["case_id"] == "case-0000000009" and case["state"] == "resolved" and done.tables["review_queue"].count() == 1
    c = done.counts
    assert (c["filer_records"], c["unique_firms"], c["baseline_firms"], c["post_baseline_entrants"], c["duplicate_records"]) == (15, 14, 13, 1, 1)
    assert (c["tier_a"], c["tier_b"], c["tier_c"], c["excluded"], c["uncertain"]) == (1, 1, 1, 4, 6)
    assert (c["negative_audit_pool"], c["negative_audit_sampled"], c["negative_audit_pending"]) == (3, 3, 0)
    assert all(done.reconciliation.values()) and done.frozen and done.version == "v1"
    years = {int(r["cik"]): r for r in done.tables["firm_years"].collect()}
    assert len(years) == 14 and years[1]["exit_type"] == "acquired" and years[12]["dynamic_entrant"] and years[12]["eligible_this_year"] is None
    assert years[2]["operating_status"] == "shell" and years[2]["eligible_this_year"] is False and years[9]["eligible_this_year"] is True
    first = {int(r["cik"]): r for r in done.tables["companies"].collect()}
    assert first[1]["observation_start"] == datetime.date(2022, 1, 5) and first[12]["inclusion_status"] == "pending"


def test_blockers(spark, frames):
    bad = dict(frames)
    bad["audits"] = frames["audits"].where("cik <> '6'")
    bad["adjudications"] = frames["adjudications"].limit(0)
    bad["filers"] = frames["filers"].unionByName(spark.createDataFrame([firm(15, cik="none")], U.SCHEMAS["filers"]))
    u = U.run(spark, bad, "2022-12-31", ["10-K"], 42)
    assert u.failed_gates == {"open_review_case": 1, "invalid_identifier": 1} and u.counts["negative_audit_pending"] == 1
    assert not u.frozen and u.version == "unreleased" and len(u.blockers) == 3


def test_empty_bundle(spark):
    u = U.run(spark, {n: spark.createDataFrame([], s) for n, s in U.SCHEMAS.items()}, "2022-12-31", ["10-K"], 1)
    assert u.counts["filer_records"] == 0 and u.frozen


def test_written_once(spark, done, tmp_path):
    path = Path(U.write(spark, done, str(tmp_path), "run-1"))
    manifest = json.loads(next((path / "manifest").glob("part-*")).read_text())
    assert manifest["hard_gate_status"] == "pass" and set(manifest["output_hashes"]) == set(done.tables)
    with pytest.raises(FileExistsError):
        U.write(spark, done, str(tmp_path), "run-1")


def test_load(spark, tmp_path):
    for n, rows in bundle().items():
        (tmp_path / f"{n}.jsonl").write_text("\n".join(json.dumps(r, default=str) for r in rows))
    with pytest.raises(FileNotFoundError, match="manifest.json"):
        U.load(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"baseline_cutoff": "2022-12-31"}, indent=1))
    with pytest.raises(ValueError, match="form_scope"):
        U.load(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"baseline_cutoff": "2022-12-31", "form_scope": ["10-K"], "universe_version_on_freeze": "v"}))
    frames, manifest = U.load(spark, str(tmp_path))
    assert manifest["form_scope"] == ["10-K"] and frames["filers"].count() == 15 and frames["classifications"].where("cik = '9'").first()["software_centrality"] == "CO_ESSENTIAL"


def sentinel():
    """25 records of 24 firms, one for each kind of case."""
    kinds = {  # archetype, centrality, structure, materiality, more
        1: ("FUNCTIONAL_SOFTWARE", "CORE", "PURE_PLAY", "DOMINANT", {}), 2: ("ADAPTIVE_DIGITAL_SERVICE", "CORE", "SOFTWARE_DOMINANT", "MATERIAL", {}), 3: ("DATA_ANALYTICS_PRODUCT", "CO_ESSENTIAL", "PURE_PLAY", "DOMINANT", {}),
        4: ("TRANSACTION_INFRASTRUCTURE", "CORE", "PURE_PLAY", "DOMINANT", {}), 5: ("MARKETPLACE_COORDINATION", "CORE", "PURE_PLAY", "DOMINANT", {}), 6: ("CONTENT_CATALOG", "CORE", "PURE_PLAY", "DOMINANT", {}), 7: ("ATTENTION_SOCIAL_PLATFORM", "CORE", "PURE_PLAY", "DOMINANT", {}),
        8: ("INTERACTIVE_ENTERTAINMENT", "CORE", "PURE_PLAY", "DOMINANT", {}), 9: ("HUMAN_MANAGED_SERVICE", "PERIPHERAL", "SOFTWARE_PERIPHERAL", "MINOR", {}), 10: ("HARDWARE_SOFTWARE_SYSTEM", "CO_ESSENTIAL", "PURE_PLAY", "DOMINANT", {}),
        11: ("FUNCTIONAL_SOFTWARE", "CORE", "MIXED_SEPARABLE", "MATERIAL", {}), 12: ("FUNCTIONAL_SOFTWARE", "CO_ESSENTIAL", "MIXED_NONSEPARABLE", "MATERIAL", dict(boundary_flags=["segments overlap"], candidate_tier="TIER_B_EXTENSION")),
        15: ("OTHER", "UNKNOWN", "PURE_PLAY", "DOMINANT", dict(customer_facing_functional_product=None)), 17: ("FUNCTIONAL_SOFTWARE", "CORE", "PURE_PLAY", "DOMINANT", {}), 18: ("FUNCTIONAL_SOFTWARE", "CORE", "PURE_PLAY", "MATERIAL", {}),
        21: ("ECOMMERCE_RETAIL", "ENABLING", "SOFTWARE_PERIPHERAL", "DOMINANT", {}),
    }
    filers = [firm(n, sic=str(1000 + 100 * n)) for n in range(1, 25)] + [firm(1, ticker="T.B", accession_number="0000000001-22-000000", sic="1100")]
    by = {int(f["cik"]): f for f in filers[:24]}
    by[13]["issuer_status_flags"] |= {"shell_company": True, "blank_check_precombination": True}
    by[14]["issuer_status_flags"] |= {"investment_company": True}
    by[19]["filing_date"] = datetime.date(2023, 3, 1)
    passages = [dict(cik=str(n), passage_id=f"p{n}", source_id="s", section="ITEM1_OVERVIEW", publication_date=DAY, text=TEXT, ord=0) for n in range(1, 25) if n not in (13, 14, 19)]
    passages += [dict(cik="16", passage_id="late", source_id="s", section="CUSTOMERS", publication_date=datetime.date(2023, 1, 1), text=TEXT, ord=1)]
    screens = [screen(n) for n in kinds] + [screen(n, "LIKELY_INELIGIBLE", None) for n in (20, 22, 23, 24)]
    rows = [axes(n, customer_value_archetypes=[k], software_centrality=c, firm_structure=s, commercial_materiality=m, **more) for n, (k, c, s, m, more) in kinds.items()]
    day = datetime.datetime(2023, 1, 1)
    log = [("a3", "case-0000000003", "CONFIRM_RULE_TIER", "TIER_A_CORE", day), ("a11", "case-0000000011", "CONFIRM_RULE_TIER", "TIER_B_EXTENSION", day), ("a12", "case-0000000012", "CONFIRM_RULE_TIER", "TIER_C_BOUNDARY", day)]
    lineage = [("l1", 18, 99, "target"), ("l2", 17, 17, "name_change"), ("l3", 1, 1, "share_class_same_issuer")]
    return {
        "filers": filers, "passages": passages, "screens": screens, "classifications": rows, "adjudications": [dict(zip(("adjudication_id", "case_id", "decision", "final_candidate_tier", "recorded_at"), a)) for a in log],
        "audits": [dict(cik=str(n), audit_status="confirmed", reviewer="r") for n in (13, 14, 20, 22, 23, 24)], "events": [dict(cik="19", entry_type="ipo"), dict(cik="18", exit_type="acquired")],
        "lineage": [dict(lineage_id=i, company_id=f"CIK{a:010d}", related_company_id=f"CIK{b:010d}", relationship=r) for i, a, b, r in lineage],
    }


@pytest.fixture(scope="module")
def sentinel_run(spark):
    frames = {n: spark.createDataFrame(rows, U.SCHEMAS[n]) for n, rows in sentinel().items()}
    template = "Cutoff {{baseline_cutoff}}\n{{company_metadata}}\n---\n{{passages_with_source_and_passage_ids}}"
    return U.run(spark, frames, "2022-12-31", ["10-K"], 42, version="v1", template=template)


def test_sentinel_counts(sentinel_run):
    c = sentinel_run.counts
    want = dict(filer_records=25, unique_firms=24, duplicate_records=1, baseline_firms=23, post_baseline_entrants=1, tier_a=5, tier_b=3, tier_c=7, excluded=6, excluded_deterministic=2, excluded_screen_derived=4, excluded_economic_classification=0, uncertain=2)
    want |= dict(review_cases=3, review_cases_open=0, packet_failures=1, negative_audit_pool=6, negative_audit_sampled=6, negative_audit_completed=6, negative_audit_pending=0)
    assert {k: c[k] for k in want} == want
    assert sentinel_run.frozen and sentinel_run.version == "v1" and not sentinel_run.failed_gates and all(sentinel_run.reconciliation.values())


def test_sentinel_firms(sentinel_run):
    t = sentinel_run.tables
    tier = {int(r.cik): r.derived_tier for r in t["tier_decisions"].collect()}
    assert {n for n, x in tier.items() if x == "TIER_A_CORE"} == {1, 2, 3, 17, 18} and {n for n, x in tier.items() if x == "TIER_B_EXTENSION"} == {4, 10, 11} and {n for n, x in tier.items() if x == "UNCERTAIN"} == {15, 16} and 19 not in tier
    failure = t["packet_failures"].first()
    assert (failure.cik, failure.reason_code) == ("0000000016", "TEMPORAL_LEAKAGE") and failure.detail == "Passage late dated 2023-01-01 is after baseline cutoff 2022-12-31."
    assert t["screens"].where("cik = '0000000016'").isEmpty() and t["errors"].where("subject = '0000000016'").first().stage == "packet"
    packet = t["packets"].where("cik = '0000000001'").first()
    assert packet.packet_id == "packet-0000000001" and packet.insufficient_evidence and packet.missing_sections == sorted(set(U.SECTIONS) - {"ITEM1_OVERVIEW"}) and packet.passages[0].text == TEXT
    twice = t["issuer_decisions"].where("array_contains(reason_codes, 'DUPLICATE_ISSUER_RECORD')").collect()
    assert [r.cik for r in twice] == ["0000000001"] and twice[0].evidence.passage_id == "0000000001-cover"
    case = {r.case_id: r for r in t["review_queue"].collect()}["case-0000000012"]
    assert case.triggers == ["advisory_tier_conflicts_with_rule_tier", "boundary_flag_present"] and case.state == "resolved"
    assert case.classifier_summary == "archetypes=['FUNCTIONAL_SOFTWARE'] centrality=CO_ESSENTIAL structure=MIXED_NONSEPARABLE materiality=MATERIAL advisory_tier=TIER_B_EXTENSION"
    years = {int(r.cik): r for r in t["firm_years"].collect()}
    assert years[19].entry_type == "ipo" and years[19].dynamic_entrant and years[19].universe_class is None and years[18].exit_type == "acquired" and years[18].eligible_this_year
    assert {(r.company_id, r.relationship) for r in t["lineage"].collect()} == {("CIK0000000018", "target"), ("CIK0000000017", "name_change"), ("CIK0000000001", "share_class_same_issuer")}
    prompt = "Cutoff 2022-12-31\ncik: 0000000002\nname: Firm 2\nform: 10-K\nfiling_date: 2022-09-15\nsic: 1200\n---\n[source_id=s passage_id=p2 section=ITEM1_OVERVIEW date=2022-09-15]\n" + TEXT
    import hashlib

    assert t["screens"].where("cik = '0000000002'").first().prompt_hash == hashlib.sha256(prompt.encode()).hexdigest()


def test_sentinel_manifest(spark, sentinel_run, tmp_path):
    path = Path(U.write(spark, sentinel_run, str(tmp_path), "run-s", taxonomy_version="0.1.0", code_revision="abc", limitations=["invented"]))
    manifest = json.loads(next((path / "manifest").glob("part-*")).read_text())
    assert manifest["hard_gate_status"] == "pass" and manifest["sample_rules_version"] == "0.2.0" and manifest["manual_review_complete"] and manifest["counts"]["tier_a"] == 5
    again = Path(U.write(spark, sentinel_run, str(tmp_path), "run-t"))
    assert json.loads(next((again / "manifest").glob("part-*")).read_text())["output_hashes"] == manifest["output_hashes"]
    ids = [json.loads(x)["cik"] for f in sorted((path / "tier_decisions").glob("part-*")) for x in f.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == 23
    with pytest.raises(ValueError, match="manifest"):
        U.manifest(sentinel_run, "r", manifest["output_hashes"], counts={"tier_a": -1})
