"""The universe run: filers, passages, screens, classifications, adjudications and audit results become one decided row a
firm, with review cases, a negative audit, firm-years, an identity table, gates, counts, a freeze decision and a manifest.

Every step is a join or an aggregate keyed by the firm; only one-row counts and the names of failed gates reach the driver.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import rules, validation
from ..operators.longitudinal import checkpointed
from ..sources import files

# Fixed values.
SECTIONS = ["COVER_PAGE", "ITEM1_OVERVIEW", "PRODUCTS_SERVICES", "CUSTOMERS", "SEGMENTS_MATERIALITY", "TECHNOLOGY_DELIVERY"]
NEEDED_SECTIONS = ["ITEM1_OVERVIEW", "PRODUCTS_SERVICES"]
PROVENANCES = ["deterministic", "screen_derived", "economic_classification"]
SCREEN_STATUSES = ["LIKELY_ELIGIBLE", "LIKELY_INELIGIBLE", "BOUNDARY_OR_UNCERTAIN"]
INCLUDED = ["TIER_A_CORE", "TIER_B_EXTENSION", "TIER_C_BOUNDARY"]
NO_PASSAGES_DETAIL = "No baseline passages supplied for this candidate."
QUESTION = "Confirm or override the rule-derived tier %s for %s; triggers: %s."
NO_FORM = "NO_ELIGIBLE_ANNUAL_OPERATING_FILING"

_EVIDENCE = "array<struct<claim:string,source_id:string,passage_id:string,quote:string>>"
_SCREENED = "array<struct<source_id:string,passage_id:string,quote:string,supported_claim:string>>"
SCHEMAS = {
    "filers": "cik string, canonical_name string, accession_number string, filing_date date, form string, sic string, exchange string, ticker string, source_ids array<string>, "
    "issuer_status_flags struct<investment_company:boolean,asset_backed_issuer:boolean,non_operating_trust:boolean,shell_company:boolean,blank_check_precombination:boolean>",
    "passages": "cik string, passage_id string, source_id string, section string, publication_date date, text string, ord int",
    "screens": f"cik string, screen_status string, candidate_customer_value_archetypes array<string>, positive_evidence {_SCREENED}, negative_or_boundary_evidence {_SCREENED}, confidence string",
    "classifications": "cik string, baseline_cutoff date, baseline_filing_date date, customer_facing_functional_product boolean, operating_company boolean, customer_value_archetypes array<string>, software_centrality string, "
    f"firm_structure string, commercial_materiality string, contradictions array<string>, boundary_flags array<string>, exclusion_reason_codes array<string>, candidate_tier string, evidence {_EVIDENCE}",
    "adjudications": "adjudication_id string, case_id string, decision string, final_candidate_tier string, recorded_at timestamp",
    "audits": "cik string, audit_status string, reviewer string",
    "events": "cik string, operating_status string, public_status string, entry_type string, exit_type string",
    "lineage": "lineage_id string, company_id string, related_company_id string, relationship string, effective_date date, end_date date, evidence_source_id string",
}


@dataclass
class Universe:
    tables: dict[str, DataFrame]
    counts: dict[str, int]
    reconciliation: dict[str, bool]
    failed_gates: dict[str, int]
    blockers: list[str] = field(default_factory=list)
    version: str = "unreleased"
    cutoff: str = ""
    form_scope: list[str] = field(default_factory=list)
    seed: int | None = None
    rules: rules.Rules = rules.RULES

    @property
    def frozen(self) -> bool:
        return not self.blockers


def unresolved_quotes(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """Firms with a quote that stands in none of their own passages."""
    asked = quotes.where("quote is not null").distinct()
    hit = asked.join(passages.select("cik", "text"), "cik").where(F.contains("text", "quote")).select("cik", "quote").distinct()
    return asked.join(hit, ["cik", "quote"], "left_anti").select("cik").distinct()


def _flag(df: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    return df.join(bad.select("cik", F.lit(True).alias(name)), "cik", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def issuer_decisions(filers: DataFrame, cutoff: Column, form_scope: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(firms with decision and reasons, superseded records, entrants): the latest record of each baseline firm is judged by
    its form, then by its flags."""
    base = filers.where("cohort = 'baseline'")
    order = ["filing_date", "accession_number", "canonical_name"]
    flags = rules.flag_decision({f: F.col(f"issuer_status_flags.{f}") for f, _ in rules.FLAGS})
    in_scope = F.coalesce(F.col("form").isin(form_scope), F.lit(False))
    kept = R.best_per_key(base, ["cik"], order).withColumn("_d", flags)
    firms = kept.withColumns({"decision": F.when(in_scope, F.col("_d.decision")).otherwise("exclude"), "reason_codes": F.when(in_scope, F.col("_d.reason_codes")).otherwise(F.array(F.lit(NO_FORM)))}).drop("_d")
    return firms, R.superseded(base, ["cik"], order), filers.where("cohort <> 'baseline'")


def packets(firms: DataFrame, passages: DataFrame, cutoff: Column) -> DataFrame:
    """A packet or a failure of each firm: packet_status (PACKET, or why there is none), detail, the passages in their order,
    the sections that are missing, and whether these leave the evidence insufficient. One bad passage fails the whole packet."""
    one = F.struct("ord", "passage_id", "source_id", "section", "publication_date", "text")
    gathered = passages.groupBy("cik").agg(F.sort_array(F.collect_list(one)).alias("passages"))
    both = firms.join(gathered, "cik", "left").withColumn("passages", F.coalesce("passages", F.array().cast(dict(gathered.dtypes)["passages"])))
    broken = F.filter("passages", lambda p: p["publication_date"].isNull() | p["text"].isNull() | p["passage_id"].isNull() | ~F.coalesce(p["section"].isin(SECTIONS), F.lit(False)))
    late = F.filter("passages", lambda p: p["publication_date"] > cutoff)
    both = both.withColumns({"_broken": broken, "_late": late})
    named = lambda ps, text: F.array_join(F.transform(ps, text), "; ")
    status = F.when(F.size("passages") == 0, "NO_PASSAGES").when(F.size("_broken") > 0, "INVALID_PASSAGE").when(F.size("_late") > 0, "TEMPORAL_LEAKAGE").otherwise("PACKET")
    detail = (
        F.when(F.size("passages") == 0, NO_PASSAGES_DETAIL)
        .when(F.size("_broken") > 0, named(F.col("_broken"), lambda p: F.concat(F.lit("Passage "), F.coalesce(p["passage_id"], F.lit("?")), F.lit(" lacks a field or has an unknown section."))))
        .when(F.size("_late") > 0, named(F.col("_late"), lambda p: F.concat(F.lit("Passage "), p["passage_id"], F.lit(" dated "), p["publication_date"].cast("string"), F.lit(" is after baseline cutoff "), cutoff.cast("string"), F.lit("."))))
    )
    missing = S.missing_sections(F.transform("passages", lambda p: p["section"]), SECTIONS)
    short = S.overlaps(missing, F.array(*map(F.lit, NEEDED_SECTIONS)))
    return both.select(
        "cik", status.alias("packet_status"), detail.alias("packet_detail"), F.concat(F.lit("packet-"), "cik").alias("packet_id"), "company_id", cutoff.alias("baseline_cutoff"),
        F.col("accession_number").alias("baseline_accession"), F.col("filing_date").alias("baseline_filing_date"), "passages", missing.alias("missing_sections"), short.alias("insufficient_evidence"),
    )


def prompts(firms: DataFrame, built: DataFrame, template: str) -> DataFrame:
    """(cik, prompt) of each packet: the template with the cutoff, the firm's metadata and its passages filled in."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    about = F.concat_ws("\n", line("cik", "cik"), line("name", "canonical_name"), line("form", "form"), line("filing_date", "filing_date"), line("sic", "sic"))
    one = lambda p: F.concat(F.lit("[source_id="), p["source_id"], F.lit(" passage_id="), p["passage_id"], F.lit(" section="), p["section"], F.lit(" date="), p["publication_date"].cast("string"), F.lit("]\n"), p["text"])
    filled = S.render_prompt(template, {"baseline_cutoff": F.col("baseline_cutoff").cast("string"), "company_metadata": about, "passages_with_source_and_passage_ids": F.array_join(F.transform("passages", one), "\n\n")})
    return firms.select("cik", "canonical_name", "form", "filing_date", "sic").join(built.where("packet_status = 'PACKET'").select("cik", "baseline_cutoff", "passages"), "cik").select("cik", filled.alias("prompt"))


def screened(firms: DataFrame, passages: DataFrame, screens: DataFrame) -> DataFrame:
    """firms with screen_status, archetypes, confidence and screen_error (null: valid) for those that have a packet."""
    said = screens.select("cik", F.explode(F.concat(*(F.coalesce(F.col(c), F.array().cast(dict(screens.dtypes)[c])) for c in ("positive_evidence", "negative_or_boundary_evidence"))).getField("quote")).alias("quote"))
    got = _flag(screens.withColumn("_has", F.lit(True)), unresolved_quotes(said, passages), "_loose")
    some = F.coalesce(F.size("positive_evidence"), F.lit(0)) > 0
    error = (
        F.when(F.col("_has").isNull(), "missing_output").when(~F.coalesce(F.col("screen_status").isin(SCREEN_STATUSES), F.lit(False)), "unknown_status")
        .when((F.col("screen_status") == "LIKELY_ELIGIBLE") & ~some, "eligible_without_evidence").when(F.col("_loose"), "unresolved_quote")
    )
    keep = got.select("cik", "screen_status", F.col("candidate_customer_value_archetypes").alias("screen_archetypes"), F.col("confidence").alias("screen_confidence"), "positive_evidence", "_has", "_loose")
    packet = F.coalesce(F.col("packet_status") == "PACKET", F.lit(False))
    return firms.join(keep, "cik", "left").withColumn("screen_error", F.when(packet, error)).drop("positive_evidence", "_has", "_loose")


def classified(firms: DataFrame, passages: DataFrame, rows: DataFrame, cutoff: Column) -> DataFrame:
    """firms with the classification columns and classification_error: the first rule broken, in a fixed order."""
    said = rows.select("cik", F.explode("evidence.quote").alias("quote"))
    got = _flag(rows.withColumn("_has", F.lit(True)), unresolved_quotes(said, passages), "_loose")
    none = F.coalesce(F.size("evidence"), F.lit(0)) == 0
    claims = F.coalesce(F.col("software_centrality") != "UNKNOWN", F.lit(False)) | (F.size(F.array_except(F.coalesce("customer_value_archetypes", F.array().cast("array<string>")), F.array(F.lit("OTHER")))) > 0)
    error = (
        F.when(F.col("_has").isNull(), "missing_output").when(~F.col("baseline_cutoff").eqNullSafe(cutoff), "other_cutoff").when(F.col("baseline_filing_date") > cutoff, "filed_after_cutoff")
        .when(F.col("_loose"), "unresolved_quote").when(claims & none, "claims_without_evidence")
    )
    due = (F.col("packet_status") == "PACKET") & F.col("screen_error").isNull() & (F.col("screen_status") != "LIKELY_INELIGIBLE")
    out = firms.join(got, "cik", "left").withColumn("_due", F.coalesce(due, F.lit(False)))
    return out.withColumn("classification_error", F.when(F.col("_due"), error)).withColumn("is_classified", F.col("_due") & F.col("classification_error").isNull()).drop("_due", "_has", "_loose")


def decided(firms: DataFrame, config: rules.Rules = rules.RULES) -> DataFrame:
    """One derived tier a firm with provenance, reasons, trace and review triggers, by the first stage that settles it."""
    out = rules.derive_tier(firms, "exclusion_reason_codes", config)
    thin = rules.uncertainty(F.array(F.lit("insufficient_baseline_evidence")), config)
    settled = [
        (F.col("decision") == "exclude", rules.exclusion(F.col("reason_codes"), config, "issuer_filters", "deterministic")),
        (F.col("decision") == "unknown", rules.uncertainty(F.array(F.lit("unresolved_operating_status")), config)),
        (F.col("packet_status") != "PACKET", thin), (F.col("screen_error").isNotNull(), thin),
        (F.col("screen_status") == "LIKELY_INELIGIBLE", rules.exclusion(F.array(F.lit(rules.NO_PRODUCT)), config, "screen.likely_ineligible_pending_negative_audit", "screen_derived")),
        (~F.col("is_classified"), thin),
    ]
    tier = F.col("tier")
    for test, decision in reversed(settled):
        tier = F.when(test, decision).otherwise(tier)
    out = out.withColumn("tier", tier)
    none = F.array().cast("array<string>")
    conflict = F.when(F.col("is_classified") & ~F.col("candidate_tier").eqNullSafe(F.col("tier.derived_tier")), F.array(F.lit("advisory_tier_conflicts_with_rule_tier"))).otherwise(none)
    return out.withColumns({
        "derived_tier": F.col("tier.derived_tier"), "provenance": F.col("tier.exclusion_provenance"), "tier_reasons": F.col("tier.reasons"), "rule_trace": F.col("tier.trace"),
        "rules_version": F.col("tier.rules_version"), "rules_hash": F.col("tier.rules_hash"),
        "triggers": F.when(F.col("tier.needs_manual_review"), F.array_sort(F.array_distinct(F.concat("tier.review_reasons", conflict)))).otherwise(none), "case_id": F.concat(F.lit("case-"), F.col("cik")),
    }).drop("tier")


def review_cases(spine: DataFrame) -> DataFrame:
    """A case of each firm with triggers, with the classifier's summary, the evidence, its passages and the question."""
    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    summary = F.concat(rules.listed_text("archetypes", F.col("customer_value_archetypes")), F.lit(" centrality="), said("software_centrality"), F.lit(" structure="), said("firm_structure"), F.lit(" materiality="), said("commercial_materiality"), F.lit(" advisory_tier="), said("candidate_tier"))
    return spine.where(F.size("triggers") > 0).select(
        "case_id", "cik", "company_id", "derived_tier", "triggers", F.when(F.col("is_classified"), summary).alias("classifier_summary"), F.col("evidence").alias("conflicting_evidence"), F.array_sort(F.array_distinct("evidence.passage_id")).alias("passage_ids"),
        F.when(F.col("review_status") == "unreviewed", "open").otherwise("resolved").alias("state"),
        F.format_string(QUESTION, "derived_tier", "company_id", F.array_join("triggers", ", ")).alias("question"),
    )


def build(spark: SparkSession, bundle: dict[str, DataFrame], cutoff: str, form_scope: list[str], seed: int, per_stratum: int = 1, config: rules.Rules = rules.RULES, template: str | None = None) -> dict[str, DataFrame]:
    """The run's tables. bundle: a frame for each of SCHEMAS. Keys are normalised here; a record whose key is no identifier is
    in the gate's findings."""
    at = F.lit(cutoff).cast("date")
    b = {n: d.withColumn("cik", S.normalize_cik(F.col("cik"))) if "cik" in d.columns else d for n, d in bundle.items()}
    every = checkpointed(b["filers"].withColumns({"company_id": S.company_id(F.col("cik")), "cohort": S.cohort(F.col("filing_date"), at)}))
    invalid, filers = every.where("cik is null"), every.where("cik is not null")
    firms, twice, entrants = issuer_decisions(filers, at, form_scope)
    passages = b["passages"]
    built = packets(firms.where("decision = 'include'").select("cik", "company_id", "accession_number", "filing_date"), passages, at)
    spine = screened(firms.join(built.select("cik", "packet_status", "packet_detail", "missing_sections", "insufficient_evidence", F.size("passages").alias("passages")), "cik", "left"), passages, b["screens"])
    spine = decided(classified(spine, passages, b["classifications"], at), config)
    log = b["adjudications"].withColumn("_o", F.struct("recorded_at", "adjudication_id"))
    spine = checkpointed(_overlay(spine, log))

    cases = review_cases(spine)
    by_issuer = F.col("provenance") == "deterministic"
    reason = F.when(by_issuer, F.coalesce(F.get("reason_codes", F.lit(0)), F.lit("unknown"))).otherwise("screen_likely_ineligible")
    sure = F.when(by_issuer, "high").otherwise(F.col("screen_confidence"))
    signal = F.when(by_issuer, F.array().cast("array<string>")).otherwise(F.col("screen_archetypes"))
    pool = spine.where("provenance in ('deterministic', 'screen_derived')").select("cik", F.col("provenance").alias("excluded_by"), S.stratum(F.col("sic"), F.lit(None).cast("string"), signal, reason, sure).alias("stratum"))
    sample = R.stratified_sample(pool, ["stratum"], "cik", per_stratum, seed)
    screens = spine.where("screen_error is null and packet_status = 'PACKET'").select("cik", "screen_status", "screen_archetypes", "screen_confidence")
    if template is not None:
        screens = screens.join(prompts(firms, built, template), "cik").withColumn("prompt_hash", F.sha2("prompt", 256)).drop("prompt")
    cover = F.struct(
        F.concat_ws(" ", F.lit("Issuer record:"), F.array_join("reason_codes", ", ")).alias("claim"), F.coalesce(F.get("source_ids", F.lit(0)), F.concat(F.lit("fixture:"), "cik")).alias("source_id"),
        F.concat("cik", F.lit("-cover")).alias("passage_id"), F.concat_ws(" ", F.lit("Issuer record:"), F.array_join("reason_codes", ", ")).alias("quote"),
    )
    return {
        "filers": filers, "invalid_filers": invalid, "duplicates": twice, "entrants": entrants, "spine": spine, "audit_pool": pool, "audit_pending": sample.join(b["audits"].select("cik").distinct(), "cik", "left_anti"),
        "issuer_decisions": firms.select("cik", "company_id", "decision", "reason_codes", F.when(F.col("decision") == "exclude", cover).alias("evidence")).unionByName(
            twice.withColumn("reason_codes", F.array(F.lit("DUPLICATE_ISSUER_RECORD"))).select("cik", "company_id", F.lit("exclude").alias("decision"), "reason_codes", cover.alias("evidence"))),
        "packets": built.where("packet_status = 'PACKET'").drop("packet_detail"), "packet_failures": built.where("packet_status <> 'PACKET'").select("cik", "company_id", F.col("packet_status").alias("reason_code"), F.col("packet_detail").alias("detail"), "packet_status"),
        "screens": screens, "screen_failures": spine.where("screen_error is not null").select("cik", "screen_error"), "classification_failures": spine.where("classification_error is not null").select("cik", "classification_error"),
        "raw_classifications": b["classifications"], "tier_decisions": spine.select("cik", "company_id", "derived_tier", "provenance", "tier_reasons", "rule_trace", "triggers", "rules_version", "rules_hash"),
        "classifications": spine.where("is_classified").select("cik", "final_value", "review_status", "rule_trace", "rules_version", *(c for c in b["classifications"].columns if c != "cik")),
        "review_queue": cases, "audit_sample": sample.drop("draw", "place").withColumn("seed", F.lit(seed)), "audit_results": b["audits"].join(sample.select("cik"), "cik", "left_semi"),
        "firm_years": firm_years(spine, entrants, b["events"], at), "lineage": b["lineage"], "companies": identities(filers, spine, at), "adjudications": b["adjudications"],
        "gate_findings": gate_findings(spine, cases, invalid, b["classifications"]), "errors": error_table(built, spine),
    }


#: Tables that a run's folder holds; the others of build() serve counts and gates.
OUTPUTS = "filers issuer_decisions packets packet_failures screens screen_failures raw_classifications classification_failures tier_decisions classifications review_queue audit_sample audit_results firm_years lineage companies adjudications gate_findings errors".split()


def error_table(built: DataFrame, spine: DataFrame) -> DataFrame:
    """(stage, subject, code, detail): what failed in each stage."""
    of = lambda d, stage, code, detail: d.select(F.lit(stage).alias("stage"), F.col("cik").alias("subject"), F.col(code).alias("code"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    out = of(built.where("packet_status <> 'PACKET'"), "packet", "packet_status", F.col("packet_detail"))
    out = out.unionByName(of(spine.where("screen_error is not null"), "screen", "screen_error", none))
    return out.unionByName(of(spine.where("classification_error is not null"), "classification", "classification_error", none))


def run(spark: SparkSession, bundle: dict[str, DataFrame], cutoff: str, form_scope: list[str], seed: int, per_stratum: int = 1, version: str = "1", config: rules.Rules = rules.RULES, template: str | None = None) -> Universe:
    """build(), then gates, counts and the freeze decision; only one-row counts and the gates' names reach the driver."""
    t = build(spark, bundle, cutoff, form_scope, seed, per_stratum, config, template)
    failed = {r["gate"]: r["n"] for r in t["gate_findings"].groupBy("gate").agg(F.count("*").alias("n")).collect()}  # a row a gate
    counts = counts_row(t).first().asDict()
    identity = reconciliation(counts)
    blockers = [f"hard gate {g}: {n}" for g, n in sorted(failed.items())]
    blockers += [f"count identity fails: {k}" for k, ok in identity.items() if not ok]
    if counts["negative_audit_pending"]:
        blockers.append(f"negative audit: {counts['negative_audit_pending']} pending")
    return Universe({n: t[n] for n in OUTPUTS}, counts, identity, failed, blockers, "unreleased" if blockers else version, cutoff, list(form_scope), seed, config)


def _overlay(spine: DataFrame, log: DataFrame) -> DataFrame:
    """latest_overlay beside the spine's own `decision` column (the issuer filter's)."""
    over = R.latest_overlay(spine.select("case_id", "derived_tier"), log, "case_id", "_o", "derived_tier", "final_candidate_tier", "decision")
    return spine.join(over.select("case_id", "final_value", "review_status"), "case_id")


def firm_years(spine: DataFrame, entrants: DataFrame, events: DataFrame, cutoff: Column) -> DataFrame:
    """A row a firm: baseline firms first, entrants that are no baseline firm after them; events override defaults."""
    cols = ["cik", "company_id", "filing_date", "accession_number", "form", "exchange", "source_ids", F.col("issuer_status_flags.shell_company").alias("shell")]
    old = spine.select(*cols, F.col("final_value").alias("universe_class"), F.lit(False).alias("dynamic_entrant"))
    new = R.best_per_key(entrants, ["cik"], ["filing_date", "accession_number"], latest=False).join(spine.select("cik"), "cik", "left_anti")
    both = old.unionByName(new.select(*cols, F.lit(None).cast("string").alias("universe_class"), F.lit(True).alias("dynamic_entrant")))
    is_new, day = F.col("dynamic_entrant"), F.coalesce("filing_date", cutoff)
    eligible = F.when(~is_new & (F.col("universe_class") != "UNCERTAIN"), F.col("universe_class").isin(INCLUDED))
    return both.join(events, "cik", "left").select(
        F.concat_ws("-", "cik", F.year(day)).alias("firm_year_id"), "company_id", "cik", day.alias("observation_date"), "accession_number", F.coalesce("form", F.lit("unknown")).alias("form"), "universe_class",
        F.coalesce("operating_status", F.when(S.is_true(F.col("shell")), "shell").otherwise("operating")).alias("operating_status"),
        F.coalesce("public_status", F.when(F.coalesce("exchange", F.lit("")) != "", "listed").otherwise("unknown")).alias("public_status"),
        F.coalesce("entry_type", F.when(is_new, "new_filer").otherwise("baseline_incumbent")).alias("entry_type"), F.coalesce("exit_type", F.lit("none")).alias("exit_type"),
        eligible.alias("eligible_this_year"), (~is_new).alias("primary_incumbent"), "dynamic_entrant", "source_ids",
    )


def identities(filers: DataFrame, spine: DataFrame, cutoff: Column) -> DataFrame:
    """The earliest record of each firm, with its inclusion; an undated record is the earliest."""
    first = R.best_per_key(filers.withColumn("_d", F.coalesce("filing_date", F.lit("0001-01-01").cast("date"))), ["cik"], ["_d", "accession_number"], latest=False)
    tier = F.col("final_value")
    status = F.when(tier.isin(INCLUDED), "included").when(tier == "EXCLUDED", "excluded").otherwise("pending")
    why = F.when(tier.isin(INCLUDED), F.concat(F.lit("derived_tier="), tier)).when(tier == "EXCLUDED", "deterministic_or_economic_exclusion").otherwise("uncertain_or_entrant")
    return first.join(spine.select("cik", "final_value"), "cik", "left").select("company_id", F.col("canonical_name").alias("company_name"), "cik", "ticker", F.coalesce("filing_date", cutoff).alias("observation_start"), cutoff.alias("observation_end"), status.alias("inclusion_status"), why.alias("inclusion_reason"))


def gate_findings(spine: DataFrame, cases: DataFrame, invalid: DataFrame, raw: DataFrame) -> DataFrame:
    """What blocks a freeze. Leakage is looked for in the classifications as they came, as validation keeps such rows out."""
    done = spine.where("is_classified")
    empty = done.where(F.exists("evidence", lambda e: F.trim(F.coalesce(e["quote"], F.lit(""))) == ""))
    found = [
        R.findings("empty_quote", empty, "cik"), R.findings("temporal_leakage", raw.where("baseline_filing_date > baseline_cutoff"), "cik"),
        R.findings("inclusion_without_evidence", done.where(F.col("derived_tier").isin(INCLUDED) & (F.coalesce(F.size("evidence"), F.lit(0)) == 0)), "cik"),
        R.findings("excluded_issuer_in_core", spine.where("decision = 'exclude' and derived_tier = 'TIER_A_CORE'"), "cik"), R.findings("repeated_firm", R.repeated(spine, ["cik"]), "cik"),
        R.findings("open_review_case", cases.where("state = 'open'"), "case_id"), R.findings("invalid_identifier", invalid, "canonical_name"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def counts_row(t: dict[str, DataFrame]) -> DataFrame:
    """One row of all counts: an aggregate a frame, beside each other."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    good = F.col("screen_error").isNull() & (F.col("packet_status") == "PACKET")
    n = lambda name: F.count("*").alias(name)
    rows = [
        t["filers"].agg(n("filer_records"), F.count_distinct("cik").alias("unique_firms"), F.count_if(F.col("cohort") == "baseline").alias("baseline_candidate_records")),
        t["duplicates"].agg(n("baseline_duplicates")), t["entrants"].agg(n("entrant_records")),
        t["entrants"].join(t["spine"].select("cik"), "cik", "left_anti").agg(F.count_distinct("cik").alias("post_baseline_entrants")),
        t["spine"].agg(
            n("baseline_firms"), is_("decision", "exclude").alias("issuer_excluded"), is_("decision", "unknown").alias("issuer_unknown"), is_("packet_status", "PACKET").alias("packets_built"),
            F.count_if(F.col("packet_status") != "PACKET").alias("packet_failures"), F.count_if(good).alias("screened"), F.count("screen_error").alias("screen_failures"), F.count_if(F.col("is_classified")).alias("classified"), F.count("classification_error").alias("classification_failures"),
            *(F.count_if((F.col("screen_status") == s) & good).alias(s.lower()) for s in SCREEN_STATUSES),
            *(is_("final_value", v).alias(k) for k, v in (("tier_a", INCLUDED[0]), ("tier_b", INCLUDED[1]), ("tier_c", INCLUDED[2]), ("excluded", "EXCLUDED"), ("uncertain", "UNCERTAIN"))),
            *(is_("provenance", p).alias(f"excluded_{p}") for p in PROVENANCES),
            F.count_if((F.col("final_value") == "EXCLUDED") & F.col("provenance").isNull()).alias("excluded_by_review"), F.count_if((F.col("final_value") != "EXCLUDED") & F.col("provenance").isNotNull()).alias("readmitted_by_review"),
        ),
        t["review_queue"].agg(n("review_cases"), is_("state", "resolved").alias("review_cases_resolved"), is_("state", "open").alias("review_cases_open")),
        t["audit_pool"].agg(n("negative_audit_pool")), t["audit_sample"].agg(n("negative_audit_sampled")), t["audit_pending"].agg(n("negative_audit_pending")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # one row each
    return out.withColumns({"duplicate_records": F.col("filer_records") - F.col("unique_firms"), "negative_audit_completed": F.col("negative_audit_sampled") - F.col("negative_audit_pending")})


def reconciliation(n: dict[str, int]) -> dict[str, bool]:
    return {
        "unique_firms = baseline_firms + post_baseline_entrants": n["unique_firms"] == n["baseline_firms"] + n["post_baseline_entrants"],
        "filer_records = baseline_firms + baseline_duplicates + entrant_records": n["filer_records"] == n["baseline_firms"] + n["baseline_duplicates"] + n["entrant_records"],
        "baseline_firms = tiers + excluded + uncertain": n["baseline_firms"] == sum(n[k] for k in ("tier_a", "tier_b", "tier_c", "excluded", "uncertain")),
        "excluded = by provenance + by review - readmitted": n["excluded"] == sum(n[f"excluded_{p}"] for p in PROVENANCES) + n["excluded_by_review"] - n["readmitted_by_review"],
    }


#: The manifest's shape.
MANIFEST = {
    "type": "object", "additionalProperties": False,
    "required": ["run_id", "universe_version", "baseline_cutoff", "form_scope", "candidate_frame_hash", "taxonomy_version", "sample_rules_version", "schema_versions", "run_timestamp", "counts", "hard_gate_status", "output_hashes"],
    "properties": {
        **{k: {"type": "string"} for k in ("run_id", "universe_version", "candidate_frame_hash", "taxonomy_version", "sample_rules_version", "sample_rules_hash")},
        **{k: {"type": ["string", "null"]} for k in ("source_manifest_hash", "code_revision", "packet_builder_version", "screen_prompt_hash", "classification_prompt_hash")},
        **{k: {"type": "array", "items": {"type": "string"}} for k in ("form_scope", "model_routes", "eval_report_ids", "limitations", "blockers")},
        **{k: {"type": "object", "additionalProperties": {"type": "string"}} for k in ("schema_versions", "output_hashes")},
        **{k: {"type": "object", "additionalProperties": {"type": "integer", "minimum": 0}} for k in ("counts", "failed_gates")},
        "reconciliation": {"type": "object", "additionalProperties": {"type": "boolean"}}, "baseline_cutoff": {"type": "string", "format": "date"}, "run_timestamp": {"type": "string", "format": "date-time"},
        "negative_audit_seed": {"type": ["integer", "null"]}, "manual_review_complete": {"type": "boolean"}, "hard_gate_status": {"enum": ["pass", "fail", "not_run"]},
    },
}


def manifest(u: Universe, run_id: str, output_hashes: dict[str, str], **more) -> dict:
    """The run's manifest, checked against MANIFEST. more: versions, revisions, prompt hashes, routes, limitations."""
    out = {
        "run_id": run_id, "universe_version": u.version, "baseline_cutoff": u.cutoff, "form_scope": u.form_scope, "candidate_frame_hash": output_hashes["filers"], "source_manifest_hash": None, "code_revision": None,
        "packet_builder_version": None, "screen_prompt_hash": None, "classification_prompt_hash": None, "model_routes": ["replay"], "taxonomy_version": "unversioned", "sample_rules_version": u.rules.version, "sample_rules_hash": u.rules.digest,
        "schema_versions": {}, "negative_audit_seed": u.seed, "eval_report_ids": [], "manual_review_complete": not u.counts["review_cases_open"], "run_timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "counts": u.counts,
        "reconciliation": u.reconciliation, "failed_gates": u.failed_gates, "blockers": u.blockers, "hard_gate_status": "pass" if not u.failed_gates and not u.counts["negative_audit_pending"] else "fail", "limitations": [], "output_hashes": output_hashes,
    } | more
    if errors := validation.document_errors(MANIFEST, out):
        raise ValueError(f"manifest: {'; '.join(errors[:5])}")
    return out


#: What each table is sorted by where it is written.
_SORTED = {"review_queue": "case_id", "lineage": "lineage_id", "adjudications": "adjudication_id", "gate_findings": "gate", "errors": "stage"}


def write(spark: SparkSession, u: Universe, base: str, run_id: str, **more) -> str:
    """Write each table once to a new run folder, sorted, as JSON lines; then the manifest with each table's content hash, the
    counts and what else is given (see manifest)."""
    path = files.run_directory(spark, base, run_id)
    hashes = {}
    for name, df in u.tables.items():
        files.write_jsonl(df.orderBy(_SORTED.get(name, "cik") if _SORTED.get(name, "cik") in df.columns else df.columns[0]), f"{path}/{name}")
        hashes[name] = files.content_hash(spark.read.text(f"{path}/{name}/*.json"))
    files.write_json(spark, manifest(u, run_id, hashes, **more), f"{path}/manifest")
    return path


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The frames of SCHEMAS from `<name>.jsonl`, and manifest.json. Missing files and manifest keys are named, all at once."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    paths = {n: f"{folder}/{n}.jsonl" for n in SCHEMAS}
    lost = [p for p in [*paths.values(), f"{folder}/manifest.json"] if not hadoop(p).getFileSystem(conf).exists(hadoop(p))]
    if lost:
        raise FileNotFoundError(", ".join(lost))
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    if absent := [k for k in ("baseline_cutoff", "form_scope", "universe_version_on_freeze") if k not in manifest]:
        raise ValueError(f"manifest lacks {absent}")
    return {n: files.read_jsonl(spark, p, SCHEMAS[n]) for n, p in paths.items()}, manifest
