"""A declarative tier cascade, read from a versioned configuration and compiled to one Spark expression that yields the
decision and its trace. Names in a configuration that no test stands for are refused; so are codes in the data that it
doesn't list (the query fails and names them)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_false, is_true, overlaps
from ..sources.files import read_config

# Fixed values of the sample rules.
DEFAULTS = {
    "rules_version": "0.2.0",
    "tier_a_core": {
        "operating_company_required": True,
        "baseline_annual_filing_required": True,
        "customer_facing_functional_product_required": True,
        "allowed_archetypes": ["FUNCTIONAL_SOFTWARE", "ADAPTIVE_DIGITAL_SERVICE", "DATA_ANALYTICS_PRODUCT"],
        "allowed_software_centrality": ["CORE", "CO_ESSENTIAL"],
        "allowed_firm_structure": ["PURE_PLAY", "SOFTWARE_DOMINANT"],
        "allowed_materiality": ["DOMINANT", "MATERIAL"],
        "manual_review_if": ["software_centrality_is_CO_ESSENTIAL", "multiple_material_archetypes", "contradictory_materiality_evidence", "boundary_flag_present"],
    },
    "tier_b_extension": {
        "candidate_archetypes": ["TRANSACTION_INFRASTRUCTURE", "DATA_ANALYTICS_PRODUCT", "HARDWARE_SOFTWARE_SYSTEM", "HUMAN_MANAGED_SERVICE", "FUNCTIONAL_SOFTWARE", "ADAPTIVE_DIGITAL_SERVICE"],
        "candidate_firm_structure": ["MIXED_SEPARABLE", "SOFTWARE_DOMINANT", "PURE_PLAY"],
        "outcome_analysis_requires_segment_mapping": True,
    },
    "tier_c_boundary": {
        "default_archetypes": ["MARKETPLACE_COORDINATION", "CONTENT_CATALOG", "ATTENTION_SOCIAL_PLATFORM", "INTERACTIVE_ENTERTAINMENT", "ECOMMERCE_RETAIL", "PHYSICAL_SERVICE_NETWORK"],
        "also_include_if": ["software_centrality_is_ENABLING", "software_centrality_is_PERIPHERAL", "firm_structure_is_SOFTWARE_PERIPHERAL", "mixed_nonseparable_without_clean_outcome_mapping"],
    },
    "excluded": {
        "deterministic_reason_codes": [
            "FUND_OR_INVESTMENT_COMPANY", "ASSET_BACKED_ISSUER", "TRUST_WITHOUT_OPERATING_BUSINESS", "SHELL_OR_PRECOMBINATION_SPAC",
            "NO_ELIGIBLE_ANNUAL_OPERATING_FILING", "DUPLICATE_ISSUER_RECORD", "NO_CUSTOMER_FACING_DIGITAL_PRODUCT",
        ]
    },
    "uncertain": {"conditions": ["insufficient_baseline_evidence", "unresolved_operating_status", "contradictory_axis_classification", "unresolved_materiality", "unresolved_lineage"]},
}
NO_PRODUCT = "NO_CUSTOMER_FACING_DIGITAL_PRODUCT"
FLAGS = (
    ("investment_company", "FUND_OR_INVESTMENT_COMPANY"),
    ("asset_backed_issuer", "ASSET_BACKED_ISSUER"),
    ("non_operating_trust", "TRUST_WITHOUT_OPERATING_BUSINESS"),
    ("shell_company", "SHELL_OR_PRECOMBINATION_SPAC"),
    ("blank_check_precombination", "SHELL_OR_PRECOMBINATION_SPAC"),
)
# Details that a trace must hold.
NO_PRODUCT_FOUND = "Classification found no customer-facing digital product."
NO_RULE_MATCHED = "No tier rule matched the stored axes; routing to review."
TRACE = "array<struct<rule_id:string,result:string,detail:string>>"

_SOME = lambda c: F.size(c) > 0
_IS = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
#: What a name in a configuration tests.
REVIEW_TESTS: dict[str, Callable[[], Column]] = {
    "software_centrality_is_CO_ESSENTIAL": lambda: _IS("software_centrality", "CO_ESSENTIAL"),
    "multiple_material_archetypes": lambda: F.size(F.array_distinct("customer_value_archetypes")) > 1,
    "contradictory_materiality_evidence": lambda: _SOME("contradictions"),
    "boundary_flag_present": lambda: _SOME("boundary_flags"),
}
INCLUDE_TESTS: dict[str, Callable[[], Column]] = {
    "software_centrality_is_ENABLING": lambda: _IS("software_centrality", "ENABLING"),
    "software_centrality_is_PERIPHERAL": lambda: _IS("software_centrality", "PERIPHERAL"),
    "firm_structure_is_SOFTWARE_PERIPHERAL": lambda: _IS("firm_structure", "SOFTWARE_PERIPHERAL"),
    "mixed_nonseparable_without_clean_outcome_mapping": lambda: _IS("firm_structure", "MIXED_NONSEPARABLE"),
}
UNCERTAIN_TESTS: list[tuple[str, Callable[[], Column]]] = [
    ("insufficient_baseline_evidence", lambda: F.col("customer_facing_functional_product").isNull()),
    ("unresolved_operating_status", lambda: F.col("operating_company").isNull()),
    ("contradictory_axis_classification", lambda: _SOME("contradictions")),
    ("unresolved_materiality", lambda: _IS("commercial_materiality", "UNKNOWN")),
    ("insufficient_baseline_evidence", lambda: _IS("software_centrality", "UNKNOWN")),
]


@dataclass(frozen=True)
class Rules:
    """A configuration, its version, and the sha256 of the text it came from, which each decision carries."""

    config: dict
    version: str
    digest: str

    @classmethod
    def of(cls, config: dict, digest: str | None = None) -> Rules:
        """Refuses absent parts and unknown names, all named at once."""
        wrong = [f"no {k}" for k in DEFAULTS if k not in config]
        for part, key, known in (
            ("tier_a_core", "manual_review_if", REVIEW_TESTS), ("tier_c_boundary", "also_include_if", INCLUDE_TESTS),
        ):
            wrong += [f"{part}.{key}: {n}" for n in config.get(part, {}).get(key) or [] if n not in known]
        wrong += [f"uncertain.conditions lacks {n}" for n, _ in UNCERTAIN_TESTS if n not in (config.get("uncertain") or {}).get("conditions", [])][:1]
        if wrong:
            raise ValueError(f"rules: {', '.join(wrong)}")
        plain = json.dumps(config, sort_keys=True)
        return cls(config, str(config["rules_version"]), digest or hashlib.sha256(plain.encode()).hexdigest())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Rules:
        """From a YAML or JSON file on any file system that Spark reads."""
        config, digest = read_config(spark, path)
        return cls.of(config, digest)

    def part(self, name: str) -> dict:
        return self.config[name]


RULES = Rules.of(DEFAULTS)


def _found(pairs: list[tuple[Column, str]]) -> Column:
    """The names whose test holds, in order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.when(test, name) for test, name in pairs)), lambda x: x.isNotNull())


def flag_decision(flags: dict[str, Column]) -> Column:
    """decision, reason_codes: an affirmative flag excludes, else an unresolved one leaves it unknown, else include."""
    reasons = F.array_distinct(_found([(is_true(flags[f]), code) for f, code in FLAGS if f in flags]))
    open_ = _found([(flags[f].isNull(), f) for f, _ in FLAGS if f in flags])
    decision = F.when(F.size(reasons) > 0, "exclude").when(F.size(open_) > 0, "unknown").otherwise("include")
    return F.struct(decision.alias("decision"), reasons.alias("reason_codes"), open_.alias("unresolved"))


def uncertain_conditions() -> Column:
    return F.array_distinct(_found([(test(), name) for name, test in UNCERTAIN_TESTS]))


def checked(codes: Column, known: list[str], what: str) -> Column:
    """codes; a row with one that isn't known fails the query, which names it."""
    other = F.array_sort(F.array_except(codes, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
    return F.when(F.size(other) > 0, F.raise_error(F.concat(F.lit(f"{what} not in the rule config: "), F.array_join(other, ", ")))).otherwise(codes)


def listed_text(name: str, values: Column) -> Column:
    """name=['a', 'b'] of a sorted array."""
    return F.concat(F.lit(f"{name}=["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def _said(name: str, column: str) -> Column:
    c = F.col(column)
    return F.concat(F.lit(f"{name}="), F.coalesce(F.when(c, "True").when(~c, "False"), F.lit("None")))


def _plain(name: str, column: str) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(F.col(column).cast("string"), F.lit("None")))


def _entry(rule: str | Column, result: str | Column, detail: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(rule).alias("rule_id"), as_column(result).alias("result"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def exclusion(codes: Column, rules: Rules, source: str, provenance: str, before: Column | None = None) -> Column:
    """The decision on a firm that is excluded for its codes."""
    known = checked(codes, rules.part("excluded")["deterministic_reason_codes"], "Reason codes")
    last = F.array(_entry(source, "pass", listed_text("reason_codes", F.array_sort(F.array_distinct(codes)))))
    return _decision("EXCLUDED", rules, reasons=known, provenance=provenance, trace=last if before is None else F.concat(before, last))


def uncertainty(conditions: Column, rules: Rules) -> Column:
    """The decision on a firm that can't be classified."""
    known = checked(conditions, rules.part("uncertain")["conditions"], "Uncertain conditions")
    return _decision("UNCERTAIN", rules, reasons=known, trace=F.transform(conditions, lambda u: _entry(F.concat(F.lit("uncertain."), u), "pass")))


def _decision(tier: str, rules: Rules, reasons: Column | None = None, review: Column | None = None, provenance: str | None = None, trace: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    review = none if review is None else review
    return F.struct(
        F.lit(tier).alias("derived_tier"), F.lit(provenance).cast("string").alias("exclusion_provenance"), (none if reasons is None else reasons).alias("reasons"), review.alias("review_reasons"),
        (F.size(review) > 0).alias("needs_manual_review"), trace.cast(TRACE).alias("trace"), F.lit(rules.version).alias("rules_version"), F.lit(rules.digest).alias("rules_hash"),
    )


def derive_tier(df: DataFrame, exclusion_codes: str | None = None, rules: Rules | dict = RULES) -> DataFrame:
    """df with `tier` (derived_tier, exclusion_provenance, reasons, review_reasons, needs_manual_review, trace, rules_version,
    rules_hash). Columns: the four axes, customer_value_archetypes, contradictions and boundary_flags as arrays (null:
    empty), baseline_filing_date, and the two three-valued booleans."""
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    for c in ("customer_value_archetypes", "contradictions", "boundary_flags"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.array().cast("array<string>")))
    a, b, c_ = (rules.part(k) for k in ("tier_a_core", "tier_b_extension", "tier_c_boundary"))
    listed = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    product, types = F.col("customer_facing_functional_product"), F.col("customer_value_archetypes")
    in_ = lambda name, xs: F.coalesce(F.col(name).isin(xs), F.lit(False)) if xs else F.lit(False)
    kinds = listed_text("archetypes", F.array_sort(F.array_distinct(types)))
    a_checks = [
        ("operating_company_required", is_true(F.col("operating_company")), _said("operating_company", "operating_company")),
        ("baseline_annual_filing_required", F.col("baseline_filing_date").isNotNull(), _plain("baseline_filing_date", "baseline_filing_date")),
        ("customer_facing_functional_product_required", is_true(product), _said("customer_facing_functional_product", "customer_facing_functional_product")),
        ("allowed_archetypes", overlaps(types, listed(a["allowed_archetypes"])), kinds),
        ("allowed_software_centrality", in_("software_centrality", a["allowed_software_centrality"]), _plain("software_centrality", "software_centrality")),
        ("allowed_firm_structure", in_("firm_structure", a["allowed_firm_structure"]), _plain("firm_structure", "firm_structure")),
        ("allowed_materiality", in_("commercial_materiality", a["allowed_materiality"]), _plain("commercial_materiality", "commercial_materiality")),
    ]
    a_review = [(n, REVIEW_TESTS[n]()) for n in a.get("manual_review_if") or []]
    c_checks = [("default_archetypes", overlaps(types, listed(c_["default_archetypes"])))] + [(f"also_include_if.{n}", INCLUDE_TESTS[n]()) for n in c_.get("also_include_if") or []]
    a_ok, c_ok = F.lit(True), F.lit(False)
    for _, t, _d in a_checks:
        a_ok = a_ok & t
    for _, t in c_checks:
        c_ok = c_ok | t
    b_ok = overlaps(types, listed(b["candidate_archetypes"])) & in_("firm_structure", b["candidate_firm_structure"]) & ~_IS("software_centrality", "PERIPHERAL") & is_true(product)
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col(exclusion_codes), none) if exclusion_codes else none
    codes = F.array_sort(F.array_distinct(F.concat(given, F.when(is_false(product), F.array(F.lit(NO_PRODUCT))).otherwise(none))))
    step = df.withColumns({"_codes": codes, "_unsure": uncertain_conditions(), "_a": a_ok, "_b": b_ok, "_c": c_ok})
    passed = lambda t, miss: F.when(t, "pass").otherwise(miss)
    trace_a = F.array(*(_entry(f"tier_a_core.{n}", passed(t, "fail"), d) for n, t, d in a_checks))
    review_a = [_entry(f"tier_a_core.manual_review_if.{n}", passed(t, "not_applicable")) for n, t in a_review]
    trace_b = F.array(_entry("tier_b_extension.candidate_match", passed(F.col("_b"), "fail"), F.concat(kinds, F.lit(" "), _plain("structure", "firm_structure"), F.lit(" "), _plain("centrality", "software_centrality"))))
    trace_c = F.array(*(_entry(f"tier_c_boundary.{n}", passed(t, "not_applicable")) for n, t in c_checks))
    no_product = F.when(is_false(product), F.array(_entry("excluded.no_customer_facing_digital_product", "pass", F.lit(NO_PRODUCT_FOUND)))).otherwise(F.array().cast(TRACE))
    fallback = F.array(_entry("uncertain.contradictory_axis_classification", "pass", F.lit(NO_RULE_MATCHED)))
    flagged = (REVIEW_TESTS["boundary_flag_present"](), "boundary_flag_present")
    mapping = [(_IS("firm_structure", "MIXED_SEPARABLE"), "outcome_analysis_requires_segment_mapping")] if b.get("outcome_analysis_requires_segment_mapping") else []
    tier = (
        F.when(F.size("_codes") > 0, exclusion(F.col("_codes"), rules, "excluded.deterministic_reason_codes", "economic_classification", no_product))
        .when(F.size("_unsure") > 0, uncertainty(F.col("_unsure"), rules))
        .when(F.col("_a"), _decision("TIER_A_CORE", rules, review=_found([(t, n) for n, t in a_review]), trace=F.concat(trace_a, F.array(*review_a)) if review_a else trace_a))
        .when(F.col("_b"), _decision("TIER_B_EXTENSION", rules, review=_found([*mapping, flagged]), trace=F.concat(trace_a, trace_b)))
        .when(F.col("_c"), _decision("TIER_C_BOUNDARY", rules, review=_found([flagged]), trace=F.concat(trace_a, trace_b, trace_c)))
        .otherwise(_decision("UNCERTAIN", rules, reasons=F.array(F.lit("contradictory_axis_classification")), review=F.array(F.lit("no_tier_rule_matched")), trace=F.concat(trace_a, trace_b, trace_c, fallback)))
    )
    return step.withColumn("tier", tier).drop("_codes", "_unsure", "_a", "_b", "_c")
