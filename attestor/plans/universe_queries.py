"""The universe run over the driver's tables, each output beside its SQL. Customers stand for filers: their fields, passages,
screens, classifications, adjudications, audits and events follow from the key, so that every branch has firms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import universe as U
from .catalogue import _DEC, ORACLES, QUERIES, TIER_SQL, classified

CUTOFF, SCOPE, SEED = "2022-12-31", ["10-K"], 42
_FINAL = ["TIER_B_EXTENSION", "TIER_A_CORE"]


def bundle(customer: DataFrame) -> dict[str, DataFrame]:
    k = F.col("k")
    c = customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    text = lambda e: e.cast("string")
    pad = F.lpad(text(k), 10, "0")
    cik = F.when(k % 50 == 7, F.concat(F.lit("x"), text(k))).when(k % 2 == 0, F.concat(F.lit(" 00"), text(k))).otherwise(text(k))
    filed = F.when(k % 41 != 0, F.date_add(F.lit("2022-01-01").cast("date"), (k % 400).cast("int")))
    flags = {
        "investment_company": F.when(k % 53 == 0, True).when(k % 59 == 0, F.lit(None)).otherwise(False), "asset_backed_issuer": F.lit(False), "non_operating_trust": F.lit(False),
        "shell_company": k % 61 == 0, "blank_check_precombination": (k % 61 == 0) | (k % 67 == 0),
    }
    filers = c.withColumn("twice", F.explode(F.when(k % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        cik.alias("cik"), F.col("name").alias("canonical_name"), F.concat(pad, F.lit("-22-00000"), (1 - F.col("twice")).cast("string")).alias("accession_number"), F.date_sub(filed, F.col("twice") * 30).alias("filing_date"),
        F.when(k % 23 == 0, "8-K").when(k % 47 != 0, "10-K").alias("form"), text(k % 9000 + 1000).alias("sic"), F.when(k % 3 != 0, "X").alias("exchange"), F.concat(F.lit("T"), text(k)).alias("ticker"),
        F.when(k % 5 != 0, F.array(F.concat(F.lit("s"), text(k)))).otherwise(F.array().cast("array<string>")).alias("source_ids"), F.struct(*(v.cast("boolean").alias(n) for n, v in flags.items())).alias("issuer_status_flags"),
    )
    day = F.when(k % 31 == 0, F.lit(None)).when(k % 29 == 0, F.lit("2023-02-01")).otherwise(F.lit("2022-06-01")).cast("date")
    parts = F.array(F.struct(F.lit(0).alias("ord"), F.lit("ITEM1_OVERVIEW").alias("section")), F.struct(F.lit(1).alias("ord"), F.when(k % 4 != 0, "PRODUCTS_SERVICES").otherwise("CUSTOMERS").alias("section")))
    passages = c.where("k % 9 <> 0").select("k", "name", F.explode(parts).alias("p")).select(
        text(k).alias("cik"), F.concat(F.lit("p"), F.col("p.ord").cast("string")).alias("passage_id"), F.lit("s").alias("source_id"), F.col("p.section").alias("section"), day.alias("publication_date"),
        F.concat("name", F.lit(" sells planning software to ports")).alias("text"), F.col("p.ord").alias("ord"),
    )
    said = F.when(k % 17 == 0, "nowhere").otherwise("planning software")
    seen = F.when(k % 19 == 0, F.array().cast("array<struct<source_id:string,passage_id:string,quote:string,supported_claim:string>>")).otherwise(F.array(F.struct(F.lit("s").alias("source_id"), F.lit("p0").alias("passage_id"), said.alias("quote"), F.lit("c").alias("supported_claim"))))
    status = F.when(k % 71 == 0, "MAYBE").when(k % 5 == 0, "LIKELY_INELIGIBLE").when(k % 5 == 1, "BOUNDARY_OR_UNCERTAIN").otherwise("LIKELY_ELIGIBLE")
    screens = c.where("k % 13 <> 0").select(text(k).alias("cik"), status.alias("screen_status"), F.array(F.lit("OTHER")).alias("candidate_customer_value_archetypes"), seen.alias("positive_evidence"), F.slice(seen, 1, 0).alias("negative_or_boundary_evidence"), F.lit("low").alias("confidence"))
    quote = F.when(k % 43 == 0, "nowhere").otherwise("planning")
    proof = F.when(k % 73 == 0, F.array().cast("array<struct<claim:string,source_id:string,passage_id:string,quote:string>>")).otherwise(F.array(F.struct(F.lit("c").alias("claim"), F.lit("s").alias("source_id"), F.lit("p0").alias("passage_id"), quote.alias("quote"))))
    none = F.array().cast("array<string>")
    axes = classified(c.select(k.alias("p_partkey"))).withColumnRenamed("p_partkey", "k").where("k % 11 <> 0").select(
        text(k).alias("cik"), F.when(k % 37 == 0, "2021-12-31").otherwise(CUTOFF).cast("date").alias("baseline_cutoff"), F.when(k % 79 == 0, "2023-02-01").otherwise("2022-09-15").cast("date").alias("baseline_filing_date"),
        "customer_facing_functional_product", "operating_company", "customer_value_archetypes", "software_centrality", "firm_structure", "commercial_materiality", "contradictions", "boundary_flags", none.alias("exclusion_reason_codes"),
        F.when(k % 2 == 0, "TIER_A_CORE").otherwise("TIER_B_EXTENSION").alias("candidate_tier"), proof.alias("evidence"),
    )
    pick = lambda xs, e: F.get(F.array(*map(F.lit, xs)), e.cast("int"))
    log = c.where("k % 3 = 0").withColumn("again", F.explode(F.when(k % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    adjudications = log.select(
        F.concat(F.lit("a"), text(k), F.lit("-"), text(F.col("again"))).alias("adjudication_id"), F.concat(F.lit("case-"), pad).alias("case_id"), pick(_DEC, (k + F.col("again")) % 4).alias("decision"), pick(_FINAL, (k + F.col("again")) % 2).alias("final_candidate_tier"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.col("again")).cast("timestamp").alias("recorded_at"),
    )
    audits = c.where("k % 2 = 0").select(text(k).alias("cik"), F.lit("confirmed").alias("audit_status"), F.lit("r").alias("reviewer"))
    events = c.where("k % 7 = 0").select(text(k).alias("cik"), *(F.lit(None).cast("string").alias(n) for n in ("operating_status", "public_status", "entry_type")), F.lit("acquired").alias("exit_type"))
    lineage = customer.sparkSession.createDataFrame([], U.SCHEMAS["lineage"])
    return {"filers": filers, "passages": passages, "screens": screens, "classifications": axes, "adjudications": adjudications, "audits": audits, "events": events, "lineage": lineage}


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return U.build(spark, bundle(spark.read.parquet(f"{sf}/customer.parquet")), CUTOFF, SCOPE, SEED)


# The same in SQL: r has the records, f the baseline firms with their latest record, then a column for each step's outcome.
_RUN = (
    "WITH r AS (SELECT c_custkey AS k, c_name AS name, d AS twice, lpad(c_custkey::VARCHAR, 10, '0') AS cik, lpad(c_custkey::VARCHAR, 10, '0') || '-22-00000' || (1 - d) AS acc, CASE WHEN c_custkey % 41 <> 0 THEN DATE '2022-01-01' + (c_custkey % 400)::INT - d * 30 END AS filed, "
    "CASE WHEN c_custkey % 23 = 0 THEN '8-K' WHEN c_custkey % 47 <> 0 THEN '10-K' END AS form FROM customer JOIN (VALUES (0), (1)) t(d) ON d = 0 OR c_custkey % 10 = 3 WHERE c_custkey % 50 <> 7 AND c_custkey <> 0), "
    "f AS (SELECT *, CASE WHEN form IS DISTINCT FROM '10-K' THEN 'exclude' WHEN k % 53 = 0 OR k % 61 = 0 OR k % 67 = 0 THEN 'exclude' WHEN k % 59 = 0 THEN 'unknown' ELSE 'include' END AS decision, "
    "CASE WHEN form IS DISTINCT FROM '10-K' THEN 'NO_ELIGIBLE_ANNUAL_OPERATING_FILING' ELSE concat_ws(';', CASE WHEN k % 53 = 0 THEN 'FUND_OR_INVESTMENT_COMPANY' END, CASE WHEN k % 61 = 0 OR k % 67 = 0 THEN 'SHELL_OR_PRECOMBINATION_SPAC' END) END AS codes "
    f"FROM r WHERE filed IS NULL OR filed <= DATE '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY k ORDER BY filed DESC NULLS LAST, acc DESC) = 1), "
    "p AS (SELECT *, CASE WHEN decision <> 'include' THEN NULL WHEN k % 9 = 0 THEN 'NO_PASSAGES' WHEN k % 31 = 0 THEN 'INVALID_PASSAGE' WHEN k % 29 = 0 THEN 'TEMPORAL_LEAKAGE' ELSE 'PACKET' END AS packet FROM f), "
    "s AS (SELECT *, CASE WHEN k % 71 = 0 THEN 'MAYBE' WHEN k % 5 = 0 THEN 'LIKELY_INELIGIBLE' WHEN k % 5 = 1 THEN 'BOUNDARY_OR_UNCERTAIN' ELSE 'LIKELY_ELIGIBLE' END AS status, CASE WHEN packet IS DISTINCT FROM 'PACKET' THEN NULL WHEN k % 13 = 0 THEN 'missing_output' WHEN k % 71 = 0 THEN 'unknown_status' "
    "WHEN k % 5 > 1 AND k % 19 = 0 THEN 'eligible_without_evidence' WHEN k % 17 = 0 AND k % 19 <> 0 THEN 'unresolved_quote' END AS screen_error FROM p), "
    "q AS (SELECT *, packet = 'PACKET' AND screen_error IS NULL AND status <> 'LIKELY_INELIGIBLE' AS due FROM s), "
    "v AS (SELECT *, CASE WHEN NOT coalesce(due, false) THEN NULL WHEN k % 11 = 0 THEN 'missing_output' WHEN k % 37 = 0 THEN 'other_cutoff' WHEN k % 79 = 0 THEN 'filed_after_cutoff' WHEN k % 43 = 0 AND k % 73 <> 0 THEN 'unresolved_quote' WHEN k % 73 = 0 AND (cent <> 'UNKNOWN' OR list_has_any(ty, list_filter(ty, lambda x: x <> 'OTHER'))) THEN 'claims_without_evidence' END AS class_error "
    "FROM q LEFT JOIN z USING (k)), "
    "u AS (SELECT *, coalesce(due, false) AND class_error IS NULL AS classified FROM v), "
    "d AS (SELECT *, CASE WHEN decision = 'exclude' THEN 'EXCLUDED' WHEN decision = 'unknown' OR packet <> 'PACKET' OR screen_error IS NOT NULL THEN 'UNCERTAIN' WHEN status = 'LIKELY_INELIGIBLE' THEN 'EXCLUDED' WHEN NOT classified THEN 'UNCERTAIN' ELSE tier END AS derived, "
    "CASE WHEN decision = 'exclude' THEN 'deterministic' WHEN decision = 'unknown' OR packet <> 'PACKET' OR screen_error IS NOT NULL THEN NULL WHEN status = 'LIKELY_INELIGIBLE' THEN 'screen_derived' WHEN classified AND tier = 'EXCLUDED' THEN 'economic_classification' END AS provenance FROM u), "
    f"l AS (SELECT k, {_DEC}[(k + a) % 4 + 1] AS dec, {_FINAL}[(k + a) % 2 + 1] AS said FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS a FROM customer WHERE c_custkey % 3 = 0)), "
    "o AS (SELECT d.*, CASE WHEN dec IS NULL OR dec = 'ONTOLOGY_CHANGE_REQUIRED' THEN derived WHEN dec = 'REMAIN_UNCERTAIN' THEN 'UNCERTAIN' ELSE said END AS final, CASE WHEN dec IS NULL THEN 'unreviewed' WHEN dec = 'ONTOLOGY_CHANGE_REQUIRED' THEN 'ontology_question' WHEN dec = 'REMAIN_UNCERTAIN' THEN 'ambiguous' WHEN said <> derived THEN 'overridden' ELSE 'approved' END AS review, "
    "CASE WHEN classified AND a AND NOT x_out AND NOT u THEN list_filter([CASE WHEN cent = 'CO_ESSENTIAL' THEN 'software_centrality_is_CO_ESSENTIAL' END, CASE WHEN len(list_distinct(ty)) > 1 THEN 'multiple_material_archetypes' END, CASE WHEN k % 4 = 0 THEN 'boundary_flag_present' END], lambda x: x IS NOT NULL) "
    "WHEN classified AND b AND NOT x_out AND NOT u THEN list_filter([CASE WHEN st = 'MIXED_SEPARABLE' THEN 'outcome_analysis_requires_segment_mapping' END, CASE WHEN k % 4 = 0 THEN 'boundary_flag_present' END], lambda x: x IS NOT NULL) WHEN classified AND c AND NOT x_out AND NOT u THEN CASE WHEN k % 4 = 0 THEN ['boundary_flag_present'] ELSE [] END "
    "WHEN classified AND NOT x_out AND NOT u THEN ['no_tier_rule_matched'] ELSE [] END AS asked FROM d LEFT JOIN l USING (k)), "
    "e AS (SELECT *, CASE WHEN len(asked) = 0 THEN '' ELSE array_to_string(list_sort(list_concat(asked, CASE WHEN (CASE WHEN k % 2 = 0 THEN 'TIER_A_CORE' ELSE 'TIER_B_EXTENSION' END) <> derived THEN ['advisory_tier_conflicts_with_rule_tier'] ELSE [] END)), ';') END AS triggers FROM o) "
)
# Tiers of all keys: TIER_SQL's frame z has k, the axes and the tier; a classified firm always has a filing date here.
_RUN = TIER_SQL("(SELECT c_custkey AS p_partkey FROM customer)", "true") + ", " + _RUN.removeprefix("WITH ").replace("NOT x_out", "prod IS DISTINCT FROM false")


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(tables(spark, sf))
        ORACLES[name] = _RUN + sql
        return f

    return add


joined = lambda c: F.array_join(c, ";")


@query("universe_issuer_decisions", "SELECT cik, decision, codes AS reasons, 1 AS n FROM f UNION ALL SELECT r.cik, 'exclude', 'DUPLICATE_ISSUER_RECORD', CAST(count(*) AS INT) FROM r JOIN f ON r.k = f.k AND r.acc <> f.acc WHERE r.filed IS NULL OR r.filed <= DATE '2022-12-31' GROUP BY r.cik")
def _(t):
    return t["issuer_decisions"].groupBy("cik", "decision", joined("reason_codes").alias("reasons")).agg(F.count("*").cast("int").alias("n"))


@query(
    "universe_packets",
    "SELECT cik, packet AS status, CASE WHEN packet = 'PACKET' THEN 2 ELSE 0 END AS passages, CASE WHEN packet = 'PACKET' THEN concat_ws(';', 'COVER_PAGE', CASE WHEN k % 4 <> 0 THEN 'CUSTOMERS' END, CASE WHEN k % 4 = 0 THEN 'PRODUCTS_SERVICES' END, 'SEGMENTS_MATERIALITY', 'TECHNOLOGY_DELIVERY') ELSE '' END AS missing, packet = 'PACKET' AND k % 4 = 0 AS insufficient, "
    "CASE packet WHEN 'TEMPORAL_LEAKAGE' THEN 'Passage p0 dated 2023-02-01 is after baseline cutoff 2022-12-31.; Passage p1 dated 2023-02-01 is after baseline cutoff 2022-12-31.' WHEN 'NO_PASSAGES' THEN 'No baseline passages supplied for this candidate.' WHEN 'INVALID_PASSAGE' THEN 'Passage p0 lacks a field or has an unknown section.; Passage p1 lacks a field or has an unknown section.' ELSE '' END AS detail FROM p WHERE packet IS NOT NULL",
)
def _(t):
    good = t["packets"].select("cik", F.col("packet_status").alias("status"), F.size("passages").alias("passages"), joined("missing_sections").alias("missing"), F.col("insufficient_evidence").alias("insufficient"), F.lit("").alias("detail"))
    return good.unionByName(t["packet_failures"].select("cik", F.col("reason_code").alias("status"), F.lit(0).alias("passages"), F.lit("").alias("missing"), F.lit(False).alias("insufficient"), "detail"))


@query("universe_screens", "SELECT cik, CASE WHEN screen_error IS NULL THEN status ELSE screen_error END AS outcome FROM s WHERE packet = 'PACKET'")
def _(t):
    return t["screens"].select("cik", F.col("screen_status").alias("outcome")).unionByName(t["screen_failures"].select("cik", F.col("screen_error").alias("outcome")))


@query("universe_classifications", "SELECT cik, coalesce(class_error, final) AS outcome, CASE WHEN class_error IS NULL THEN review END AS review FROM o WHERE due")
def _(t):
    bad = t["classification_failures"].select("cik", F.col("classification_error").alias("outcome"), F.lit(None).cast("string").alias("review"))
    return t["classifications"].select("cik", F.col("final_value").alias("outcome"), F.col("review_status").alias("review")).unionByName(bad)


@query("universe_tiers", "SELECT cik, derived, provenance, final, review, triggers, '0.2.0' AS rules_version FROM e")
def _(t):
    return t["spine"].select("cik", F.col("derived_tier").alias("derived"), "provenance", F.col("final_value").alias("final"), F.col("review_status").alias("review"), joined("triggers").alias("triggers"), "rules_version")


@query("universe_review_queue", "SELECT 'case-' || cik AS case_id, CASE WHEN review = 'unreviewed' THEN 'open' ELSE 'resolved' END AS state, 'Confirm or override the rule-derived tier ' || derived || ' for CIK' || cik || '; triggers: ' || replace(triggers, ';', ', ') || '.' AS question, CASE WHEN k % 73 = 0 THEN '' ELSE 'p0' END AS passages, "
       "'archetypes=[' || array_to_string(list_transform(ty, lambda x: '''' || x || ''''), ', ') || '] centrality=' || cent || ' structure=' || st || ' materiality=' || mat || ' advisory_tier=' || CASE WHEN k % 2 = 0 THEN 'TIER_A_CORE' ELSE 'TIER_B_EXTENSION' END AS summary FROM e WHERE triggers <> ''")  # fmt: skip
def _(t):
    return t["review_queue"].select("case_id", "state", "question", joined("passage_ids").alias("passages"), F.col("classifier_summary").alias("summary"))


@query(
    "universe_firm_years",
    "SELECT b.cik || '-' || year(coalesce(filed, DATE '2022-12-31')) AS firm_year_id, final AS universe_class, CASE WHEN k % 61 = 0 THEN 'shell' ELSE 'operating' END AS operating_status, CASE WHEN k % 3 <> 0 THEN 'listed' ELSE 'unknown' END AS public_status, CASE WHEN fresh THEN 'new_filer' ELSE 'baseline_incumbent' END AS entry_type, "
    "CASE WHEN k % 7 = 0 THEN 'acquired' ELSE 'none' END AS exit_type, CASE WHEN NOT fresh AND final <> 'UNCERTAIN' THEN final <> 'EXCLUDED' END AS eligible, fresh AS dynamic_entrant FROM (SELECT k, cik, filed, final, false AS fresh FROM o UNION ALL "
    f"SELECT k, cik, min(filed), NULL, true FROM r WHERE filed > DATE '{CUTOFF}' AND k NOT IN (SELECT k FROM o) GROUP BY k, cik) b",
)
def _(t):
    return t["firm_years"].select("firm_year_id", "universe_class", "operating_status", "public_status", "entry_type", "exit_type", F.col("eligible_this_year").alias("eligible"), "dynamic_entrant")


@query("universe_companies", "SELECT 'CIK' || r.cik AS company_id, min(coalesce(filed, DATE '2022-12-31'))::VARCHAR AS observation_start, any_value(CASE WHEN final IN ('TIER_A_CORE', 'TIER_B_EXTENSION', 'TIER_C_BOUNDARY') THEN 'included' WHEN final = 'EXCLUDED' THEN 'excluded' ELSE 'pending' END) AS status FROM r LEFT JOIN (SELECT k, final FROM o) USING (k) GROUP BY r.cik")
def _(t):
    return t["companies"].select("company_id", F.col("observation_start").cast("string").alias("observation_start"), F.col("inclusion_status").alias("status"))


@query("universe_gates", "SELECT 'open_review_case' AS gate, count(*) AS n FROM e WHERE triggers <> '' AND review = 'unreviewed' HAVING n > 0 UNION ALL SELECT 'invalid_identifier', count(*) FROM customer JOIN (VALUES (0), (1)) t(d) ON d = 0 OR c_custkey % 10 = 3 WHERE c_custkey % 50 = 7 OR c_custkey = 0 HAVING count(*) > 0 UNION ALL SELECT 'temporal_leakage', count(*) FROM customer WHERE (c_custkey % 79 = 0 OR c_custkey % 37 = 0) AND c_custkey % 11 <> 0 HAVING count(*) > 0")
def _(t):
    return t["gate_findings"].groupBy("gate").agg(F.count("*").alias("n"))


@query("universe_errors", "SELECT 'packet' AS stage, packet AS code, count(*) AS n FROM p WHERE packet <> 'PACKET' GROUP BY 2 UNION ALL SELECT 'screen', screen_error, count(*) FROM s WHERE screen_error IS NOT NULL GROUP BY 2 UNION ALL SELECT 'classification', class_error, count(*) FROM v WHERE class_error IS NOT NULL GROUP BY 2")
def _(t):
    return t["errors"].groupBy("stage", "code").agg(F.count("*").alias("n"))


_POOL = (
    "g AS (SELECT cik, provenance, substr((k % 9000 + 1000)::VARCHAR, 1, 2) || '|unknown|' || CASE WHEN provenance = 'deterministic' THEN 'none|' || string_split(codes, ';')[1] || '|high' ELSE 'OTHER|screen_likely_ineligible|low' END AS stratum, k FROM d WHERE provenance IN ('deterministic', 'screen_derived')), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || stratum || '|' || cik), cik) AS place FROM g) "
)


def _with_pool(sql: str) -> str:
    return _RUN.rstrip() + ", " + _POOL + sql


QUERIES["universe_audit"] = lambda spark, sf: (lambda t: t["audit_sample"].join(t["audit_pending"].select("cik", F.lit(True).alias("p")), "cik", "left").select("cik", "stratum", "excluded_by", F.coalesce("p", F.lit(False)).alias("pending")))(tables(spark, sf))
ORACLES["universe_audit"] = _with_pool("SELECT cik, stratum, provenance AS excluded_by, k % 2 <> 0 AS pending FROM h WHERE place = 1")

_COUNTS = {
    "filer_records": "(SELECT count(*) FROM r)", "unique_firms": "(SELECT count(DISTINCT k) FROM r)", "baseline_firms": "(SELECT count(*) FROM f)", "issuer_excluded": "(SELECT count(*) FROM f WHERE decision = 'exclude')",
    "packets_built": "(SELECT count(*) FROM p WHERE packet = 'PACKET')", "packet_failures": "(SELECT count(*) FROM p WHERE packet <> 'PACKET')", "screened": "(SELECT count(*) FROM s WHERE packet = 'PACKET' AND screen_error IS NULL)",
    "classified": "(SELECT count(*) FROM u WHERE classified)", **{n: f"(SELECT count(*) FROM o WHERE final = '{v}')" for n, v in (("tier_a", "TIER_A_CORE"), ("tier_b", "TIER_B_EXTENSION"), ("tier_c", "TIER_C_BOUNDARY"), ("excluded", "EXCLUDED"), ("uncertain", "UNCERTAIN"))},
    **{f"excluded_{v}": f"(SELECT count(*) FROM d WHERE provenance = '{v}')" for v in U.PROVENANCES}, "review_cases": "(SELECT count(*) FROM e WHERE triggers <> '')", "negative_audit_pool": "(SELECT count(*) FROM g)",
    "negative_audit_sampled": "(SELECT count(*) FROM h WHERE place = 1)", "negative_audit_pending": "(SELECT count(*) FROM h WHERE place = 1 AND k % 2 <> 0)",
}
QUERIES["universe_counts"] = lambda spark, sf: U.counts_row(tables(spark, sf)).select(*_COUNTS)
ORACLES["universe_counts"] = _with_pool("SELECT " + ", ".join(f"{v} AS {k}" for k, v in _COUNTS.items()))
