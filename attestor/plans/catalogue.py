"""Queries over the driver's tables, each beside its SQL. A query's name is its key in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF = "1998-01-01"


def query(sql: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf, f=f: f(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return add


def _day(c: str):
    return F.col(c).cast("date")


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate::DATE > DATE '{CUTOFF}' THEN 'post_baseline_entrant' ELSE 'baseline' END AS cohort FROM orders")
def cohort_split(t):
    return t("orders").select("o_orderkey", S.cohort(_day("o_orderdate"), F.lit(CUTOFF).cast("date")).alias("cohort"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t):
    cols = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return R.best_per_key(cols, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, k AS kept_o_orderkey FROM (SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE o_orderkey <> k")
def duplicate_decisions(t):
    out = R.superseded(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "kept_o_orderkey")


@query("SELECT c_custkey, c_name, o_orderkey AS first_order FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey")
def identity_earliest(t):
    first = R.best_per_key(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], latest=False)
    return t("customer").join(first, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", F.col("o_orderkey").alias("first_order"))


_CIK_SQL = "CASE WHEN regexp_full_match(trim(x), '[0-9]{1,10}') AND ltrim(trim(x), '0') <> '' THEN lpad(ltrim(trim(x), '0'), 10, '0') END"


@query(
    f"SELECT c_custkey, {_CIK_SQL} AS cik, 'CIK' || {_CIK_SQL} AS company_id, CASE WHEN length(d) = 18 THEN d[1:10] || '-' || d[11:12] || '-' || d[13:18] END AS accession "
    "FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' 00' || c_custkey || ' ' WHEN 1 THEN '0' WHEN 2 THEN 'x' || c_custkey ELSE '1234567890123' END AS x, "
    "regexp_replace('0001-' || (100000 + c_custkey) || '-9' || c_nationkey || '-000001', '[^0-9]', '', 'g') AS d FROM customer)"
)
def identifiers(t):
    k = F.col("c_custkey").cast("string")
    x = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" 00"), k, F.lit(" "))).when(F.col("c_custkey") % 4 == 1, "0").when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("x"), k)).otherwise("1234567890123")
    raw = F.concat(F.lit("0001-"), (F.col("c_custkey") + 100000).cast("string"), F.lit("-9"), F.col("c_nationkey").cast("string"), F.lit("-000001"))
    cik = S.normalize_cik(x)
    return t("customer").select("c_custkey", cik.alias("cik"), S.company_id(cik).alias("company_id"), S.normalize_accession(raw).alias("accession"))


_FLAG = "CASE WHEN c_custkey % {u} = 0 THEN NULL ELSE c_custkey % {m} = 1 END"
_FLAG_KEYS = {"investment_company": (7, 5), "asset_backed_issuer": (11, 13), "non_operating_trust": (13, 17), "shell_company": (17, 6), "blank_check_precombination": (19, 9)}


@query(
    "WITH f AS (SELECT c_custkey, " + ", ".join(f"{_FLAG.format(u=u, m=m)} AS {k}" for k, (u, m) in _FLAG_KEYS.items()) + " FROM customer), "
    "r AS (SELECT *, concat_ws(';', CASE WHEN investment_company THEN 'FUND_OR_INVESTMENT_COMPANY' END, CASE WHEN asset_backed_issuer THEN 'ASSET_BACKED_ISSUER' END, "
    "CASE WHEN non_operating_trust THEN 'TRUST_WITHOUT_OPERATING_BUSINESS' END, CASE WHEN shell_company OR blank_check_precombination THEN 'SHELL_OR_PRECOMBINATION_SPAC' END) AS reasons FROM f) "
    "SELECT c_custkey, CASE WHEN reasons <> '' THEN 'exclude' WHEN investment_company IS NULL OR asset_backed_issuer IS NULL OR non_operating_trust IS NULL OR shell_company IS NULL OR blank_check_precombination IS NULL THEN 'unknown' ELSE 'include' END AS decision, reasons FROM r"
)
def flag_reasons(t):
    k = F.col("c_custkey")
    flags = {n: F.when(k % u != 0, k % m == 1) for n, (u, m) in _FLAG_KEYS.items()}
    d = rules.flag_decision(flags)
    return t("customer").select("c_custkey", d["decision"].alias("decision"), F.array_join(d["reason_codes"], ";").alias("reasons"))


@query(
    f"SELECT o_orderkey, CASE WHEN n IS NULL THEN 'NO_PASSAGES' WHEN latest > DATE '{CUTOFF}' THEN 'TEMPORAL_LEAKAGE' ELSE 'PACKET' END AS status, coalesce(n, 0) AS passages "
    "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_shipdate::DATE) AS latest FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
)
def leak_packets(t):
    passages = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _day("l_shipdate").alias("d"))
    out = R.leak_status(t("orders").select("o_orderkey"), passages, "o_orderkey", "d", F.lit(CUTOFF).cast("date"))
    return out.select("o_orderkey", "status", F.coalesce("passages", F.lit(0)).alias("passages"))


_SECTIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    f"WITH l AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS had FROM orders GROUP BY o_custkey), p AS (SELECT o_custkey, list_sort(list_filter({_SECTIONS}, lambda s: NOT list_contains(had, s))) AS m FROM l) "
    "SELECT o_custkey, array_to_string(m, ';') AS missing, NOT (list_contains(m, '1-URGENT') OR list_contains(m, '2-HIGH')) AS sufficient FROM p"
)
def missing_sections(t):
    got = R.sections_present(t("orders"), "o_custkey", "o_orderpriority").withColumn("m", S.missing_sections(F.col("present"), _SECTIONS))
    return got.select("o_custkey", F.array_join("m", ";").alias("missing"), (~S.overlaps(F.col("m"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).alias("sufficient"))


# A quote's longest inner word is whole in any text that holds the quote, so it is an equi-key with `contains` as the residual.
@query("SELECT item_id, count(d.doc_id) AS documents, min(d.doc_id) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def quote_resolution(t):
    hit = R.containing(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("quote")), "text", "quote", "doc_id", "item_id")
    found = hit.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))
    return t("benchmark").select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_doc")


_CENT, _STRUCT, _MAT = ["CORE", "CO_ESSENTIAL", "ENABLING", "PERIPHERAL", "UNKNOWN"], ["PURE_PLAY", "SOFTWARE_DOMINANT", "MIXED_SEPARABLE", "MIXED_NONSEPARABLE", "SOFTWARE_PERIPHERAL"], ["DOMINANT", "MATERIAL", "MINOR", "UNKNOWN"]
_TYPES = [*rules.DEFAULTS["tier_b_extension"]["candidate_archetypes"], *rules.DEFAULTS["tier_c_boundary"]["default_archetypes"], "OTHER"]


def classified(part: DataFrame) -> DataFrame:
    """Parts as classified firms: axes by remainders of the key, with unknowns."""
    k = F.col("p_partkey")
    pick = lambda xs, e: F.get(F.array(*map(F.lit, xs)), e.cast("int"))
    none = F.array().cast("array<string>")
    return part.select(
        "p_partkey",
        F.when(k % 23 != 0, k % 19 != 0).alias("customer_facing_functional_product"),
        F.when(k % 29 != 0, k % 7 != 0).alias("operating_company"),
        pick(_CENT, k % 5).alias("software_centrality"), pick(_STRUCT, F.floor(k / 5) % 5).alias("firm_structure"), pick(_MAT, F.floor(k / 25) % 4).alias("commercial_materiality"),
        F.when(k % 3 == 0, F.array(pick(_TYPES, k % 13), pick(_TYPES, (k + 4) % 13))).otherwise(F.array(pick(_TYPES, k % 13))).alias("customer_value_archetypes"),
        F.when(k % 31 == 0, F.array(F.lit("x"))).otherwise(none).alias("contradictions"),
        F.when(k % 4 == 0, F.array(F.lit("edge"))).otherwise(none).alias("boundary_flags"),
        F.when(k % 37 != 0, F.lit("2022-09-15").cast("date")).alias("baseline_filing_date"),
    )


def TIER_SQL(source: str, dated: str) -> str:  # noqa: N802
    """CTEs x, y and z: the axes of classified() over source (column p_partkey), the tiers' tests, and the tier of each key."""
    return (
        f"WITH x AS (SELECT p_partkey AS k, CASE WHEN k % 23 <> 0 THEN k % 19 <> 0 END AS prod, CASE WHEN k % 29 <> 0 THEN k % 7 <> 0 END AS op, {_CENT}[k % 5 + 1] AS cent, {_STRUCT}[k // 5 % 5 + 1] AS st, {_MAT}[k // 25 % 4 + 1] AS mat, "
        f"CASE WHEN k % 3 = 0 THEN [{_TYPES}[k % 13 + 1], {_TYPES}[(k + 4) % 13 + 1]] ELSE [{_TYPES}[k % 13 + 1]] END AS ty FROM {source}), "
        "y AS (SELECT *, "
        f"coalesce(op, false) AND {dated} AND list_has_any(ty, {rules.DEFAULTS['tier_a_core']['allowed_archetypes']}) AND cent IN ('CORE', 'CO_ESSENTIAL') AND st IN ('PURE_PLAY', 'SOFTWARE_DOMINANT') AND mat IN ('DOMINANT', 'MATERIAL') AS a, "
        f"list_has_any(ty, {rules.DEFAULTS['tier_b_extension']['candidate_archetypes']}) AND st IN ('MIXED_SEPARABLE', 'SOFTWARE_DOMINANT', 'PURE_PLAY') AND cent <> 'PERIPHERAL' AS b, "
        f"list_has_any(ty, {rules.DEFAULTS['tier_c_boundary']['default_archetypes']}) OR cent IN ('ENABLING', 'PERIPHERAL') OR st IN ('SOFTWARE_PERIPHERAL', 'MIXED_NONSEPARABLE') AS c, "
        "prod IS NULL OR op IS NULL OR k % 31 = 0 OR mat = 'UNKNOWN' OR cent = 'UNKNOWN' AS u FROM x), "
        "z AS (SELECT *, CASE WHEN prod IS NOT DISTINCT FROM false THEN 'EXCLUDED' WHEN u THEN 'UNCERTAIN' WHEN a THEN 'TIER_A_CORE' WHEN b THEN 'TIER_B_EXTENSION' WHEN c THEN 'TIER_C_BOUNDARY' ELSE 'UNCERTAIN' END AS tier FROM y) "
    )


_TIER_SQL = TIER_SQL("part", "k % 37 <> 0")


@query(
    _TIER_SQL + "SELECT k AS p_partkey, tier, CASE WHEN tier = 'EXCLUDED' OR u THEN '' WHEN a THEN concat_ws(';', CASE WHEN cent = 'CO_ESSENTIAL' THEN 'software_centrality_is_CO_ESSENTIAL' END, CASE WHEN k % 3 = 0 THEN 'multiple_material_archetypes' END, CASE WHEN k % 4 = 0 THEN 'boundary_flag_present' END) "
    "WHEN b THEN concat_ws(';', CASE WHEN st = 'MIXED_SEPARABLE' THEN 'outcome_analysis_requires_segment_mapping' END, CASE WHEN k % 4 = 0 THEN 'boundary_flag_present' END) WHEN c THEN CASE WHEN k % 4 = 0 THEN 'boundary_flag_present' ELSE '' END ELSE 'no_tier_rule_matched' END AS review FROM z"
)
def tier_cascade(t):
    out = rules.derive_tier(classified(t("part")))
    return out.select("p_partkey", F.col("tier.derived_tier").alias("tier"), F.array_join("tier.review_reasons", ";").alias("review"))


@query(
    _TIER_SQL + "SELECT tier, count(*) AS firms, CAST(sum(CASE WHEN tier = 'EXCLUDED' THEN 2 WHEN u THEN (prod IS NULL OR cent = 'UNKNOWN')::INT + (op IS NULL)::INT + (k % 31 = 0)::INT + (mat = 'UNKNOWN')::INT WHEN a THEN 11 WHEN b THEN 8 WHEN c THEN 13 ELSE 14 END) AS BIGINT) AS trace_entries FROM z GROUP BY tier"
)
def tier_trace_counts(t):
    out = rules.derive_tier(classified(t("part"))).select(F.col("tier.derived_tier").alias("tier"), F.size("tier.trace").cast("long").alias("n"))
    return out.groupBy("tier").agg(F.count("*").alias("firms"), F.sum("n").alias("trace_entries"))


# Each rule's results over all firms, with the details that passed or failed it.
_A = [("operating_company_required", "coalesce(op, false)", "'operating_company=' || CASE WHEN op THEN 'True' WHEN NOT op THEN 'False' ELSE 'None' END"), ("baseline_annual_filing_required", "k % 37 <> 0", "'baseline_filing_date=' || CASE WHEN k % 37 <> 0 THEN '2022-09-15' ELSE 'None' END"),
      ("customer_facing_functional_product_required", "true", "'customer_facing_functional_product=True'"), ("allowed_archetypes", f"list_has_any(ty, {rules.DEFAULTS['tier_a_core']['allowed_archetypes']})", "arch"),
      ("allowed_software_centrality", "cent IN ('CORE', 'CO_ESSENTIAL')", "'software_centrality=' || cent"), ("allowed_firm_structure", "st IN ('PURE_PLAY', 'SOFTWARE_DOMINANT')", "'firm_structure=' || st"), ("allowed_materiality", "mat IN ('DOMINANT', 'MATERIAL')", "'commercial_materiality=' || mat")]
_REVIEW = [("software_centrality_is_CO_ESSENTIAL", "cent = 'CO_ESSENTIAL'"), ("multiple_material_archetypes", "len(list_distinct(ty)) > 1"), ("contradictory_materiality_evidence", "k % 31 = 0"), ("boundary_flag_present", "k % 4 = 0")]
_ALSO = [("default_archetypes", f"list_has_any(ty, {rules.DEFAULTS['tier_c_boundary']['default_archetypes']})"), ("also_include_if.software_centrality_is_ENABLING", "cent = 'ENABLING'"), ("also_include_if.software_centrality_is_PERIPHERAL", "cent = 'PERIPHERAL'"),
         ("also_include_if.firm_structure_is_SOFTWARE_PERIPHERAL", "st = 'SOFTWARE_PERIPHERAL'"), ("also_include_if.mixed_nonseparable_without_clean_outcome_mapping", "st = 'MIXED_NONSEPARABLE'")]
_said = lambda rule, test, miss, detail="": f"'{rule}:' || CASE WHEN {test} THEN 'pass' ELSE '{miss}' END || ':' || {detail or repr('')}"


@query(
    _TIER_SQL + ", w AS (SELECT *, 'archetypes=[' || array_to_string(list_transform(list_sort(list_distinct(ty)), lambda t: chr(39) || t || chr(39)), ', ') || ']' AS arch, array_to_string(list_filter([CASE WHEN prod IS NULL OR cent = 'UNKNOWN' THEN 1 END, CASE WHEN op IS NULL THEN 2 END], lambda i: i IS NOT NULL), '') AS none_ FROM z), "
    "t AS (SELECT *, [" + ", ".join(_said(f"tier_a_core.{n}", test, "fail", d) for n, test, d in _A) + "] AS ta, [" + ", ".join(_said(f"tier_a_core.manual_review_if.{n}", test, "not_applicable") for n, test in _REVIEW) + "] AS tr, "
    "['tier_b_extension.candidate_match:' || CASE WHEN b THEN 'pass' ELSE 'fail' END || ':' || arch || ' structure=' || st || ' centrality=' || cent] AS tb, [" + ", ".join(_said(f"tier_c_boundary.{n}", test, "not_applicable") for n, test in _ALSO) + "] AS tc, "
    "list_filter([CASE WHEN prod IS NULL THEN 'uncertain.insufficient_baseline_evidence:pass:' END, CASE WHEN op IS NULL THEN 'uncertain.unresolved_operating_status:pass:' END, CASE WHEN k % 31 = 0 THEN 'uncertain.contradictory_axis_classification:pass:' END, CASE WHEN mat = 'UNKNOWN' THEN 'uncertain.unresolved_materiality:pass:' END, CASE WHEN cent = 'UNKNOWN' AND prod IS NOT NULL THEN 'uncertain.insufficient_baseline_evidence:pass:' END], lambda i: i IS NOT NULL) AS tu FROM w) "
    "SELECT k AS p_partkey, array_to_string(CASE WHEN tier = 'EXCLUDED' THEN ['excluded.no_customer_facing_digital_product:pass:Classification found no customer-facing digital product.', 'excluded.deterministic_reason_codes:pass:reason_codes=[''NO_CUSTOMER_FACING_DIGITAL_PRODUCT'']'] WHEN u THEN tu WHEN a THEN list_concat(ta, tr) WHEN b THEN list_concat(ta, tb) WHEN c THEN list_concat(list_concat(ta, tb), tc) "
    "ELSE list_concat(list_concat(list_concat(ta, tb), tc), ['uncertain.contradictory_axis_classification:pass:No tier rule matched the stored axes; routing to review.']) END, chr(10)) AS trace FROM t"
)
def tier_trace(t):
    out = rules.derive_tier(classified(t("part")))
    said = F.transform("tier.trace", lambda e: F.concat(e["rule_id"], F.lit(":"), e["result"], F.lit(":"), F.coalesce(e["detail"], F.lit(""))))
    return out.select("p_partkey", F.array_join(said, "\n").alias("trace"))


_DEC = ["CONFIRM_RULE_TIER", "OVERRIDE_RULE_TIER", "REMAIN_UNCERTAIN", "ONTOLOGY_CHANGE_REQUIRED"]


@query(
    f"WITH l AS (SELECT user_id, {_DEC}[event_id % 4 + 1] AS d, event_type AS f FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), c AS (SELECT DISTINCT user_id, 'click' AS derived FROM events) "
    "SELECT user_id, CASE WHEN d IS NULL OR d = 'ONTOLOGY_CHANGE_REQUIRED' THEN derived WHEN d = 'REMAIN_UNCERTAIN' THEN 'UNCERTAIN' ELSE f END AS final_value, CASE WHEN d IS NULL THEN 'unreviewed' WHEN d = 'ONTOLOGY_CHANGE_REQUIRED' THEN 'ontology_question' WHEN d = 'REMAIN_UNCERTAIN' THEN 'ambiguous' WHEN f <> derived THEN 'overridden' ELSE 'approved' END AS review_status FROM c LEFT JOIN l USING (user_id)"
)
def review_overlay(t):
    e = t("events")
    log = e.where("event_type = 'purchase'").select("user_id", "event_id", "event_type", F.get(F.array(*map(F.lit, _DEC)), (F.col("event_id") % 4).cast("int")).alias("decision"))
    cases = e.select("user_id").distinct().withColumn("derived", F.lit("click"))
    return R.latest_overlay(cases, log, "user_id", "event_id", "derived", "event_type", "decision").select("user_id", "final_value", "review_status")


@query(
    "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_mktsegment || '|' || c_custkey), c_custkey) AS p FROM customer) WHERE p <= 5"
)
def stratified_sample(t):
    return R.stratified_sample(t("customer"), ["c_mktsegment"], "c_custkey", 5, 42).select("c_mktsegment", "c_custkey")


@query(
    "SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_mktsegment || '|' || c_custkey), c_custkey) AS p FROM customer) WHERE p <= 5 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
)
def audit_pending(t):
    sample = R.stratified_sample(t("customer"), ["c_mktsegment"], "c_custkey", 5, 42)
    done = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sample.join(done, "c_custkey", "left_anti").select("c_custkey")


@query(
    "SELECT gate, severity, count(*) AS n FROM (SELECT 'ships_before_order' AS gate, 'critical' AS severity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'unknown_part', 'critical' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) "
    "UNION ALL SELECT 'repeated_line', 'error' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'zero_discount', 'info' FROM lineitem WHERE l_discount = 0) GROUP BY 1, 2"
)
def hard_gates(t):
    line, orders = t("lineitem"), t("orders")
    early = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")
    found = [
        R.findings("ships_before_order", early, "l_orderkey"),
        R.findings("unknown_part", R.unresolved(line, t("part"), "l_partkey", "p_partkey"), "l_orderkey"),
        R.findings("repeated_line", R.repeated(line, ["l_orderkey", "l_linenumber"]), "l_orderkey", "error"),
        R.findings("zero_discount", line.where("l_discount = 0"), "l_orderkey", "info"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("gate", "severity").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other, true AS reconciled FROM orders")
def funnel_counts(t):
    s = F.col("o_orderstatus")
    out = t("orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open"), F.count_if(~s.isin("F", "O")).alias("other"))
    return out.withColumn("reconciled", F.col("orders") == F.col("finished") + F.col("open") + F.col("other"))


@query("SELECT event_id, b.level AS baseline FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS level FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON e.user_id = b.user_id AND e.ts >= b.ts")
def as_of_baseline(t):
    e = t("events")
    registry = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("baseline"))
    return R.as_of(e.select("event_id", "user_id", "ts"), registry, ["user_id"], "ts", "since", "baseline").select("event_id", "baseline")


@query(
    "WITH s AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z, event_id AS span FROM events WHERE event_type = 'login' OR event_type = 'signup') SELECT e.event_id, s.span FROM events e JOIN s ON e.user_id = s.user_id AND e.ts >= s.a AND (s.z IS NULL OR e.ts < s.z)"
)
def validity_interval(t):
    e = t("events")
    marks = e.where("event_type in ('login', 'signup')")
    spans = marks.select("user_id", F.col("ts").alias("a"), F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("z"), F.col("event_id").alias("span"))
    return R.in_validity(e.select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", "a", "z").select("event_id", "span")


@query(
    "WITH o AS (SELECT l_orderkey, p_brand, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), b AS (SELECT p_brand, avg(q) AS balanced FROM o GROUP BY 1), w AS (SELECT p_brand, sum(l_quantity * l_extendedprice) / sum(l_extendedprice) AS weighted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, round(balanced, 6) AS balanced, round(weighted, 6) AS weighted FROM b JOIN w USING (p_brand)"
)
def balanced_aggregates(t):
    line = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    one = line.groupBy("l_orderkey", "p_brand").agg(F.avg("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("x"), F.sum("l_extendedprice").alias("w"))
    return one.groupBy("p_brand").agg(F.round(F.avg("q"), 6).alias("balanced"), F.round(F.sum("x") / F.sum("w"), 6).alias("weighted"))


@query("SELECT p_brand, l_returnflag, grouping_id(p_brand, l_returnflag) AS grain, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY GROUPING SETS ((p_brand, l_returnflag), (p_brand), (l_returnflag), ())")
def multi_grain(t):
    line = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    out = line.cube("p_brand", "l_returnflag").agg(F.grouping_id().alias("grain"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.select("p_brand", "l_returnflag", "grain", "n", "quantity")


@query("SELECT d.lang, count(*) AS eligible, count(l.quality) AS measured, round(count(l.quality) / count(*), 6) AS coverage, round(avg(l.quality), 6) AS mean_quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def coverage_block(t):
    both = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("eligible"), F.count("quality").alias("measured"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"), F.round(F.avg("quality"), 6).alias("mean_quality"))


_PANEL = "WITH p AS (SELECT o_custkey AS unit, year(o_orderdate)::INT AS period, count(*) AS v FROM orders GROUP BY 1, 2), j AS (SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.period, b.period + 1) AS period, a.v AS now, b.v AS before FROM p a FULL JOIN p b ON a.unit = b.unit AND a.period = b.period + 1) "


@query(_PANEL + "SELECT period, CASE WHEN before IS NULL THEN 'entry' WHEN now IS NULL THEN 'exit' ELSE 'continuing' END AS kind, count(*) AS units, CAST(sum(coalesce(now, 0) - coalesce(before, 0)) AS BIGINT) AS change FROM j GROUP BY 1, 2")
def entry_exit(t):
    p = t("orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("period")).agg(F.count("*").alias("v"))
    out = R.entry_exit(p, "unit", "period", "v")
    return out.groupBy("period", "kind").agg(F.count("*").alias("units"), F.sum(F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("change"))


@query("SELECT before, o_orderstatus AS now, count(*) AS n FROM (SELECT o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL GROUP BY 1, 2")
def transition_matrix(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    out = t("orders").select(F.col("o_orderstatus").alias("now"), F.lag("o_orderstatus").over(w).alias("before")).where("before is not null")
    return out.groupBy("before", "now").agg(F.count("*").alias("n"))


@query("SELECT user_id, min(ts::DATE) FILTER (value >= 50) AS first_50, min(ts::DATE) FILTER (value >= 90) AS first_90, date_diff('day', min(ts::DATE) FILTER (value >= 50), min(ts::DATE) FILTER (value >= 90)) AS lag_days FROM events GROUP BY 1")
def first_crossing(t):
    at = lambda k: F.min(F.when(F.col("value") >= k, _day("ts")))
    out = t("events").groupBy("user_id").agg(at(50).alias("first_50"), at(90).alias("first_90"))
    return out.withColumn("lag_days", F.datediff("first_90", "first_50").cast("long"))


@query("SELECT sha256(text) AS cluster, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t):
    h = F.sha2("text", 256).alias("cluster")
    return t("documents").groupBy(h).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY CAST(substr(source, 4) AS INT), doc_id) = 1 AS canonical FROM documents")
def canonical_source(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), F.substring("source", 4, 10).cast("int").alias("tier"))
    best = R.best_per_key(d, ["h"], ["tier", "doc_id"], latest=False).select("doc_id", F.lit(True).alias("is_best"))
    return d.join(best, "doc_id", "left").select("doc_id", F.coalesce("is_best", F.lit(False)).alias("canonical"))


@query(
    "SELECT doc_id, place, sha256(s) AS passage_hash, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)"
)
def segment_passages(t):
    lines = t("documents").select("doc_id", F.split("text", "\n").alias("lines"))
    placed = lines.select("doc_id", "lines", R.line_starts(F.col("lines")).alias("starts"))
    parts = placed.select("doc_id", F.posexplode(F.arrays_zip("lines", "starts")).alias("place", "p"))
    return parts.select("doc_id", F.col("place").cast("long").alias("place"), F.sha2("p.lines", 256).alias("passage_hash"), F.col("p.starts").alias("start"))


@query(
    r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text_hash, regexp_replace(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')), '^(https?://)www\.', '\1') AS canonical FROM pages"
)
def page_text(t):
    return t("pages").select("page_id", F.sha2(S.html_text(F.col("html")), 256).alias("text_hash"), S.canonical_url(F.col("url")).alias("canonical"))


_PRED = "(d.n_chars > 800)::INT"


@query(
    f"SELECT lang, count(*) AS n, CAST(sum((p = 1 AND g = 1)::INT) AS BIGINT) AS tp, CAST(sum((p = 1 AND g = 0)::INT) AS BIGINT) AS fp, CAST(sum((p = 0 AND g = 1)::INT) AS BIGINT) AS fn, round(sum((p = 1 AND g = 1)::INT) / nullif(sum(p), 0), 6) AS precision, round(sum((p = 1 AND g = 1)::INT) / nullif(sum(g), 0), 6) AS recall FROM (SELECT lang, quality AS g, {_PRED} AS p FROM documents d JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((lang), ())"
)
def precision_recall(t):
    d = t("documents").select("doc_id", "lang", (F.col("n_chars") > 800).cast("int").alias("p")).join(t("labels").select("doc_id", F.col("quality").alias("g")), "doc_id")
    tp = F.count_if((F.col("p") == 1) & (F.col("g") == 1))
    return d.rollup("lang").agg(
        F.count("*").alias("n"), tp.alias("tp"), F.count_if((F.col("p") == 1) & (F.col("g") == 0)).alias("fp"), F.count_if((F.col("p") == 0) & (F.col("g") == 1)).alias("fn"),
        F.round(F.try_divide(tp, F.sum("p")), 6).alias("precision"), F.round(F.try_divide(tp, F.sum("g")), 6).alias("recall"),
    )


@query(
    f"WITH x AS (SELECT quality AS g, {_PRED} AS p FROM documents d JOIN labels USING (doc_id)), m AS (SELECT count(*)::DOUBLE AS n, avg((g = p)::INT) AS o, avg(g) * avg(p) + (1 - avg(g)) * (1 - avg(p)) AS e FROM x) SELECT CAST(n AS BIGINT) AS n, round(o, 6) AS agreement, round((o - e) / nullif(1 - e, 0), 6) AS kappa FROM m"
)
def kappa(t):
    d = t("documents").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("p")).join(t("labels").select("doc_id", F.col("quality").alias("g")), "doc_id")
    m = d.agg(F.count("*").alias("n"), F.avg((F.col("g") == F.col("p")).cast("int")).alias("o"), F.avg("g").alias("a"), F.avg("p").alias("b"))
    e = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return m.select("n", F.round("o", 6).alias("agreement"), F.round(F.try_divide(F.col("o") - e, 1 - e), 6).alias("kappa"))


@query(
    "WITH s AS (SELECT source, count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, CAST(n AS BIGINT) AS n, round(bad / n, 6) AS rate, round((bad / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(bad / n * (1 - bad / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS upper FROM s"
)
def unsafe_rate(t):
    s = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum(1 - F.col("quality")).cast("double").alias("bad"))
    return s.select("source", "n", F.round(F.col("bad") / F.col("n"), 6).alias("rate"), F.round(R.wilson_upper(F.col("bad"), F.col("n").cast("double")), 6).alias("upper"))


@query(
    "SELECT CASE WHEN b IS NULL OR c IS NULL THEN 'noncomparable' WHEN b AND c THEN 'still_satisfied' WHEN b THEN 'newly_unsatisfied' WHEN c THEN 'newly_satisfied' ELSE 'still_unsatisfied' END AS transition, count(*) AS n FROM (SELECT x.b, y.c FROM (SELECT doc_id, CASE WHEN lang <> 'fr' THEN n_chars > 800 END AS b FROM documents) x FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS c FROM labels) y USING (doc_id)) GROUP BY 1"
)
def run_ledger(t):
    # Assertions that one run lacks, or leaves open, aren't comparable.
    old = t("documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("n_chars") > 800).alias("b"))
    new = t("labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("c"))
    b, c = F.col("b"), F.col("c")
    move = F.when(b.isNull() | c.isNull(), "noncomparable").when(b & c, "still_satisfied").when(b, "newly_unsatisfied").when(c, "newly_satisfied").otherwise("still_unsatisfied")
    return old.join(new, "doc_id", "full_outer").groupBy(move.alias("transition")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS with_k, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def json_props(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("k_sum"))


@query("SELECT role, before, count(*) AS n, count(*) FILTER (gap <> 1) AS gaps FROM (SELECT role, lag(role) OVER w AS before, turn - lag(turn) OVER w AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY 1, 2")
def turn_sequence(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    d = t("conversations").select("role", F.lag("role").over(w).alias("before"), (F.col("turn") - F.lag("turn").over(w)).alias("gap"))
    return d.groupBy("role", "before").agg(F.count("*").alias("n"), F.count_if(F.col("gap") != 1).alias("gaps"))


@query(
    "WITH p AS (SELECT o_custkey AS u, year(o_orderdate) AS t, sum(o_totalprice) AS y, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2), d AS (SELECT y - avg(y) OVER (PARTITION BY u) AS y, x - avg(x) OVER (PARTITION BY u) AS x FROM p) SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 4) AS slope FROM d"
)
def within_slope(t):
    p = t("orders").groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))
    w = W.partitionBy("u")
    d = p.select((F.col("y") - F.avg("y").over(w)).alias("y"), (F.col("x") - F.avg("x").over(w)).alias("x"))
    return d.agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 4).alias("slope"))


@query("WITH f AS (SELECT user_id, min(ts::DATE) AS d0 FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT CAST(date_diff('day', d0, ts::DATE) AS BIGINT) AS rel_day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events JOIN f USING (user_id) WHERE abs(date_diff('day', d0, ts::DATE)) <= 5 GROUP BY 1")
def event_study(t):
    e = t("events")
    first = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min(_day("ts")).alias("d0"))
    rel = e.join(first, "user_id").withColumn("rel_day", F.datediff(_day("ts"), "d0").cast("long")).where("abs(rel_day) <= 5")
    return rel.groupBy("rel_day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT y.o_custkey, y.period, g.status, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS period FROM orders) y CROSS JOIN (VALUES ('F'), ('O'), ('P')) g(status) LEFT JOIN (SELECT o_custkey, year(o_orderdate)::INT AS period, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2, 3) c ON c.o_custkey = y.o_custkey AND c.period = y.period AND c.status = g.status")
def coverage_grid(t):
    o = t("orders").select("o_custkey", F.year("o_orderdate").alias("period"), "o_orderstatus")
    n = o.groupBy("o_custkey", "period").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"))
    return n.select("o_custkey", "period", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in "FOP"))).alias("g")).select("o_custkey", "period", "g.*")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def set_operations(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    both = o.where("y = 1996").select("c_custkey").intersect(o.where("y = 1997").select("c_custkey"))
    return t("customer").select("c_custkey").distinct().join(both, "c_custkey", "left_anti")
