"""More queries over the driver's tables: label metrics, links across periods, validators and dispositions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import longitudinal as L
from ..operators import metrics as M
from ..operators import similarity
from ..operators import validation as V
from .catalogue import query

_SCALE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# An order's priority is predicted by the priority of the customer's order before; a first order has no prediction.
_GUESS = "WITH f AS (SELECT o_orderpriority AS g, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, year(o_orderdate) AS y, o_orderstatus AS s FROM orders)"


def _guess(t, *more):
    before = F.lag("o_orderpriority").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t("orders").select(F.col("o_orderpriority").alias("g"), before.alias("p"), *more)


_LABELS = _GUESS + ", c AS (SELECT l AS label, count(*) FILTER (g = l AND p = l) AS tp, count(*) FILTER (p = l AND g <> l) AS fp, count(*) FILTER (g = l AND p IS DISTINCT FROM l) AS fn FROM f, (SELECT DISTINCT o_orderpriority AS l FROM orders) GROUP BY 1)"


@query(_LABELS + " SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def label_metrics(t):
    c = M.label_counts(M.confusion(_guess(t), "g", "p"))
    return c.select("label", "tp", "fp", "fn", F.round(M.precision(), 6).alias("precision"), F.round(M.recall(), 6).alias("recall"), F.round(M.f1(), 6).alias("f1"))


@query(_LABELS + " SELECT round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(tp / nullif(tp + fn, 0)), 6) AS balanced_accuracy FROM c")
def nominal_summary(t):
    c = M.label_counts(M.confusion(_guess(t), "g", "p"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return c.agg(F.round(F.avg(M.f1()), 6).alias("macro_f1"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("micro_f1"), F.round(F.avg(M.recall()), 6).alias("balanced_accuracy"))


@query(_GUESS + " SELECT g AS gold, " + ", ".join(f"count(*) FILTER (p = '{s}') AS p{s[0]}" for s in _SCALE) + ", count(*) FILTER (p IS NULL) AS abstained FROM f GROUP BY 1")
def confusion_matrix(t):
    c = M.confusion(_guess(t), "g", "p")
    cell = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return c.groupBy("gold").agg(*(cell(F.col("pred") == s).alias(f"p{s[0]}") for s in _SCALE), cell(F.col("pred").isNull()).alias("abstained"))


@query(_GUESS + ", r AS (SELECT g[1]::INT AS g, p[1]::INT AS p FROM f WHERE p IS NOT NULL), a AS (SELECT g, count(*) AS n FROM r GROUP BY 1), b AS (SELECT p, count(*) AS n FROM r GROUP BY 1) SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(abs(g - p)) FROM r), 6) AS mean_distance, round(1 - (SELECT sum(abs(g - p)) * count(*) FROM r) / (SELECT sum(abs(g - p) * a.n * b.n) FROM a, b), 6) AS weighted_kappa")
def ordinal_agreement(t):
    out = M.weighted_kappa(M.confusion(_guess(t), "g", "p"), {s: k for k, s in enumerate(_SCALE)})
    return out.select("n", F.round("mean_distance", 6).alias("mean_distance"), F.round("weighted_kappa", 6).alias("weighted_kappa"))


@query(_GUESS + " SELECT count(*) AS n, count(p) AS answered, round(count(p) / count(*), 6) AS coverage, round(count(*) FILTER (p <> g) / count(p), 6) AS selective_risk, round(count(*) FILTER (p <> g) / count(*), 6) AS false_confidence FROM f")
def abstention(t):
    out = M.abstention(M.confusion(_guess(t), "g", "p"))
    return out.select("n", "answered", *(F.round(c, 6).alias(c) for c in ("coverage", "selective_risk", "false_confidence")))


@query(_GUESS + " SELECT y AS year, s AS status, grouping_id(y, s) AS grain, count(*) AS n, round(avg((p = g)::INT), 6) AS accuracy FROM f GROUP BY GROUPING SETS ((y, s), (y), (s), ())")
def accuracy_slices(t):
    d = _guess(t, F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    out = d.cube("year", "status").agg(F.grouping_id().alias("grain"), F.count("*").alias("n"), F.round(F.avg((F.col("p") == F.col("g")).cast("int")), 6).alias("accuracy"))
    return out.select(F.col("year").cast("long").alias("year"), "status", "grain", "n", "accuracy")


# Priorities that a customer's finished orders have, predicted by those of the open ones.
@query("WITH s AS (SELECT o_custkey AS k, o_orderpriority AS l, bool_or(o_orderstatus = 'F') AS g, bool_or(o_orderstatus = 'O') AS p FROM orders GROUP BY 1, 2), u AS (SELECT k, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM s GROUP BY 1) SELECT count(*) AS units, count(*) FILTER (fp = 0 AND fn = 0) AS exact, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS recall FROM u")
def multi_label_sets(t):
    had = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    s = t("orders").groupBy("o_custkey", "o_orderpriority").agg(had("F").alias("g"), had("O").alias("p"))
    u = s.groupBy("o_custkey").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return u.agg(F.count("*").alias("units"), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"))


# A nation is found if any accepted alias of it (its name, or the name's first three letters) is predicted in its region.
@query(
    "WITH n AS (SELECT n_nationkey, n_regionkey, n_name FROM nation), p AS (SELECT DISTINCT n_regionkey, CASE WHEN s_suppkey % 7 = 0 THEN 'none' WHEN s_suppkey % 2 = 0 THEN substr(n_name, 1, 3) ELSE lower(n_name) END AS said FROM supplier JOIN n ON s_nationkey = n_nationkey), "
    "m AS (SELECT n.n_nationkey, p.n_regionkey AS r, p.said FROM n JOIN p ON n.n_regionkey = p.n_regionkey AND lower(p.said) IN (lower(n_name), lower(substr(n_name, 1, 3)))) "
    "SELECT n_regionkey, count(*) AS gold, count(*) FILTER (n_nationkey IN (SELECT n_nationkey FROM m)) AS found, (SELECT count(*) FROM p WHERE p.n_regionkey = n.n_regionkey) AS predicted, (SELECT count(*) FROM p WHERE p.n_regionkey = n.n_regionkey AND EXISTS (SELECT 1 FROM m WHERE m.r = p.n_regionkey AND m.said = p.said)) AS matched FROM n GROUP BY 1"
)
def alias_matching(t):
    n = t("nation")
    name = F.lower("n_name")
    aliases = n.select("n_regionkey", "n_nationkey", F.explode(F.array_distinct(F.array(name, F.substring(name, 1, 3)))).alias("alias"))
    k = F.col("s_suppkey")
    said = F.when(k % 7 == 0, "none").when(k % 2 == 0, F.substring("n_name", 1, 3)).otherwise(name)
    p = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", said.alias("said")).distinct()
    hit = p.join(aliases, (p.n_regionkey == aliases.n_regionkey) & (F.lower("said") == F.col("alias")), "left").select(p.n_regionkey, "said", "n_nationkey")
    of_pred = hit.groupBy("n_regionkey").agg(F.count_distinct("said").alias("predicted"), F.count_distinct(F.when(F.col("n_nationkey").isNotNull(), F.col("said"))).alias("matched"), F.count_distinct("n_nationkey").alias("found"))
    gold = n.groupBy("n_regionkey").agg(F.count("*").alias("gold"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return gold.join(of_pred, "n_regionkey", "left").select("n_regionkey", "gold", zero("found"), zero("predicted"), zero("matched"))


@query("SELECT CASE WHEN o_orderkey IS NULL THEN 'order' WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' WHEN r_regionkey IS NULL THEN 'region' ELSE 'resolved' END AS first_missing, count(*) AS n FROM lineitem LEFT JOIN (FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey LEFT JOIN (FROM customer WHERE c_acctbal >= -500) ON o_custkey = c_custkey LEFT JOIN (FROM nation WHERE n_name <> 'CANADA') ON c_nationkey = n_nationkey LEFT JOIN (FROM region WHERE r_name <> 'AMERICA') ON n_regionkey = r_regionkey GROUP BY 1")
def provenance_chain(t):
    # Parents of some states only, so that each link of the chain can fail; lines are counted by order before they join.
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t("orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    c = t("customer").where("c_acctbal >= -500").select("c_custkey", "c_nationkey")
    chain = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    chain = chain.join(t("nation").where("n_name <> 'CANADA'"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region").where("r_name <> 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    at = F.when(F.col("o_orderkey").isNull(), "order").when(F.col("c_custkey").isNull(), "customer").when(F.col("n_nationkey").isNull(), "nation").when(F.col("r_regionkey").isNull(), "region").otherwise("resolved")
    return chain.groupBy(at.alias("first_missing")).agg(F.sum("n").alias("n"))


# Parts that a supplier ships in a year, linked to last year's parts of the same brand and type by size.
_OFFERS = "WITH q AS (SELECT DISTINCT l_suppkey AS s, year(l_shipdate) AS y, l_partkey AS k, p_brand AS b, p_type AS ty, p_size AS z FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT a.s, a.y, a.b, a.ty, a.k, c.k AS o, round(1 / (1 + abs(a.z - c.z)), 6) AS score FROM q a JOIN q c ON a.s = c.s AND a.y = c.y + 1 AND a.b = c.b AND a.ty = c.ty), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY s, y, b, ty, k ORDER BY score DESC, o) <= 2)"


def _links(t):
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_size")
    offers = t("lineitem").select(F.col("l_suppkey").alias("supplier"), F.year("l_shipdate").cast("long").alias("year"), "l_partkey").distinct().join(part, "l_partkey")
    now = offers.withColumnsRenamed({"l_partkey": "part", "p_size": "size"})
    before = offers.select("supplier", (F.col("year") + 1).alias("year"), "brand", "type", F.col("l_partkey").alias("predecessor"), F.col("p_size").alias("size_before"))
    score = F.round(1 / (1 + F.abs(F.col("size") - F.col("size_before"))), 6)
    return L.predecessors(now, before, ["supplier", "year", "brand", "type"], "part", [F.col("predecessor")], score, 2)


@query(_OFFERS + " SELECT s AS supplier, y AS year, k AS part, o AS predecessor, score FROM l")
def predecessor_topk(t):
    return _links(t).select("supplier", "year", "part", "predecessor", "score")


@query(_OFFERS + " SELECT CASE WHEN outs > 1 AND ins > 1 THEN 'many_to_many' WHEN outs > 1 THEN 'split' WHEN ins > 1 THEN 'merge' ELSE 'continuation' END AS kind, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY s, y, b, ty, o) AS outs, count(*) OVER (PARTITION BY s, y, b, ty, k) AS ins FROM l) GROUP BY 1")
def split_merge(t):
    return L.link_kinds(_links(t), ["supplier", "year", "brand", "type"], "part", "predecessor").groupBy("kind").agg(F.count("*").alias("n"))


# Customers whose key has the same third, or the next key's third, are one entity unless a multiple of 10 breaks the chain.
@query("WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey // 3 END AS a, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey + 1) // 3 END AS b FROM customer), e AS (SELECT x.k, y.k AS o FROM c x JOIN c y ON x.a = y.a UNION SELECT x.k, y.k FROM c x JOIN c y ON x.b = y.b), r AS (SELECT k, k AS o FROM c UNION SELECT r.k, e.o FROM r JOIN e ON r.o = e.k) SELECT k AS c_custkey, min(o) AS component FROM r GROUP BY 1")
def alias_components(t):
    k = F.col("c_custkey")
    d = t("customer").select("c_custkey", F.when(k % 10 != 0, F.floor(k / 3)).alias("a"), F.when(k % 10 != 0, F.floor((k + 1) / 3)).alias("b"))
    return L.alias_components(d, "c_custkey", ["a", "b"])


@query("WITH p AS (SELECT o_custkey AS u, year(o_orderdate) AS t, avg(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY t) AS w FROM p), j AS (SELECT coalesce(a.t, b.t + 1) AS period, a.x AS x1, a.w AS w1, b.x AS x0, b.w AS w0 FROM s a FULL JOIN s b ON a.u = b.u AND a.t = b.t + 1), "
       "g AS (SELECT period, sum(w0 * (x1 - x0)) AS within, sum((w1 - w0) * x1) AS mix, sum(w1 * x1) FILTER (x0 IS NULL) AS entry, -sum(w0 * x0) FILTER (x1 IS NULL) AS exit, sum(w1 * x1) - sum(w0 * x0) AS change FROM j GROUP BY 1 HAVING count(x0) > 0 AND count(x1) > 0) SELECT period, round(within, 2) AS within, round(mix, 2) AS mix, round(coalesce(entry, 0), 2) AS entry, round(coalesce(exit, 0), 2) AS exit, round(change, 2) AS change, true AS adds_up FROM g")  # fmt: skip
def decomposition(t):
    p = t("orders").groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").cast("long").alias("t")).agg(F.avg("o_totalprice").alias("x"), F.count("*").alias("n"))
    out = L.decompose(p, "u", "t", "x", "n")
    adds_up = F.abs(F.col("within") + F.col("mix") + F.col("entry") + F.col("exit") - F.col("change")) < 1e-6
    return out.select("period", *(F.round(c, 2).alias(c) for c in ("within", "mix", "entry", "exit", "change")), adds_up.alias("adds_up"))


@query("WITH p AS (SELECT o_custkey AS u, year(o_orderdate) AS t, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT a.t AS year, h, count(*) AS pairs, round(avg(b.v), 2) AS mean_outcome FROM p a, (VALUES (1), (2)) l(h), p b WHERE a.u = b.u AND b.t = a.t + h GROUP BY 1, 2")
def outcome_lag(t):
    p = t("orders").groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    spread = p.select("u", "year", F.explode(F.array(F.lit(1), F.lit(2))).alias("h")).withColumn("then", F.col("year") + F.col("h"))
    return spread.join(p.select("u", F.col("year").alias("then"), "v"), ["u", "then"]).groupBy("year", "h").agg(F.count("*").alias("pairs"), F.round(F.avg("v"), 2).alias("mean_outcome"))


@query("SELECT CASE WHEN coalesce(v, 0) >= 1000000 THEN 'deep' ELSE 'shallow' END || '_' || CASE WHEN c_acctbal >= 5000 THEN 'defended' ELSE 'exposed' END AS archetype, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def archetype_quadrants(t):
    v = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"))
    name = F.concat(F.when(F.coalesce("v", F.lit(0.0)) >= 1000000, "deep").otherwise("shallow"), F.lit("_"), F.when(F.col("c_acctbal") >= 5000, "defended").otherwise("exposed"))
    return t("customer").join(v, "c_custkey", "left").groupBy(name.alias("archetype")).agg(F.count("*").alias("n"))


# Gone for the last year: discontinued only where something else (a balance below zero) bears it out.
@query("SELECT c_custkey, CASE WHEN last_year >= 2001 THEN 'active' WHEN c_acctbal < 0 THEN 'discontinued' ELSE 'uncertain' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def discontinuation(t):
    last = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.year("o_orderdate")).alias("last_year"))
    state = F.when(F.col("last_year") >= 2001, "active").when(F.col("c_acctbal") < 0, "discontinued").otherwise("uncertain")
    return t("customer").join(last, "c_custkey", "left").select("c_custkey", state.alias("state"))


@query("WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS replaces_id FROM events) SELECT event_type, count(*) AS current FROM e WHERE event_id NOT IN (SELECT replaces_id FROM e WHERE replaces_id IS NOT NULL) GROUP BY 1")
def current_records(t):
    e = t("events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1).alias("replaces_id"))
    return V.current_records(e, "event_id", "replaces_id").groupBy("event_type").agg(F.count("*").alias("current"))


@query("WITH l AS (SELECT o_custkey AS k, max_by(CASE o_orderkey % 3 WHEN 0 THEN 'accepted_risk' WHEN 1 THEN 'fixed' ELSE 'open' END, o_orderkey) AS d FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT coalesce(d, 'open') AS disposition, count(*) AS findings FROM orders LEFT JOIN l ON k = o_custkey WHERE o_totalprice > 200000 GROUP BY 1")
def finding_dispositions(t):
    o = t("orders")
    k = F.col("o_orderkey")
    log = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.when(k % 3 == 0, "accepted_risk").when(k % 3 == 1, "fixed").otherwise("open").alias("d"))
    return V.with_disposition(o.where("o_totalprice > 200000").select("o_custkey"), log, "o_custkey", "o_orderkey", "d").groupBy("disposition").agg(F.count("*").alias("findings"))


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 'not_executed' WHEN count(*) FILTER (o_totalprice > 490000) > 0 THEN 'rejected_critical' WHEN count(*) FILTER (o_orderpriority = '5-LOW') > 4 THEN 'rejected_gate' WHEN count(*) FILTER (o_orderstatus = 'P') > 1 THEN 'pending_review' ELSE 'accepted' END AS verdict FROM orders GROUP BY 1")
def acceptance_verdict(t):
    s = F.col("o_orderstatus")
    c = t("orders").groupBy("o_custkey").agg(F.bool_or(s != "P").alias("ran"), F.count_if(F.col("o_totalprice") > 490000).alias("critical"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("gates"), F.count_if(s == "P").alias("open"))
    return c.select("o_custkey", V.verdict(F.col("ran"), F.col("critical"), F.when(F.col("gates") > 4, 1).otherwise(0), F.when(F.col("open") > 1, 1).otherwise(0)).alias("verdict"))


_SCHEMA = {"required": ["o_clerk"], "properties": {"o_orderstatus": {"enum": ["F", "O"]}, "o_totalprice": {"maximum": 300000, "minimum": 5000}, "o_orderpriority": {"pattern": "^[1-3]-"}}}


@query(
    "SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN '$.o_clerk: required' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN '$.o_orderstatus: not in enum' END, CASE WHEN o_totalprice < 5000 THEN '$.o_totalprice: below minimum' END, CASE WHEN o_totalprice > 300000 THEN '$.o_totalprice: above maximum' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN '$.o_orderpriority: does not match' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM orders"
)
def schema_findings(t):
    d = t("orders").withColumn("o_clerk", F.when(F.col("o_orderkey") % 13 != 0, "clerk"))
    return d.select("o_orderkey", F.array_join(V.schema_errors(_SCHEMA), "; ").alias("errors"))


@query("SELECT d.doc_id, d.q <> '' AND trim(d.q, ' ') <> '' AND c.text IS NOT NULL AND contains(c.text, d.q) AS resolves FROM (SELECT doc_id, substr(text, 11, 30) AS q, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS cited FROM documents) d LEFT JOIN documents c ON c.doc_id = d.cited")
def quotes_in_cited_passage(t):
    d = t("documents").select("doc_id", "text")
    quotes = d.select(F.col("doc_id").alias("quoting"), F.substring("text", 11, 30).alias("q"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"))
    return V.cited_quotes(quotes, d, "doc_id", "q", "text").select(F.col("quoting").alias("doc_id"), "resolves")


_WIDE = {
    "type": "object", "additionalProperties": False, "required": ["o_orderkey"], "definitions": {"day": {"type": "string", "format": "date"}},
    "properties": {"o_orderkey": {"type": "integer"}, "o_totalprice": {"type": "string"}, "day": {"$ref": "#/definitions/day"}, "o_orderpriority": {"type": "string", "maxLength": 8}, "twice": {"type": "array", "uniqueItems": True, "items": {"type": "integer", "maximum": 9}}},
}


@query(
    "SELECT o_orderkey, array_to_string(list_sort(list_filter(['$.o_orderstatus: not allowed', '$.o_totalprice: not of type string', CASE WHEN o_orderkey % 3 = 0 THEN '$.day: not a date' END, CASE WHEN length(o_orderpriority) > 8 THEN '$.o_orderpriority: too long' END, CASE WHEN o_custkey % 12 = o_orderkey % 12 THEN '$.twice: repeated items' END, CASE WHEN o_custkey % 12 > 9 OR o_orderkey % 12 > 9 THEN '$.twice[]: above maximum' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM (SELECT * FROM orders) "
)
def schema_types(t):
    day = F.when(F.col("o_orderkey") % 3 == 0, "2022-02-30").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    twice = F.array(F.col("o_custkey") % 12, F.col("o_orderkey") % 12)
    d = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", day.alias("day"), "o_orderpriority", twice.alias("twice"))
    errors = V.schema_errors(_WIDE, frame=d.schema, first=20)
    return d.select("o_orderkey", F.array_join(F.array_distinct(errors), "; ").alias("errors"))


_MARKERS = ["password", "confidential", "lorem ipsum", "license"]


@query("SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (contains(text, '{m}')) AS has_{m.split()[0]}" for m in _MARKERS) + ", count(*) FILTER (" + " OR ".join(f"contains(text, '{m}')" for m in V.MOJIBAKE) + ") AS mojibake FROM documents GROUP BY 1")
def marker_scan(t):
    d = t("documents").select("source", V.markers_in(F.col("text"), _MARKERS).alias("found"), (F.size(V.markers_in(F.col("text"), V.MOJIBAKE)) > 0).alias("bad"))
    return d.groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("found", m)).alias(f"has_{m.split()[0]}") for m in _MARKERS), F.count_if(F.col("bad")).alias("mojibake"))


@query("SELECT CASE WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.o_custkey IS NULL THEN 'added' ELSE 'kept' END AS change, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996) a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997) b USING (o_custkey) GROUP BY 1")
def entity_changes(t):
    d = t("orders").groupBy("o_custkey").agg(F.bool_or(F.year("o_orderdate") == 1996).alias("a"), F.bool_or(F.year("o_orderdate") == 1997).alias("b")).where("a or b")
    return d.groupBy(F.when(~F.col("b"), "removed").when(~F.col("a"), "added").otherwise("kept").alias("change")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, year(o_orderdate) AS period, min_by(o_orderkey, struct_pack(s := CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, k := o_orderkey)) AS chosen, count(*) AS candidates FROM orders GROUP BY 1, 2")
def firm_year_panel(t):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t("orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("period")).agg(F.min_by("o_orderkey", F.struct(rank, "o_orderkey")).alias("chosen"), F.count("*").alias("candidates"))


@query("SELECT l_orderkey, round(sum(l_quantity / t), 6) AS total_weight, round(abs(sum(l_quantity / t) - 1), 9) > 0.05 AS off FROM (SELECT l_orderkey, l_quantity, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE sum(l_quantity) OVER (PARTITION BY l_orderkey) END AS t FROM lineitem) GROUP BY 1")
def weight_sums(t):
    q = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("t"), F.sum(F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity"))).alias("q"))
    return q.select("l_orderkey", F.round(F.col("q") / F.col("t"), 6).alias("total_weight"), (F.round(F.abs(F.col("q") / F.col("t") - 1), 9) > 0.05).alias("off"))


@query(
    "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(array_to_string(w[i:i + 4], ' '))) END)) AS s FROM w), "
    "c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s GROUP BY s), t AS (SELECT c, n, unnest(s) AS t FROM c), p AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))), l AS (SELECT c, count(*) AS links FROM (SELECT a AS c FROM p UNION ALL SELECT b FROM p) GROUP BY 1) "
    "SELECT doc_id, c.c AS class_id, coalesce(links, 0) AS links FROM s JOIN c ON s.s = c.s LEFT JOIN l ON l.c = c.c"
)
def near_duplicates(t):
    return similarity.similar_texts(t("documents"), "doc_id", "text")


@query("SELECT user_id, max_by(event_type, event_id) AS state, count(*) FILTER (event_type = 'click') AS exposures, min(ts::DATE) AS since FROM events GROUP BY 1")
def case_exposure(t):
    last = F.max_by("event_type", "event_id").alias("state")
    return t("events").groupBy("user_id").agg(last, F.count_if(F.col("event_type") == "click").alias("exposures"), F.min(F.col("ts").cast("date")).alias("since"))


@query("SELECT c_custkey, y.y AS year, CASE WHEN n IS NULL AND first_year > y.y THEN 'not_yet_expected' WHEN n IS NULL AND last_year < y.y THEN 'no_longer_expected' WHEN n IS NULL THEN 'missing' WHEN done = 0 THEN 'unverified' WHEN n >= 3 THEN 'complete' ELSE 'partial' END AS completeness FROM customer JOIN (SELECT o_custkey, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) y LEFT JOIN (SELECT o_custkey AS k, year(o_orderdate) AS t, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1, 2) g ON g.k = c_custkey AND g.t = y.y")
def corpus_completeness(t):
    year = F.year("o_orderdate").cast("long")
    had = t("orders").groupBy("o_custkey", year.alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    span = had.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    grid = t("customer").select("c_custkey").join(span, "c_custkey").withColumn("year", F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))))
    n, y = F.col("n"), F.col("year")
    state = (
        F.when(n.isNull() & (F.col("first_year") > y), "not_yet_expected").when(n.isNull() & (F.col("last_year") < y), "no_longer_expected").when(n.isNull(), "missing")
        .when(F.col("done") == 0, "unverified").when(n >= 3, "complete").otherwise("partial")
    )
    return grid.join(had.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey", "year"], "left").select("c_custkey", "year", state.alias("completeness"))


_ARMS = {"short": 400, "base": 800, "long": 1600}


@query("WITH a AS (" + " UNION ALL ".join(f"SELECT '{k}' AS arm, {v} AS least" for k, v in _ARMS.items()) + "), s AS (SELECT arm, count(*) AS n, avg(((n_chars > least)::INT = quality)::INT) AS x FROM documents JOIN labels USING (doc_id), a GROUP BY 1) SELECT arm, n, round(x, 6) AS accuracy, round(x - (SELECT x FROM s WHERE arm = 'base'), 6) AS delta FROM s")
def ablation_arms(t):
    d = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    right = lambda least: F.avg(((F.col("n_chars") > least).cast("int") == F.col("quality")).cast("int"))
    wide = d.agg(F.count("*").alias("n"), *(right(v).alias(k) for k, v in _ARMS.items()))
    arms = F.array(*(F.struct(F.lit(k).alias("arm"), F.col(k).alias("x")) for k in _ARMS))
    return wide.select("n", "base", F.explode(arms).alias("a")).select("a.arm", "n", F.round("a.x", 6).alias("accuracy"), F.round(F.col("a.x") - F.col("base"), 6).alias("delta"))


_TAGS = {"late_close": "o_orderstatus = 'P'", "over_budget": "o_totalprice > 400000", "ignored": "o_orderpriority = '5-LOW'", "never_seen": "o_totalprice < 0"}


@query("SELECT tag, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{k}')" for k in _TAGS) + ") v(tag) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{k}' AS g, count(*) AS n FROM orders WHERE {v}" for k, v in _TAGS.items()) + ") ON g = tag")
def failure_tags(t):
    # One pass: tags are counted as columns, so those that never occur keep their row.
    wide = t("orders").agg(*(F.count_if(F.expr(v)).alias(k) for k, v in _TAGS.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("tag"), F.col(k).alias("n")) for k in _TAGS))).alias("s")).select("s.*")
