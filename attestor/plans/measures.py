"""Queries of the later stages over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import longitudinal as L
from ..operators import measures as M
from ..operators import relational as R
from ..operators import validation as V
from .catalogue import query
from .evaluation import _SCALE

_SAID = ["announced", "private_beta", " Public_Beta ", "general_availability", "broadly_deployed_or_default", "deprecated", "discontinued", "soon"]


@query(f"SELECT state, count(*) AS n FROM (SELECT CASE s WHEN 'broadly_deployed_or_default' THEN 'default_or_broadly_deployed' WHEN 'soon' THEN 'unknown' ELSE coalesce(s, 'unknown') END AS state FROM (SELECT lower(trim(CASE WHEN p_partkey % 9 < 8 THEN {_SAID}[p_partkey % 9 + 1] END)) AS s FROM part)) GROUP BY 1")
def availability_states(t):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("p_partkey") % 9).cast("int"))
    return t("part").groupBy(M.availability(said).alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, list_position({_SCALE[:4]}, o_orderpriority) - 1 AS rank FROM orders")
def ordinal_encode(t):
    return t("orders").select("o_orderkey", S.scale_rank(F.col("o_orderpriority"), _SCALE[:4]).alias("rank"))


_OFFICIAL = ["example.com", "example.org"]
_KINDS = [("^/en/", "product_page"), ("^/(de|fr)/", "newsroom"), ("^/$|^$", "official_ir")]


@query("SELECT page_id, h IN ('example.com', 'example.org') OR ends_with(h, '.example.com') OR ends_with(h, '.example.org') AS official, CASE WHEN starts_with(p, '/en/') THEN 'product_page' WHEN starts_with(p, '/de/') OR starts_with(p, '/fr/') THEN 'newsroom' WHEN p IN ('', '/') THEN 'official_ir' ELSE 'archived_official_page' END AS kind FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def source_kinds(t):
    host, path = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    kind = M.source_kind(host, path, _OFFICIAL, _KINDS, "archived_official_page")
    return t("pages").select("page_id", kind.alias("k")).select("page_id", "k.official", "k.kind")


_TIERS = {"en": 1, "de": 2, "fr": 3}


@query("SELECT doc_id, coalesce(MAP {'en': 1, 'de': 2, 'fr': 3}[lang], 6) AS tier, row_number() OVER (PARTITION BY text ORDER BY coalesce(MAP {'en': 1, 'de': 2, 'fr': 3}[lang], 6), (doc_id * 37) % 365, doc_id) = 1 AS canonical FROM documents")
def dated_canonical_source(t):
    tier = F.coalesce(F.create_map(*(F.lit(x) for kv in _TIERS.items() for x in kv))[F.col("lang")], F.lit(6))
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), tier.alias("tier"), (F.col("doc_id") * 37 % 365).alias("day"))
    best = R.best_per_key(d, ["h"], ["tier", "day", "doc_id"], latest=False).select("doc_id", F.lit(True).alias("is_best"))
    return d.join(best, "doc_id", "left").select("doc_id", "tier", F.coalesce("is_best", F.lit(False)).alias("canonical"))


_ROLE = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 WHEN 'N' THEN 0.25 END"


@query(f"WITH l AS (SELECT p_type, p_brand, l_partkey, l_quantity AS q, l_extendedprice AS x, {_ROLE} AS r FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT p_type, p_brand, l_partkey, avg(q) AS m FROM l GROUP BY ALL), b AS (SELECT p_type, p_brand, avg(m) AS m FROM p GROUP BY ALL), "
       "u AS (SELECT p_type, avg(q) AS task, sum(q * r) / sum(r) AS role, sum(q * x) / sum(x) AS revenue FROM l GROUP BY 1), v AS (SELECT p_type, avg(m) AS product FROM p GROUP BY 1), w AS (SELECT p_type, avg(m) AS family FROM b GROUP BY 1) SELECT p_type, round(task, 6) AS task, round(role, 6) AS role, round(product, 6) AS product, round(family, 6) AS family, round(revenue, 6) AS revenue FROM u JOIN v USING (p_type) JOIN w USING (p_type)")  # fmt: skip
def weighted_levels(t):
    # Averages of averages from one pass: sums by part, then up the levels.
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    f = F.col("l_returnflag")
    role = F.when(f == "A", 1.0).when(f == "R", 0.5).when(f == "N", 0.25)
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    one = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(q).alias("q"), F.sum(q * role).alias("qr"), F.sum(F.when(q.isNotNull(), role)).alias("r"), F.sum(q * x).alias("qx"), F.sum(F.when(q.isNotNull(), x)).alias("x"))
    of_part = one.join(part, "l_partkey").withColumn("m", F.col("q") / F.col("n"))
    of_brand = of_part.groupBy("p_type", "p_brand").agg(*(F.sum(c).alias(c) for c in ("n", "q", "qr", "r", "qx", "x", "m")), F.count("*").alias("parts"), F.avg("m").alias("mean"))
    s = lambda c: F.sum(c)
    return of_brand.groupBy("p_type").agg(F.round(s("q") / s("n"), 6).alias("task"), F.round(s("qr") / s("r"), 6).alias("role"), F.round(s("m") / s("parts"), 6).alias("product"), F.round(F.avg("mean"), 6).alias("family"), F.round(s("qx") / s("x"), 6).alias("revenue"))


@query("SELECT n_regionkey, round(sum(c_acctbal * w) / sum(CASE WHEN c_acctbal IS NOT NULL THEN w END), 6) AS mean FROM (SELECT n_regionkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_custkey % 7 + 1 AS w FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def weighted_means(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"), (F.col("c_custkey") % 7 + 1).alias("w"))
    return d.groupBy("n_regionkey").agg(F.round(R.weighted_mean("v", "w"), 6).alias("mean"))


@query("SELECT lang, count(*) AS eligible, count(quality) AS measured, round(count(*) FILTER (quality IS NULL) / count(*), 6) AS unknown_rate, round(sum(n_chars) FILTER (quality IS NOT NULL) / sum(n_chars), 6) AS weighted_coverage, count(*) FILTER (c = 'high') AS high, count(*) FILTER (c = 'medium') AS medium, count(*) FILTER (c = 'low') AS low FROM (SELECT d.*, quality, CASE WHEN quality IS NULL THEN NULL WHEN n_chars >= 1500 THEN 'high' WHEN n_chars >= 500 THEN 'medium' ELSE 'low' END AS c FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def weighted_coverage(t):
    both = t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    known, n = F.col("quality").isNotNull(), F.col("n_chars")
    level = F.when(known, F.when(n >= 1500, "high").when(n >= 500, "medium").otherwise("low"))
    return both.groupBy("lang").agg(
        F.count("*").alias("eligible"), F.count("quality").alias("measured"), F.round(F.count_if(~known) / F.count("*"), 6).alias("unknown_rate"), F.round(F.sum(F.when(known, n)) / F.sum(n), 6).alias("weighted_coverage"),
        *(F.count_if(level == c).alias(c) for c in ("high", "medium", "low")),
    )


@query("WITH p AS (SELECT o_custkey AS u, year(o_orderdate) AS t, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS role FROM orders GROUP BY 1, 2), j AS (SELECT coalesce(a.t, b.t + 1) AS period, a.u IS NOT NULL AS now, b.u IS NOT NULL AS before, a.role FROM p a FULL JOIN p b ON a.u = b.u AND a.t = b.t + 1) "
       "SELECT period, count(*) FILTER (now) AS units, round(count(*) FILTER (now AND NOT before) / nullif(count(*) FILTER (now), 0), 6) AS entry_rate, round(count(*) FILTER (before AND NOT now) / nullif(count(*) FILTER (before), 0), 6) AS exit_rate, count(*) FILTER (role = 3) AS core, count(*) FILTER (role = 2) AS supporting, count(*) FILTER (role = 1) AS peripheral FROM j GROUP BY 1")  # fmt: skip
def portfolio_rates(t):
    s = F.col("o_orderstatus")
    p = t("orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("long").alias("period")).agg(F.max(F.when(s == "F", 3).when(s == "O", 2).otherwise(1)).alias("role"))
    out = R.entry_exit(p, "unit", "period", "role")
    now, before = F.col("now").isNotNull(), F.col("before").isNotNull()
    share = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    return out.groupBy("period").agg(F.count_if(now).alias("units"), share(now & ~before, now).alias("entry_rate"), share(before & ~now, before).alias("exit_rate"), *(F.count_if(F.col("now") == k).alias(c) for k, c in ((3, "core"), (2, "supporting"), (1, "peripheral"))))


@query("SELECT source, round(r, 6) AS rate, round(n, 4) AS effective_n, round((r + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(r * (1 - r) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS upper FROM (SELECT source, sum(w * (1 - quality)) / sum(w) AS r, sum(w) * sum(w) / sum(w * w) AS n FROM (SELECT source, quality, 1 + n_chars % 5 + 0.0::DOUBLE AS w FROM documents JOIN labels USING (doc_id)) GROUP BY 1)")
def weighted_unsafe_rate(t):
    d = t("documents").select("doc_id", "source", (1 + F.col("n_chars") % 5).cast("double").alias("w")).join(t("labels").select("doc_id", "quality"), "doc_id")
    r = d.groupBy("source").agg(M.weighted_rate(1 - F.col("quality"), F.col("w")).alias("r"))
    return r.select("source", F.round("r.rate", 6).alias("rate"), F.round("r.n", 4).alias("effective_n"), F.round("r.upper", 6).alias("upper"))


@query("WITH p AS (SELECT o_custkey AS u, year(o_orderdate) AS t, o_orderstatus AS r, avg(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END) AS x, count(*) AS n FROM orders GROUP BY 1, 2, 3), q AS (SELECT u, t, r, x, n FROM p WHERE x IS NOT NULL), z AS (SELECT *, sum(n) OVER (PARTITION BY t) AS total, sum(n) OVER (PARTITION BY t, u) AS own FROM q), "
       "s AS (SELECT u, t, r, x, own / total AS s, n / own AS rho FROM z), k AS (SELECT DISTINCT u, t FROM p), m AS (SELECT u, t, any_value(s) AS s, sum(rho * x) AS x FROM s GROUP BY 1, 2), "
       "j AS (SELECT coalesce(a.u, b.u) AS u, coalesce(a.t, b.t + 1) AS period, a.x AS x1, a.rho AS r1, b.x AS x0, b.rho AS r0 FROM s a FULL JOIN s b ON a.u = b.u AND a.t = b.t + 1 AND a.r = b.r), "
       "g AS (SELECT coalesce(a.u, b.u) AS u, coalesce(a.t, b.t + 1) AS period, a.s AS s1, b.s AS s0, a.x AS x1, b.x AS x0 FROM m a FULL JOIN m b ON a.u = b.u AND a.t = b.t + 1), "
       "i AS (SELECT g.*, k1.u IS NOT NULL AS here, k0.u IS NOT NULL AS there FROM g LEFT JOIN k k1 ON k1.u = g.u AND k1.t = g.period LEFT JOIN k k0 ON k0.u = g.u AND k0.t = g.period - 1), "
       "e AS (SELECT j.period, sum(CASE WHEN j.x1 IS NOT NULL AND j.x0 IS NOT NULL THEN g.s0 * r0 * (j.x1 - j.x0) END) AS within, sum(g.s0 * (coalesce(r1 * j.x1, 0) - coalesce(r0 * j.x0, 0) - CASE WHEN j.x1 IS NOT NULL AND j.x0 IS NOT NULL THEN r0 * (j.x1 - j.x0) ELSE 0 END)) AS role FROM j JOIN g ON g.u = j.u AND g.period = j.period WHERE g.s0 IS NOT NULL AND g.s1 IS NOT NULL GROUP BY 1), "
       "f AS (SELECT period, coalesce(sum((s1 - s0) * x1) FILTER (s1 IS NOT NULL AND s0 IS NOT NULL), 0) AS mix, coalesce(sum(s1 * x1) FILTER (s0 IS NULL AND NOT there), 0) AS entry, coalesce(-sum(s0 * x0) FILTER (s1 IS NULL AND NOT here), 0) AS exit, "
       "coalesce(sum(s1 * x1) FILTER (s0 IS NULL AND there), 0) + coalesce(-sum(s0 * x0) FILTER (s1 IS NULL AND here), 0) AS coverage, sum(s1 * x1) - sum(s0 * x0) AS change FROM i GROUP BY 1 HAVING count(s0) > 0 AND count(s1) > 0) "
       "SELECT f.period, round(within, 2) AS within, round(role, 2) AS role, round(mix, 2) AS mix, round(entry, 2) AS entry, round(exit, 2) AS exit, round(coverage, 2) AS coverage, round(change, 2) AS change, true AS adds_up FROM f JOIN e USING (period)")  # fmt: skip
def role_decomposition(t):
    known = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    p = t("orders").groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").cast("long").alias("t"), F.col("o_orderstatus").alias("r")).agg(F.avg(known).alias("x"), F.count("*").alias("n"))
    out = L.decompose_roles(p, "u", "r", "t", "x", "n")
    parts = ("within", "role", "mix", "entry", "exit", "coverage")
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    return out.select("period", *(F.round(c, 2).alias(c) for c in (*parts, "change")), (F.abs(total - F.col("change")) < 1e-5).alias("adds_up"))


# Vectors stand for tasks: odd ids follow even ones in the same firm (a run of 50 ids) and product (label); the first few
# numbers' signs are its capabilities.
_CAND = (
    "WITH v AS (SELECT vec_id AS k, vec_id // 50 AS firm, label, embedding::DOUBLE[] AS e, list_filter(list_transform(range(8), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda x: x IS NOT NULL) AS c FROM embeddings), "
    "r AS (SELECT a.k AS successor, b.k AS predecessor, a.k % 10 = b.k % 10 + 1 AS named, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS need, coalesce(round(len(list_intersect(a.c, b.c)) / nullif(len(list_distinct(list_concat(a.c, b.c))), 0), 6), 0) AS shared, len(a.c) - len(b.c) AS gain FROM v a JOIN v b ON a.firm = b.firm AND a.label = b.label WHERE a.k % 2 = 1 AND b.k % 2 = 0), "
    "s AS (SELECT *, round(need + shared + named::INT, 6) AS score FROM r), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY successor ORDER BY score DESC, predecessor) <= 2) "
)


def _candidates(t):
    k = F.col("vec_id")
    signs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.get("embedding", i) > 0, i)), lambda x: x.isNotNull())
    v = t("embeddings").select(k.alias("k"), F.floor(k / 50).alias("firm"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"), signs.alias("c"))
    now = v.where("k % 2 = 1").withColumnsRenamed({"k": "successor", "e": "e1", "c": "c1"})
    before = v.where("k % 2 = 0").withColumnsRenamed({"k": "predecessor", "e": "e0", "c": "c0"})
    need, shared = F.round(M.cosine(F.col("e1"), F.col("e0")), 6), F.round(M.overlap(F.col("c1"), F.col("c0")), 6)
    named = F.col("successor") % 10 == F.col("predecessor") % 10 + 1
    score = F.round(need + shared + named.cast("int"), 6)
    best = L.predecessors(now, before, ["firm", "label"], "successor", [F.col("predecessor")], score, 2)
    return best.select("firm", "label", "successor", "predecessor", need.alias("need"), shared.alias("shared"), named.alias("named"), (F.size("c1") - F.size("c0")).alias("gain"), "score")


@query(_CAND + "SELECT successor, predecessor, need, shared, score FROM l")
def candidate_scores(t):
    return _candidates(t).select("successor", "predecessor", "need", "shared", "score")


@query(_CAND + ", d AS (SELECT *, count(*) OVER (PARTITION BY predecessor) AS outs, count(*) OVER (PARTITION BY successor) AS ins FROM l WHERE need > 0.1), x AS (SELECT successor AS k, CASE WHEN outs > 1 AND ins > 1 THEN 'uncertain' WHEN outs > 1 THEN 'split_into_multiple_tasks' WHEN ins > 1 THEN 'merged_from_multiple_tasks' WHEN need >= 0.2 AND named AND gain > 0 THEN 'expanded_scope' WHEN need >= 0.2 AND named AND gain < 0 THEN 'contracted_scope' WHEN need >= 0.2 AND named THEN 'same_task_unchanged' WHEN need >= 0.2 THEN 'renamed_or_repackaged' WHEN need >= 0.15 THEN 'uncertain' ELSE 'replaced' END AS label FROM d "
       "UNION ALL SELECT vec_id, 'new_task' FROM embeddings WHERE vec_id % 2 = 1 AND vec_id NOT IN (SELECT successor FROM d) UNION ALL SELECT vec_id, 'discontinued' FROM embeddings WHERE vec_id % 2 = 0 AND vec_id NOT IN (SELECT predecessor FROM d)) SELECT label, count(*) AS n FROM x GROUP BY 1")  # fmt: skip
def transition_labels(t):
    links = L.link_kinds(_candidates(t).where("need > 0.1"), ["firm", "label"], "successor", "predecessor")
    label = M.transition_label(F.col("named"), F.col("need"), F.col("gain"), F.col("out_links"), F.col("in_links"), 0.2, 0.15)
    v = t("embeddings").select("vec_id")
    alone = lambda rest, c, name: v.where(F.col("vec_id") % 2 == rest).join(links.select(F.col(c).alias("vec_id")), "vec_id", "left_anti").select(F.lit(name).alias("label"))
    both = links.select(label.alias("label")).unionByName(alone(1, "successor", "new_task")).unionByName(alone(0, "predecessor", "discontinued"))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT p_partkey AS k, p_name, CASE WHEN p_size % 11 <> 0 THEN p_size % 7 <> 0 END AS supported, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS first, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS same, p_partkey % 4 AS members, p_size > 25 AS plan FROM part) SELECT k AS p_partkey, CASE WHEN supported IS NULL THEN 'unresolved' WHEN NOT supported THEN 'exclude' WHEN first <> k THEN 'merge' WHEN members > 1 AND plan THEN 'bundle' WHEN members > 1 THEN 'family' ELSE 'retain' END AS decision, CASE WHEN supported AND first <> k THEN first END AS merged_into FROM p")
def product_consolidation(t):
    key = ["p_brand", "p_type", "p_size"]
    part = t("part")
    first = part.groupBy(*key).agg(F.min("p_partkey").alias("first"))
    d = part.join(first, key)
    alias = F.when(F.col("first") != F.col("p_partkey"), F.col("first"))
    supported = F.when(F.col("p_size") % 11 != 0, F.col("p_size") % 7 != 0)
    decision = M.consolidation(supported, alias, F.col("p_partkey") % 4, F.col("p_size") > 25)
    return d.select("p_partkey", decision.alias("decision"), F.when(decision == "merge", F.col("first")).alias("merged_into"))


@query("WITH m AS (SELECT l_suppkey, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_quantity AS INT) % 6 END AS replicability, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS INT) % 7 END AS depth FROM lineitem) SELECT l_suppkey, count(*) AS records, count(replicability) AS replicability_known, count(*) FILTER (replicability > 4) AS off_replicability, count(*) FILTER (depth > 5) AS off_depth, count(*) FILTER (replicability <= 4 AND depth <= 5) AS complete, round(avg(replicability) FILTER (replicability <= 4), 6) AS mean_replicability FROM m GROUP BY 1")
def measurement_records(t):
    q = F.col("l_quantity").cast("int")
    d = t("lineitem").select("l_suppkey", F.when(F.col("l_linenumber") % 5 != 0, q % 6).alias("replicability"), F.when(F.col("l_linenumber") % 4 != 0, q % 7).alias("depth"))
    off = lambda c: F.array_contains("invalid", c)
    return M.measured(d).groupBy("l_suppkey").agg(
        F.count("*").alias("records"), F.count("replicability").alias("replicability_known"), F.count_if(off("replicability")).alias("off_replicability"), F.count_if(off("depth")).alias("off_depth"),
        F.count_if("complete").alias("complete"), F.round(F.avg(F.when(~off("replicability"), F.col("replicability"))), 6).alias("mean_replicability"),
    )


_METRICS = {
    ("E1", "official_domain_precision"): ("true", "official"), ("E1", "duplicate_source_rate"): ("true", "copies > 1"), ("E2", "evidence_validity"): ("quality IS NOT NULL", "n_chars > 500"), ("E2", "duplicate_product_rate"): ("quality = 1", "copies > 1"),
    ("E3", "marketing_false_positives"): ("toxic = 1", "quality = 1"), ("E4", "evidence_coverage"): ("n_chars > 200", "quality IS NOT NULL"), ("E5", "unresolved_rate"): ("lang = 'en'", "quality IS NULL"), ("E6", "unknown_calibration"): ("quality IS NULL", "n_chars < 400"),
    ("E6", "no_rows"): ("n_chars < 0", "true"),
}


@query("WITH d AS (SELECT d.*, quality, toxic, count(*) OVER (PARTITION BY text) AS copies, source < 'src5' AS official FROM documents d LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{s}' AS stage, '{m}' AS metric, count(*) FILTER ({of}) AS n, round(count(*) FILTER (({of}) AND ({hit})) / nullif(count(*) FILTER ({of}), 0), 6) AS value FROM d" for (s, m), (of, hit) in _METRICS.items()))
def stage_metrics(t):
    d = t("documents").select("doc_id", "lang", "source", "n_chars", F.xxhash64("text").alias("h"))
    copies = d.groupBy("h").agg(F.count("*").alias("copies"))
    d = d.join(copies, "h").join(t("labels"), "doc_id", "left").withColumn("official", F.col("source") < "src5")
    out = M.stage_metrics(d, {k: (F.expr(of), F.expr(hit)) for k, (of, hit) in _METRICS.items()})
    return out.withColumn("value", F.round("value", 6))


_ALL_TAGS = [(g, x) for g, xs in M.FAILURE_TAGS.items() for x in xs]


@query("SELECT g AS tag_group, x AS tag, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"({i}, '{g}', '{x}')" for i, (g, x) in enumerate(_ALL_TAGS)) + ") v(i, g, x) LEFT JOIN (SELECT i, count(*) AS n FROM (SELECT unnest([o_orderkey % 61, o_custkey % 67]) AS i FROM orders) GROUP BY 1) c USING (i)")
def failure_taxonomy(t):
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(g).alias("tag_group"), F.lit(x).alias("tag")) for i, (g, x) in enumerate(_ALL_TAGS)))
    tags = t("region").limit(1).select(F.explode(rows).alias("r")).select("r.*")
    seen = t("orders").select(F.explode(F.array(F.col("o_orderkey") % 61, F.col("o_custkey") % 67)).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    return tags.join(seen, "i", "left").select("tag_group", "tag", F.coalesce("n", F.lit(0)).alias("n"))


# A balanced panel, where the two-way slope has a closed form.
@query("WITH g AS (SELECT c_custkey AS u, t FROM customer, (SELECT unnest(range(1995, 2002)) AS t)), p AS (SELECT g.u, g.t, coalesce(sum(o_totalprice), 0) / 1000 AS y, count(o_orderkey)::DOUBLE AS x FROM g LEFT JOIN orders ON o_custkey = g.u AND year(o_orderdate) = g.t GROUP BY 1, 2), d AS (SELECT y - avg(y) OVER (PARTITION BY u) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY u) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x FROM p) SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 4) AS slope FROM d")
def two_way_effects(t):
    year = F.year("o_orderdate").cast("long")
    had = t("orders").groupBy(F.col("o_custkey").alias("u"), year.alias("t")).agg((F.sum("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("x"))
    grid = t("customer").select(F.col("c_custkey").alias("u"), F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))).alias("t"))
    p = grid.join(had, ["u", "t"], "left").fillna(0.0, ["y", "x"])
    return M.two_way_slope(p, "u", "t", "y", "x").select("n", F.round("slope", 4).alias("slope"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS passages, count(*) AS n FROM orders GROUP BY 1")
def ordered_packets(t):
    one = F.struct("o_orderdate", "o_orderkey")
    got = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return got.select("o_custkey", F.array_join(F.transform("p", lambda x: x["o_orderkey"].cast("string")), ",").alias("passages"), F.size("p").cast("long").alias("n"))


@query("SELECT suite, user_id, event_type AS last_event, n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'regression' WHEN user_id % 3 = 1 THEN 'development' ELSE 'holdout' END AS suite, user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1")
def suite_membership(t):
    k = F.col("user_id") % 3
    suite = F.when(k == 0, "regression").when(k == 1, "development").otherwise("holdout")
    return t("events").groupBy(suite.alias("suite"), "user_id").agg(F.max_by("event_type", "event_id").alias("last_event"), F.count("*").alias("n"))



@query(
    "SELECT 'prohibited_field' AS validator, count(*) AS n FROM events WHERE json_exists(props, '$.k') AND event_type = 'click' UNION ALL SELECT 'roadmap_only', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N')) "
    "UNION ALL SELECT 'raw_changed', count(*) FROM documents WHERE doc_id % 17 = 0 AND lang <> 'es' UNION ALL SELECT 'raw_gone', count(*) FROM documents WHERE lang = 'es' UNION ALL SELECT 'outcome_present', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
)
def deterministic_validators(t):
    count = lambda d, name: d.agg(F.lit(name).alias("validator"), F.count("*").alias("n"))
    keys = V.prohibited_keys(t("events").where("event_type = 'click'").select("props"), "props", ["k", "ticker"])
    parts = V.roadmap_only(t("part").select(F.col("p_partkey").alias("l_partkey")), t("lineitem"), "l_partkey", "l_returnflag", ["N"])
    d = t("documents").select("doc_id", "text", "lang")
    now = d.where("lang <> 'es'").select("doc_id", F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    moved = V.changed_raw(d, now, "doc_id", "text")
    o = t("orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), F.col("o_totalprice")).alias("revenue_next_year"))
    out = count(keys.where(F.size("prohibited") > 0), "prohibited_field").unionByName(count(parts, "roadmap_only"))
    out = out.unionByName(count(moved.where("what = 'changed'"), "raw_changed")).unionByName(count(moved.where("what = 'gone'"), "raw_gone"))
    return out.unionByName(count(o.where(F.size(V.outcomes_in(o, ["revenue_next_year", "return_12m"])) > 0), "outcome_present"))
