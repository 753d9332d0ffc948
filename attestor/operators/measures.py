"""Operators of the later stages: availability, source kinds, candidate scores and transition labels, consolidation,
measurement records, weighted rates, stage metrics, panel association and seeded draws."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import wilson_upper

# Fixed values.
AVAILABILITY = ["announced", "private_beta", "public_beta", "general_availability", "default_or_broadly_deployed", "deprecated", "discontinued"]
AVAILABILITY_ALIASES = {"broadly_deployed_or_default": "default_or_broadly_deployed"}
TRANSITIONS = [
    "same_task_unchanged", "renamed_or_repackaged", "expanded_scope", "contracted_scope", "ai_assisted", "generative_transformation", "workflow_integrated",
    "agentified_or_action_enabled", "split_into_multiple_tasks", "merged_from_multiple_tasks", "replaced", "discontinued", "new_task", "uncertain",
]
CONSOLIDATION = ["retain", "merge", "family", "bundle", "exclude", "unresolved"]
SCALES = {"replicability": 4, "depth": 5}
FAILURE_TAGS = {
    "source_and_time": ["wrong_source_type", "unofficial_source", "publication_date_unknown", "temporal_leakage", "live_page_used_historically", "evidence_quote_missing", "source_id_unresolved", "passage_id_unresolved"],
    "product_ontology": ["feature_as_product", "bundle_as_product", "suite_inflation", "product_omission", "product_duplicate", "rename_as_new_product", "roadmap_as_active_product"],
    "capability_ontology": ["marketing_as_capability", "task_as_capability", "internal_rd_as_capability", "capability_omission", "capability_duplicate", "unsupported_capability"],
    "task_ontology": ["mission_as_task", "task_too_broad", "task_too_narrow", "task_duplicate", "channel_as_task", "internal_task", "unsupported_task", "customer_need_missing", "wrong_parent_capability", "role_misclassification"],
    "longitudinal_matching": ["false_new", "false_discontinued", "rename_mismatch", "split_missed", "merge_missed", "transformation_misclassified", "predecessor_link_wrong"],
    "measurement": ["ai_wording_contamination", "frontier_date_wrong", "unsupported_depth", "unsupported_scale", "defensibility_by_asset_presence", "unknown_should_not_be_scored", "benefit_assumed_from_adoption", "outcome_leakage"],
    "parsing_and_system": ["schema_invalid", "required_field_missing", "duplicate_id", "silent_repair", "run_artifact_overwritten", "legacy_contamination"],
}


def availability(c: Column) -> Column:
    """The state in its one spelling; unknown for any other text, null included."""
    plain = F.lower(F.trim(c))
    plain = reduce(lambda e, kv: F.when(plain == kv[0], kv[1]).otherwise(e), AVAILABILITY_ALIASES.items(), plain)
    return F.when(plain.isin(AVAILABILITY), plain).otherwise("unknown")


def source_kind(host: Column, path: Column, official: list[str], kinds: list[tuple[str, str]], other: str) -> Column:
    """(official, kind): whether the host is one of the allowed ones or under it, and the first kind whose pattern the path
    matches."""
    allowed = reduce(lambda e, h: e | (host == h) | F.endswith(host, F.lit(f".{h}")), official, F.lit(False))
    kind = reduce(lambda e, pk: F.when(path.rlike(pk[0]), pk[1]).otherwise(e), reversed(kinds), F.lit(other))
    return F.struct(F.coalesce(allowed, F.lit(False)).alias("official"), kind.alias("kind"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def transition_label(name: Column, similarity: Column, gain: Column, outs: Column, ins: Column, same: float, related: float) -> Column:
    """A label of TRANSITIONS proposed for a link from deterministic features: whether the names are equal, the similarity of
    need, the change of scope, and the link's degrees. What a reviewer must decide stays uncertain."""
    return (
        F.when((outs > 1) & (ins > 1), "uncertain").when(outs > 1, "split_into_multiple_tasks").when(ins > 1, "merged_from_multiple_tasks").when(similarity.isNull(), "uncertain")
        .when((similarity >= same) & name & (gain > 0), "expanded_scope").when((similarity >= same) & name & (gain < 0), "contracted_scope").when((similarity >= same) & name, "same_task_unchanged")
        .when(similarity >= same, "renamed_or_repackaged").when(similarity >= related, "uncertain").otherwise("replaced")
    )


def consolidation(supported: Column, alias_of: Column, members: Column, is_plan: Column) -> Column:
    """The second pass over product candidates: excluded without support, unresolved where support is unknown, merged into the
    product it is an alias of, a bundle or a family by its members, else retained."""
    return (
        F.when(supported.isNull(), "unresolved").when(~supported, "exclude").when(alias_of.isNotNull(), "merge")
        .when((members > 1) & F.coalesce(is_plan, F.lit(False)), "bundle").when(members > 1, "family").otherwise("retain")
    )


def measured(df: DataFrame, scales: dict[str, int] = SCALES) -> DataFrame:
    """df with `complete` and `invalid`: a score is null where unknown, never 0; one off its scale is named. Components stay
    apart, there is no composite."""
    off = F.filter(F.array(*(F.when((F.col(c) < 0) | (F.col(c) > most), c) for c, most in scales.items())), lambda x: x.isNotNull())
    known = reduce(lambda e, c: e & F.col(c).isNotNull(), scales, F.lit(True))
    return df.withColumns({"invalid": off, "complete": known & (F.size(off) == 0)})


def weighted_rate(bad: Column, weight: Column, z: float = 1.96) -> Column:
    """Aggregate: rate, effective n and Wilson upper bound of a weighted rate; weights count where `bad` is known."""
    w = F.when(bad.isNotNull(), weight)
    total = F.sum(w)
    rate, n = F.sum(w * bad.cast("double")) / total, total * total / F.sum(w * w)
    return F.struct(rate.alias("rate"), n.alias("n"), wilson_upper(rate * n, n, z).alias("upper"))


def stage_metrics(df: DataFrame, metrics: dict[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """(stage, metric, n, value) of conditional means: of the rows where the first test holds, the share where the second does.
    One pass, however many metrics; a metric without rows has a null value."""
    names = list(metrics)
    wide = df.agg(*(x for i, (of, hit) in enumerate(metrics.values()) for x in (F.count_if(of).alias(f"n{i}"), F.count_if(of & hit).alias(f"k{i}"))))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"), F.try_divide(F.col(f"k{i}"), F.col(f"n{i}")).alias("value")) for i, (s, m) in enumerate(names)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def two_way_slope(panel: DataFrame, unit: str, period: str, y: str, x: str) -> DataFrame:
    """(n, slope): y on x with effects of unit and period. Units are taken out by their means; what is left is regressed on x
    and a column for each period, whose sums of products are one aggregate of the size of the periods' number squared. So the
    panel may be unbalanced, and only that matrix reaches the driver. Periods must be few."""
    periods = [r[0] for r in panel.select(period).distinct().orderBy(period).collect()][1:]
    wide = panel.select(unit, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x0"), *(F.when(F.col(period) == t, 1.0).otherwise(0.0).alias(f"x{i}") for i, t in enumerate(periods, 1)))
    cols = ["y", *(f"x{i}" for i in range(len(periods) + 1))]
    means = wide.groupBy(unit).agg(*(F.avg(c).alias(f"m_{c}") for c in cols))
    flat = wide.join(means, unit).select(*((F.col(c) - F.col(f"m_{c}")).alias(c) for c in cols))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = flat.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs)).first()
    at = {(a, b): row[f"{a}*{b}"] or 0.0 for a, b in pairs}
    at |= {(b, a): v for (a, b), v in at.items()}
    xs = cols[1:]
    slope = np.linalg.lstsq(np.array([[at[a, b] for b in xs] for a in xs]), np.array([at[a, "y"] for a in xs]), rcond=None)[0][0] if row["n"] else None
    return panel.sparkSession.createDataFrame([(row["n"], None if slope is None else float(slope))], "n long, slope double")


def seeded_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    """k rows of each stratum as Python's own generator draws them, seeded by (seed, parts of the stratum), from members in the
    order of their keys: record for record what another such draw gives. The stratum is an array of texts. A stratum meets in
    one task, so this is for audit pools; relational.stratified_sample draws at any size."""
    if per_stratum < 1:
        raise ValueError("per_stratum must be at least 1")

    def draw(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values(key, key=lambda s: s.astype(str), kind="stable").reset_index(drop=True)
        rng = random.Random(repr((seed, tuple(members[stratum].iloc[0]))))
        chosen = rng.sample(range(len(members)), min(per_stratum, len(members)))
        return members.iloc[sorted(chosen)]

    keyed = df.withColumn("_s", F.to_json(stratum))
    return keyed.groupBy("_s").applyInPandas(draw, keyed.schema).drop("_s")


class Provider(Protocol):
    """What answers for one record: a prompt or a struct in, a JSON text out. It runs on executors, once a batch."""

    def __call__(self, requests: list[dict]) -> list[str]: ...


def answered(requests: DataFrame, key: str, provider: Callable[[list[dict]], list[str]], allow_live: bool = False, replay: DataFrame | None = None) -> DataFrame:
    """(key, answer) of each request: replayed by a join where answers are given, else by a provider in batches of rows. A live
    provider must be allowed; a request without a replayed answer has a null one."""
    if replay is not None:
        return requests.select(key).join(replay.select(key, "answer"), key, "left")
    if not allow_live:
        raise PermissionError("only replayed answers are allowed")
    kind = dict(requests.dtypes)[key]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield pd.DataFrame({key: p[key], "answer": provider(p.to_dict("records"))})

    return requests.mapInPandas(ask, f"{key} {kind}, answer string")
