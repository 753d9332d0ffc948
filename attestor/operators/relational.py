"""Operators on keyed, dated records. All take column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def best_per_key(df: DataFrame, keys: list[str], order: list[str], latest: bool = True) -> DataFrame:
    """One row per key: the greatest (or least) of `order` columns; nulls lose. The planner limits each key to one row before
    the shuffle (a partial group limit), so a hot key costs one row a task. Columns keep their order."""
    by = [F.col(o).desc_nulls_last() if latest else F.col(o).asc_nulls_last() for o in order]
    return ranked(df, keys, by, "_place").where("_place = 1").drop("_place")


def superseded(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that best_per_key drops, each with the `order` values of the row that replaces it."""
    winner = best_per_key(df, keys, order).select(*keys, *[F.col(o).alias(f"kept_{o}") for o in order])
    same = [F.col(o).eqNullSafe(F.col(f"kept_{o}")) for o in order]
    keep = same[0]
    for s in same[1:]:
        keep = keep & s
    return df.join(winner, keys).where(~keep)


def leak_status(records: DataFrame, evidence: DataFrame, key: str, date: str, cutoff: Column) -> DataFrame:
    """One status a record: no evidence, any evidence after the (inclusive) cutoff fails the whole packet, else packet."""
    seen = evidence.groupBy(key).agg(F.count("*").alias("passages"), F.sum(F.when(F.col(date).isNull(), 1).otherwise(0)).alias("undated"), F.max(date).alias("latest"))
    status = (
        F.when(F.coalesce("passages", F.lit(0)) == 0, "NO_PASSAGES").when(F.col("undated") > 0, "INVALID_PASSAGE").when(F.col("latest") > cutoff, "TEMPORAL_LEAKAGE").otherwise("PACKET")
    )
    return records.join(seen, key, "left").withColumn("status", status).drop("undated", "latest")


def as_of(facts: DataFrame, registry: DataFrame, keys: list[str], at: str, since: str, value: str, bucket: str = "day") -> DataFrame:
    """facts with the registry's latest `value` on or before `at`: both sides are one ordered stream per key, so
    there is no range join. Registry rows come before facts of the same instant; of two on one date the greater value wins.
    Streams are cut into buckets of time, so that a key with very many rows is many windows; each bucket begins with the last
    value of the buckets before it, of which there is one row each."""
    right = registry.select(*keys, F.col(since).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    left = facts.withColumns({"_t": F.col(at), "_v": F.lit(None).cast(dict(registry.dtypes)[value]), "_side": F.lit(1)})
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, "_t"))
    inside = W.partitionBy(*keys, "_b").orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    known = F.when((F.col("_side") == 0) & F.col("_v").isNotNull(), F.struct("_t", "_v"))
    ends = both.groupBy(*keys, "_b").agg(F.max(known)["_v"].alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    names = {k: f"_k{i}" for i, k in enumerate((*keys, "_b"))}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = both.join(carried.withColumnsRenamed(names), reduce(lambda x, y: x & y, same), "left").drop(*names.values())
    found = joined.withColumn(value, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carried")))
    return found.where("_side = 1").drop("_t", "_v", "_side", "_b", "_carried")


def in_validity(facts: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Equi-join on keys with a residual range; an open end is still valid."""
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return facts.join(spans, keys).where(inside)


def containing(texts: DataFrame, quotes: DataFrame, text: str, quote: str, text_key: str, quote_key: str) -> DataFrame:
    """Pairs whose text contains the quote. The longest word inside the quote (not its first or last, which may be cut)
    must be a word of the text: words meet by their text's key alone, and a text is fetched for its distinct candidates only.
    Quotes of fewer than three words have no such word and are compared with every text. Both keys are unique."""
    words = F.split(F.col(quote), r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    anchor = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = quotes.withColumn("_w", F.when(F.size(words) > 2, anchor))
    spread = texts.select(text_key, F.explode(F.array_distinct(F.split(F.col(text), r"\s+"))).alias("_w"))
    met = spread.join(keyed.where("_w is not null").select(quote_key, "_w"), "_w").select(text_key, quote_key)
    hit = met.join(keyed.drop("_w"), quote_key).join(texts, text_key).where(F.contains(text, quote))
    short = texts.join(keyed.where("_w is null").drop("_w"), F.contains(text, quote))
    return hit.unionByName(short)


def line_starts(lines: Column) -> Column:
    """Of an array of texts that one character parts, where each begins. Sums go by blocks of the square root of their number,
    inside the row: no shuffle or sort, and no array is copied for each line."""
    lengths = F.transform(lines, lambda x: (F.length(x) + 1).cast("long"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    sized = F.array(F.struct(lengths.alias("n"), F.greatest(F.ceil(F.sqrt(F.size(lines))).cast("int"), F.lit(1)).alias("b")))
    cut = F.transform(sized, lambda z: F.transform(F.sequence(F.lit(0), F.greatest((F.size(z["n"]) - 1) / z["b"], F.lit(0)).cast("int")), lambda i: F.slice(z["n"], i * z["b"] + 1, z["b"])))
    summed = F.transform(cut, lambda blocks: F.struct(blocks.alias("blocks"), F.transform(blocks, total).alias("sums")))
    based = F.transform(summed, lambda z: F.transform(z["blocks"], lambda block, i: F.struct(block.alias("block"), total(F.slice(z["sums"], 1, i)).alias("base"))))
    return F.flatten(F.transform(F.flatten(based), lambda z: F.transform(z["block"], lambda _, j: z["base"] + total(F.slice(z["block"], 1, j)))))


def latest_overlay(cases: DataFrame, log: DataFrame, key: str, order: str, derived: str, final: str, decision: str) -> DataFrame:
    """Final value and review status of each case by the last log record of its key."""
    last = best_per_key(log, [key], [order]).select(key, F.col(final).alias("_f"), F.col(decision).alias("_d"))
    d = F.col("_d")
    status = (
        F.when(d.isNull(), "unreviewed").when(d == "ONTOLOGY_CHANGE_REQUIRED", "ontology_question").when(d == "REMAIN_UNCERTAIN", "ambiguous")
        .when(F.col("_f") != F.col(derived), "overridden").otherwise("approved")
    )
    value = F.when(d.isNull() | (d == "ONTOLOGY_CHANGE_REQUIRED"), F.col(derived)).when(d == "REMAIN_UNCERTAIN", "UNCERTAIN").otherwise(F.col("_f"))
    return cases.join(last, key, "left").withColumns({"final_value": value, "review_status": status}).drop("_f", "_d")


def stratified_sample(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int) -> DataFrame:
    """k rows a stratum in the order of a keyed hash: reproducible, and independent of the input's order."""
    if per_stratum < 1:
        raise ValueError("per_stratum must be at least 1")
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), *strata, F.col(key).cast("string")), 256)
    return ranked(df.withColumn("draw", draw), strata, [F.col("draw"), F.col(key)], "place").where(F.col("place") <= per_stratum)


def findings(gate: str, bad: DataFrame, key: str, severity: str = "critical") -> DataFrame:
    return bad.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("subject"))


def unresolved(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def sections_present(df: DataFrame, key: str, section: str) -> DataFrame:
    return df.groupBy(key).agg(F.collect_set(section).alias("present"))


def entry_exit(panel: DataFrame, unit: str, period: str, value: str) -> DataFrame:
    """Each unit in consecutive periods: entry, exit or continuing, with both values (a full outer join on the unit)."""
    now = panel.select(unit, F.col(period).alias("period"), F.col(value).alias("now"))
    before = panel.select(unit, (F.col(period) + 1).alias("period"), F.col(value).alias("before"))
    kind = F.when(F.col("before").isNull(), "entry").when(F.col("now").isNull(), "exit").otherwise("continuing")
    return now.join(before, [unit, "period"], "full_outer").withColumn("kind", kind)


def weighted_mean(value: str, weight: str) -> Column:
    """Weights count only where the value is known."""
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def wilson_upper(bad: Column, n: Column, z: float = 1.96) -> Column:
    p = bad / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
