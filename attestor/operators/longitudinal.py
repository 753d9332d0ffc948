"""Entities across periods: predecessors, splits and merges, aliases, decomposition of change."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def predecessors(now: DataFrame, before: DataFrame, block: list[str], key: str, order: list[Column], score: Column, keep: int) -> DataFrame:
    """The `keep` best predecessors of each row of `now` among the rows of `before` in its block. `before` has the same block
    columns, shifted by one period; its other columns, `score` and `order` are the caller's. The block must be fine enough
    that it holds few rows: candidates are an equi-join on it."""
    pairs = now.join(before, block).withColumn("score", score)
    place = F.row_number().over(W.partitionBy(*block, key).orderBy(F.col("score").desc(), *order))
    return pairs.withColumn("place", place).where(F.col("place") <= keep)


def link_kinds(links: DataFrame, block: list[str], key: str, other: str) -> DataFrame:
    """Each link's kind by how many links its two ends have: continuation, split, merge or many_to_many."""
    outs, ins = F.count("*").over(W.partitionBy(*block, other)), F.count("*").over(W.partitionBy(*block, key))
    both = links.withColumns({"out_links": outs, "in_links": ins})
    kind = (
        F.when((F.col("out_links") > 1) & (F.col("in_links") > 1), "many_to_many")
        .when(F.col("out_links") > 1, "split").when(F.col("in_links") > 1, "merge").otherwise("continuation")
    )
    return both.withColumn("kind", kind)


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's folder; one is set only where none is."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def alias_components(entities: DataFrame, key: str, names: list[str], most: int = 64) -> DataFrame:
    """(key, component): entities that share a value of any of `names`, directly or by way of others; component is the
    smallest key reachable. Null names link nothing. Each round takes minima by name (an aggregate: a common name is combined
    before the shuffle and no pairs are made), then follows labels once more, so rounds grow with the logarithm of a chain."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).cast("string").alias("v")) for i, n in enumerate(names)))
    edges = checkpointed(entities.select(F.col(key).alias("node"), F.explode(pairs).alias("name")).where("name.v is not null").distinct())
    labels = checkpointed(entities.select(F.col(key).alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(most):
        least = edges.join(labels, "node").groupBy("name").agg(F.min("label").alias("m"))
        seen = edges.join(least, "name").groupBy("node").agg(F.min("m").alias("m"))
        once = labels.join(seen, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("next"), "label")
        once = checkpointed(once)
        jump = once.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = checkpointed(once.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("further", "next")).alias("l")))
        labels = new.select("node", F.col("l").alias("label"))
        if new.where("l <> label").isEmpty():
            return labels.select(F.col("node").alias(key), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def decompose(panel: DataFrame, unit: str, period: str, value: str, weight: str) -> DataFrame:
    """Change of the weighted mean between consecutive periods, split into within, mix, entry and exit; they add up to it.
    Weights are made shares of their period."""
    shares = panel.withColumn("_s", F.col(weight) / F.sum(weight).over(W.partitionBy(period)))
    now = shares.select(unit, F.col(period).alias("period"), F.col(value).alias("x1"), F.col("_s").alias("w1"))
    old = shares.select(unit, (F.col(period) + 1).alias("period"), F.col(value).alias("x0"), F.col("_s").alias("w0"))
    both = now.join(old, [unit, "period"], "full_outer")
    x0, x1, w0, w1 = (F.col(c) for c in ("x0", "x1", "w0", "w1"))
    stays = x0.isNotNull() & x1.isNotNull()
    total = lambda test, e: F.sum(F.when(test, e).otherwise(0.0))
    out = both.groupBy("period").agg(
        total(stays, w0 * (x1 - x0)).alias("within"), total(stays, (w1 - w0) * x1).alias("mix"), total(x0.isNull(), w1 * x1).alias("entry"), total(x1.isNull(), -w0 * x0).alias("exit"),
        (F.sum(F.coalesce(w1 * x1, F.lit(0.0))) - F.sum(F.coalesce(w0 * x0, F.lit(0.0)))).alias("change"), F.count("x0").alias("had"), F.count("x1").alias("has"),
    )
    return out.where("had > 0 and has > 0").drop("had", "has")


def decompose_roles(panel: DataFrame, unit: str, role: str, period: str, value: str, weight: str) -> DataFrame:
    """As decompose, over units with roles: within a unit's roles, the shift between its roles (role), the shift between units
    (mix), entry and exit of units, and coverage (units that are there in both periods but measured in one). A null value isn't
    measured and has no weight. The parts add up to the change."""
    there = panel.select(unit, period).distinct()
    known = panel.where(F.col(value).isNotNull())
    total = known.groupBy(period).agg(F.sum(weight).alias("_total"))
    own = known.groupBy(unit, period).agg(F.sum(weight).alias("_own"))
    cells = known.join(own, [unit, period]).join(total, period).select(
        unit, role, F.col(period).alias("period"), F.col(value).alias("x"), (F.col("_own") / F.col("_total")).alias("s"), (F.col(weight) / F.col("_own")).alias("rho")
    )
    by_unit = cells.groupBy(unit, "period").agg(F.max("s").alias("s"), F.sum(F.col("rho") * F.col("x")).alias("x"))
    shifted = lambda d, names: d.select(unit, *[c for c in d.columns if c in (role,)], (F.col("period") + 1).alias("period"), *(F.col(a).alias(b) for a, b in names))
    units = by_unit.select(unit, "period", F.col("s").alias("s1"), F.col("x").alias("X1")).join(shifted(by_unit, (("s", "s0"), ("x", "X0"))), [unit, "period"], "full_outer")
    now, old = there.select(unit, F.col(period).alias("period"), F.lit(True).alias("here")), there.select(unit, (F.col(period) + 1).alias("period"), F.lit(True).alias("before"))
    units = units.join(now, [unit, "period"], "left").join(old, [unit, "period"], "left")
    s0, s1, stays = F.col("s0"), F.col("s1"), F.col("s0").isNotNull() & F.col("s1").isNotNull()
    add = lambda test, e: F.sum(F.when(test, e).otherwise(0.0))
    gained, lost = s1 * F.col("X1"), s0 * F.col("X0")
    outer = units.groupBy("period").agg(
        add(stays, (s1 - s0) * F.col("X1")).alias("mix"), add(s0.isNull() & F.col("before").isNull(), gained).alias("entry"), add(s1.isNull() & F.col("here").isNull(), -lost).alias("exit"),
        (add(s0.isNull() & F.col("before").isNotNull(), gained) + add(s1.isNull() & F.col("here").isNotNull(), -lost)).alias("coverage"),
        (F.sum(F.coalesce(gained, F.lit(0.0))) - F.sum(F.coalesce(lost, F.lit(0.0)))).alias("change"), F.count("s0").alias("had"), F.count("s1").alias("has"),
    )
    roles = cells.select(unit, role, "period", F.col("x").alias("x1"), F.col("rho").alias("r1")).join(shifted(cells, (("x", "x0"), ("rho", "r0"))), [unit, role, "period"], "full_outer")
    roles = roles.join(units.where(stays).select(unit, "period", "s0"), [unit, "period"])
    both = F.col("x1").isNotNull() & F.col("x0").isNotNull()
    moved = F.col("r0") * (F.col("x1") - F.col("x0"))
    whole = F.coalesce(F.col("r1") * F.col("x1"), F.lit(0.0)) - F.coalesce(F.col("r0") * F.col("x0"), F.lit(0.0))
    inner = roles.groupBy("period").agg(add(both, s0 * moved).alias("within"), F.sum(s0 * (whole - F.when(both, moved).otherwise(0.0))).alias("role"))
    return outer.where("had > 0 and has > 0").drop("had", "has").join(inner, "period")
