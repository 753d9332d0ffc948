"""Agreement of predictions with gold labels. A null prediction abstains. Every result starts from counts of (gold, prediction)
pairs, so the shuffle carries label pairs, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def label_counts(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn of each label, from confusion()."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), hit.alias("tp"), F.lit(0).alias("fp"), (F.col("n") - hit).alias("fn")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("tp"), (F.col("n") - hit).alias("fp"), F.lit(0).alias("fn")),
    )
    flat = pairs.select(F.explode(sides).alias("s")).select("s.*").where("label is not null")
    return flat.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def precision() -> Column:
    return F.try_divide("tp", F.col("tp") + F.col("fp"))


def recall() -> Column:
    return F.try_divide("tp", F.col("tp") + F.col("fn"))


def f1() -> Column:
    return F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def weighted_kappa(pairs: DataFrame, rank: dict[str, int]) -> DataFrame:
    """n, mean_distance and linearly weighted kappa of ranked labels; pairs with an unranked or null side don't count."""
    names = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    ranked = pairs.select(F.try_element_at(names, "gold").alias("g"), F.try_element_at(names, "pred").alias("p"), "n").where("g is not null and p is not null")
    total = ranked.agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("g") - F.col("p")) * F.col("n")).alias("seen"))
    left = ranked.groupBy("g").agg(F.sum("n").alias("a"))
    right = ranked.groupBy("p").agg(F.sum("n").alias("b"))
    chance = F.broadcast(left).crossJoin(F.broadcast(right)).agg(F.sum(F.abs(F.col("g") - F.col("p")) * F.col("a") * F.col("b")).alias("by_chance"))  # a row a label pair of the scale
    kappa = 1 - F.try_divide(F.col("seen") * F.col("n"), F.col("by_chance"))
    return total.crossJoin(chance).select("n", F.try_divide("seen", "n").alias("mean_distance"), kappa.alias("weighted_kappa"))


def abstention(pairs: DataFrame) -> DataFrame:
    """coverage: share answered; selective_risk: share wrong among the answered; false_confidence: share of all rows answered wrong."""
    answered, n = F.col("pred").isNotNull(), F.col("n")
    total = lambda test: F.sum(F.when(test, n).otherwise(0))
    out = pairs.agg(F.sum("n").alias("n"), total(answered).alias("answered"), total(answered & (F.col("gold") != F.col("pred"))).alias("wrong"))
    return out.select("n", "answered", F.try_divide("answered", "n").alias("coverage"), F.try_divide("wrong", "answered").alias("selective_risk"), F.try_divide("wrong", "n").alias("false_confidence"))
