"""Near-duplicate sources: an exact join on the Jaccard similarity of word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .longitudinal import checkpointed


def similar_texts(texts: DataFrame, key: str, text: str, words: int = 5, level: float = 0.8, crowd: int = 4096) -> DataFrame:
    """(key, class_id, links) of every row: class_id is the smallest key with the same set of shingles, links the number of
    other classes at `level` or more. Shingles are of lower-case words parted by white space (a text of fewer words is one
    shingle; null or blank text has none and links nothing).

    Two sets of similarity s share one of the rarest n - ceil(s n) + 1 shingles of each, so only those meet in the join;
    then whole sets are compared. Equal sets count once, so groups of copies make no pairs; a shingle of over `crowd` classes
    is compared block by block, so it is many tasks."""
    parts = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    last = F.greatest(F.size("w") - words + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, words), " ")))
    sets = texts.select(F.col(key).alias("k"), parts.alias("w")).select("k", F.when(F.size("w") > 0, F.array_sort(F.array_distinct(shingles))).otherwise(F.array().cast("array<long>")).alias("s"))
    sets = checkpointed(sets.withColumn("h", F.sha2(F.array_join(F.col("s").cast("array<string>"), ","), 256)))
    classes = checkpointed(sets.groupBy("h").agg(F.min("k").alias("c"), F.min_by("s", "k").alias("s")))
    token = classes.select("c", F.size("s").alias("n"), F.explode("s").alias("t"))
    seen = token.groupBy("t").agg(F.count("*").alias("f"))
    place = F.row_number().over(W.partitionBy("c").orderBy("f", "t"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(level) - F.lit(1e-9)) + 1
    rare = token.join(seen, "t").where("f > 1").withColumn("p", place)
    # Shingles of one class only can't meet another's: they are the rarest, so they use up places before the rest.
    alone = token.join(seen.where("f = 1"), "t").groupBy("c").agg(F.count("*").alias("alone"))
    at = F.col("p") + F.coalesce("alone", F.lit(0))
    rare = rare.join(alone, "c", "left").withColumn("p", at).where(F.col("p") <= keep).select("c", "n", "t", "p", "f")
    rare = in_cells(rare, "c", "t", "f", crowd)
    a, b = (rare.select("t", "cell", F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    # Sizes must be near, and from the first common shingle on enough of either set must be left.
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(level) - F.lit(1e-9))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    pairs = a.join(b, ["t", "cell"]).where(near & (left * F.lit(1 + level) >= (F.col("na") + F.col("nb")) * F.lit(level) - F.lit(1e-6))).select("a", "b").distinct()
    both = pairs.join(classes.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(classes.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.where(common >= F.lit(level) * (F.size("sa") + F.size("sb") - common) - F.lit(1e-9)).select("a", "b")
    count = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    member = sets.select("k", "h").join(classes.select("h", "c"), "h").join(count, "c", "left")
    return member.select(F.col("k").alias(key), F.col("c").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def in_cells(entries: DataFrame, owner: str, key: str, count: str, crowd: int) -> DataFrame:
    """entries with a `cell`, so that any two of one key share exactly one: those of a key with more than `crowd` entries are
    dealt into blocks by their owner's hash, and each block meets each other and itself in a cell of its own."""
    blocks = F.greatest(F.ceil(F.col(count) / crowd), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(owner, key), blocks)
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j.cast("long")) * blocks + F.greatest(own, j.cast("long")))
    return entries.withColumn("cell", F.explode(cells))
