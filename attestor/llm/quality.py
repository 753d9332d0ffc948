"""Quality by a sparse rule ensemble: paths of boosted shallow trees over text statistics become
conjunctive rules, a lasso logistic regression keeps a few, and those become one Spark expression.

Defined results: a null or empty text has statistics of zero and is scored like any other; repeated
rows get equal scores, one each; null labels aren't used; a document labelled twice counts once with
its lowest label; without labels every score is 0.5. Long texts are read whole. Labels, lang, source
and doc_id are no inputs of a score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, ready, remainder, table
from .linear import logistic, sigmoid

STATS = (
    "chars", "words", "mean_word", "upper", "symbol", "bang", "pipe", "digit",
    "distinct_words", "repeated_word", "repeated_line", "stop_marks", "top_word", "sign_runs",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*@^~=<>{}[]\\/_+`"
_IS_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SEED = 20


def statistics(text: bytes | None) -> tuple[float, ...]:
    """STATS of one UTF-8 text; shares of its bytes, words or lines, but for the first three."""
    if not text or not (words := text.split()):
        return (float(len(text or b"")), *([0.0] * (len(STATS) - 1)))
    n, size = len(words), len(text)
    lines = text.split(b"\n")
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    gone = len(text.translate(None, _SYMBOL))
    return (
        float(size), float(n), sum(map(len, words)) / n,
        (size - len(text.translate(None, _UPPER))) / size, (size - gone) / size, text.count(b"!") / n, text.count(b"|") / n,
        (size - len(text.translate(None, _DIGIT))) / size, len(count) / n, sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), (text.count(b".") + text.count(b",")) / n, max(count.values()) / n,
        sign_runs(text) / n,
    )


def sign_runs(text: bytes) -> int:
    """Runs of three or more equal ASCII signs."""
    raw = np.frombuffer(text, np.uint8)
    third = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _IS_SIGN[raw[2:]]
    return int(third.sum() - (third[1:] & third[:-1]).sum())


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=list(STATS), dtype="float64")


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, depth: int, path: tuple, rules: list) -> np.ndarray:
    """One regression tree on gradients; adds each node's path to rules; returns the tree's values."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if path:
        rules.append(path)
    best = (1e-3 * len(g) ** 0.5, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    if depth:
        for j, at in enumerate(cuts):
            place = np.searchsorted(at, x[:, j], side="left")  # at[k - 1] < x <= at[k]
            gs, hs, ns = (np.cumsum(np.bincount(place, v, len(at) + 1))[:-1] for v in (g, h, np.ones(len(g))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            gain[(ns < 8) | (len(g) - ns < 8)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, float(at[gain.argmax()]))
    if best[1] is not None:
        left = x[:, best[1]] <= best[2]
        for side, mark in ((left, "<="), (~left, ">")):
            value[side] = _grow(x[side], g[side], h[side], cuts, depth - 1, (*path, (best[1], mark, best[2])), rules)
    return value


def fires(x: np.ndarray, rule: tuple) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, mark, at in rule:
        hit &= x[:, j] <= at if mark == "<=" else x[:, j] > at
    return hit


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, l1: float = 6e-4, most: int = 48) -> tuple[list, np.ndarray, float]:
    """Rules, their weights and the bias. x: rows of STATS."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return [], np.zeros(0), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(_SEED)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 48), method="lower")) for j in range(x.shape[1])]
    rules: list[tuple] = []
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        some = np.sort(rng.choice(len(y), max(1, len(y) * 2 // 3), replace=False))
        p = sigmoid(z)
        before = len(rules)
        _grow(x[some], (y - p)[some], (p * (1 - p))[some], cuts, depth, (), rules)
        for r in rules[before:]:  # the leaves' steps, by the rules that end there
            hit = fires(x, r)
            if not any(len(o) > len(r) and o[: len(r)] == r for o in rules[before:]):
                z[hit] += 0.3 * (y - p)[hit].sum() / ((p * (1 - p))[hit].sum() + 1.0)
    columns: dict[bytes, tuple] = {}
    for r in sorted(set(rules), key=lambda r: (len(r), r)):
        columns.setdefault(fires(x, r).tobytes(), r)
    unique = list(columns.values())
    m = np.column_stack([fires(x, r) for r in unique]).astype(np.float32) if unique else np.zeros((len(y), 0))
    w, b = logistic(m, y, l1=l1, l2=1e-5, steps=300)
    kept = [i for i in np.argsort(-np.abs(w), kind="stable")[:most] if abs(w[i]) > 1e-3]
    w, b = logistic(m[:, kept], y, l1=l1 / 4, l2=1e-5, steps=300)
    return [unique[i] for i in kept], w, b


def compile_rules(rules: list, weights: np.ndarray, bias: float, prefix: str) -> Column:
    """The ensemble's probability as a Spark expression over the struct column `prefix`."""
    z = F.lit(float(bias))
    for r, w in zip(rules, weights):
        hit = F.lit(True)
        for j, mark, at in r:
            c = F.col(f"{prefix}.{STATS[j]}")
            hit = hit & ((c <= at) if mark == "<=" else (c > at))
        z = z + F.when(hit, F.lit(float(w))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, held_remainder: int = 2, sample_rows: int = 16384) -> tuple[list, np.ndarray, float]:
    """Learns from at most sample_rows labelled documents outside the held-out remainder, chosen by a hash of the id."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != held_remainder))
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    got = rows.select("doc_id", "_y", text_statistics(F.col("text").cast("binary")).alias("s")).select("doc_id", "_y", "s.*").toPandas().sort_values("doc_id")
    return fit(got[list(STATS)].to_numpy(float), got["_y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, name: str = "quality_score", **train_args) -> DataFrame:
    """docs with the column `name` (0 to 1), which docs must not have; its own columns stay as they are."""
    ready(docs.sparkSession)
    if fresh_names(docs.columns, name) != [name]:
        raise ValueError(f"docs has a column {name} already")
    (stats,) = fresh_names([*docs.columns, name], "quality_stats")
    model = train(docs, labels, **train_args)
    with_stats = docs.withColumn(stats, text_statistics(F.col("text").cast("binary")))
    return with_stats.withColumn(name, compile_rules(*model, stats)).drop(stats)


THRESHOLD = 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored at THRESHOLD or more, with their own columns, whatever these are called."""
    (name,) = fresh_names(docs.columns, "quality_score")
    out = score(docs, table(spark, sf_dir, "labels"), name)
    return out.where(F.col(name) >= THRESHOLD).select(*docs.columns)
