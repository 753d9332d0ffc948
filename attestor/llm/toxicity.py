"""Toxicity by a classifier chain: one linear model per category, in order; each later model
also gets the earlier categories' probabilities, and is trained on out-of-fold ones.

Categories are the label columns, in the order given. A column that stands for several kinds of toxicity at once may be
preceded by `kinds` categories of its own: clusters of its positive rows by the features that tell them from the rest.
Features are chosen by each fold from its own training rows, and by the final models from all.

Defined results: a null or empty text has no features and gets the chain's bias probabilities;
repeated rows get equal results, one for each row; labels that are null, or whose document is
missing, aren't used; a document labelled twice is positive if any of its labels is, and of texts under one labelled
doc_id the smallest is learned from; where the last category has no labels of both classes, or no feature
tells them apart, every probability is 0.5 and nothing is flagged. Long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, give_back, ready, table
from .linear import logistic, sigmoid

SPACE_BITS = 20
PREFIXES = (4, 5, 6)
_TO_SPACE = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))


@dataclass(frozen=True)
class Chain:
    """names: of the categories; ids: hashed feature -> row of weights; links[k]: weights for the probabilities of the
    categories before k."""

    names: tuple
    ids: dict
    weights: np.ndarray
    bias: np.ndarray
    links: list
    threshold: float


def _hashes(word: bytes) -> list[int]:
    mask = (1 << SPACE_BITS) - 1
    return [zlib.crc32(word) & mask, *(zlib.crc32(word[:k], k) & mask for k in PREFIXES if len(word) > k)]


def distinct_words(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()) if text else set()


def text_features(text: str | None) -> list[int]:
    return sorted({h for w in distinct_words(text) for h in _hashes(w)})


def labelled(docs: DataFrame, labels: DataFrame, columns: tuple, rows: int) -> DataFrame:
    """doc_id, text and the label columns (_y0, _y1, ...) of at most `rows` labelled documents, chosen by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    marks = [f"_y{i}" for i in range(len(columns))]
    picked = known.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(m) for c, m in zip(columns, marks))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *marks).agg(F.min("text").alias("text"))


@dataclass
class Sample:
    """Labelled rows: y (rows x label columns), and of each row its hashed features, one after another."""

    y: np.ndarray
    flat: np.ndarray
    owner: np.ndarray

    def choose(self, rows: np.ndarray, most: int) -> np.ndarray:
        """The hashed features that tell the last label's classes apart best on the rows (a mask), ascending."""
        y, own = self.y[:, -1], rows[self.owner]
        flat, owner, rate = self.flat[own], self.owner[own], self.y[rows, -1].mean()
        every = np.bincount(flat, minlength=1 << SPACE_BITS)
        off = np.abs(np.bincount(flat, y[owner], 1 << SPACE_BITS) - every * rate)
        z = np.where(every >= 3, off / np.sqrt(every * rate * (1 - rate) + 1e-9), 0)
        best = np.argsort(-z, kind="stable")[:most]
        return np.sort(best[z[best] > 0])

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        place = np.full(1 << SPACE_BITS, -1)
        place[chosen] = np.arange(len(chosen))
        at = place[self.flat]
        x = np.zeros((len(self.y), len(chosen)), np.float32)
        x[self.owner[at >= 0], at[at >= 0]] = 1
        return x


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """A cluster for each row of x by k-means on rows of unit length; the first centre is the row that is least like the
    mean, each further one the row that is least like the centres before."""
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    far = [int((unit @ unit.mean(axis=0)).argmin())]
    while len(far) < k:
        far.append(int((unit @ unit[far].T).max(axis=1).argmin()))
    centers = unit[far]
    for _ in range(20):
        own = (unit @ centers.T).argmax(axis=1)
        centers = np.stack([unit[own == j].mean(axis=0) if (own == j).any() else centers[j] for j in range(k)])
        centers /= np.linalg.norm(centers, axis=1, keepdims=True) + 1e-9
    return own


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, features: int = 512, folds: int = 3, threshold: float = 0.5, columns: tuple = ("toxic",), kinds: int = 2) -> Chain:
    """sample_rows bounds what the driver gets: some hundred hashed features for each row."""
    marks = [f"_y{i}" for i in range(len(columns))]

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield pd.DataFrame({"doc_id": p["doc_id"], **{m: p[m].astype("int32") for m in marks}, "f": [text_features(t) for t in p["text"]]})

    got = labelled(docs, labels, tuple(columns), sample_rows).mapInPandas(extract, f"doc_id long, {', '.join(m + ' int' for m in marks)}, f array<int>").toArrow().sort_by("doc_id")
    lists = got["f"].combine_chunks()
    sample = Sample(np.column_stack([got[m].to_numpy().astype(float) for m in marks]), lists.flatten().to_numpy(), np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy())))
    return fit(sample, tuple(columns), features, folds, threshold, kinds)


def fit(sample: Sample, columns: tuple, features: int, folds: int, threshold: float, kinds: int) -> Chain:
    names = (*(f"kind_{j + 1}" for j in range(kinds)), *columns)
    y, n = sample.y, len(sample.y)
    rows = np.ones(n, bool)
    both = n and 0 < y[:, -1].sum() < n
    chosen = sample.choose(rows, features) if both else np.zeros(0, np.int64)
    if not len(chosen):
        return Chain(names, {}, np.zeros((0, len(names))), np.zeros(len(names)), [np.zeros(k) for k in range(len(names))], threshold)
    x, bad = sample.matrix(chosen), y[:, -1] > 0
    kind = np.full(n, -1)
    if kinds:
        kind[bad] = clusters(x[bad][:, x[bad].mean(axis=0) > x[~bad].mean(axis=0)], kinds)
    targets = np.column_stack([*((kind == j).astype(float) for j in range(kinds)), y])
    fold = np.arange(n) % folds
    able = [f for f in range(folds) if (fold == f).any() and 0 < y[fold != f, -1].sum() < (fold != f).sum()]
    weights, bias, links = [], [], []
    earlier = np.zeros((n, 0), np.float32)
    for t in targets.T:
        w, b = logistic(np.hstack([x, earlier]), t, l2=1e-4, steps=120)
        weights.append(w[: len(chosen)])
        links.append(w[len(chosen) :])
        bias.append(b)
        out = np.full(n, t.mean(), np.float32)  # where a fold's training rows are of one class
        for f in able:  # one matrix at a time, as the driver's memory is small
            held = fold == f
            xs = np.hstack([sample.matrix(sample.choose(~held, features)), earlier])
            wf, bf = logistic(xs[~held], t[~held], l2=1e-4, steps=120)
            out[held] = sigmoid(xs[held] @ wf + bf)
            del xs
        earlier = np.column_stack([earlier, out])
    give_back()
    return Chain(names, {int(h): i for i, h in enumerate(chosen)}, np.array(weights).T.reshape(len(chosen), len(names)), np.array(bias), links, threshold)


def scorer(chain: Chain) -> Callable:
    """A pandas function text -> struct of the categories' probabilities; the model is bounded (`features` rows)."""
    known: dict[bytes, tuple] = {}
    size = len(chain.names)

    def score(texts: pd.Series) -> pd.DataFrame:
        z = np.tile(chain.bias, (len(texts), 1))
        for i, text in enumerate(texts):
            hit: set[int] = set()
            for w in distinct_words(text):
                found = known.get(w)
                if found is None:
                    found = tuple(chain.ids[h] for h in _hashes(w) if h in chain.ids)
                    if len(known) < 100_000:
                        known[w] = found
                if found:
                    hit.update(found)
            if hit:
                z[i] += chain.weights[sorted(hit)].sum(axis=0)
        p = np.zeros((len(texts), size))
        for k in range(size):
            p[:, k] = sigmoid(z[:, k] + p[:, :k] @ chain.links[k])
        give_back()
        return pd.DataFrame({f"p_{c}": p[:, k] for k, c in enumerate(chain.names)})

    return F.pandas_udf(score, T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in chain.names]))


def probabilities(chain: Chain, text: Column) -> Column:
    return scorer(chain)(text)


def flag(docs: DataFrame, labels: DataFrame, name: str = "toxicity", **train_args) -> DataFrame:
    """docs with the struct column `name` (p_ and each category's name, flagged), which docs must not have."""
    ready(docs.sparkSession)
    if fresh_names(docs.columns, name) != [name]:
        raise ValueError(f"docs has a column {name} already")
    chain = train(docs, labels, **train_args)
    p = docs.withColumn(name, probabilities(chain, F.col("text")))
    return p.withColumn(name, F.col(name).withField("flagged", F.col(f"{name}.p_{chain.names[-1]}") > chain.threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = flag(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "toxicity.*").withColumn("flagged", F.col("flagged").cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain doesn't flag, with their own columns, whatever these are called."""
    (name,) = fresh_names(docs.columns, "toxicity")
    out = flag(docs, table(spark, sf_dir, "labels"), name)
    return out.where(~F.col(f"{name}.flagged")).select(*docs.columns)
