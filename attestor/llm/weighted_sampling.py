"""Document fingerprints by consistent weighted sampling.

A text's terms are its runs of `shingle` words (A-Z in lower case; fewer words: the whole sequence), weighted by how
often they come. For term and sample number, hashes pick r and c from tables of Gamma(2, 1) draws and b from uniform
ones; the sample is the term with the least ln c - r (t - b) - r, where t = floor(ln(weight) / r + b), and its code is a
hash of (term, t). Two texts' codes agree with the probability of their generalised Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones. A fingerprint is SAMPLES codes of 16 bits in hexadecimal.

Each document's edited text ends in the beginning of the next document's. Documents are dealt to ranges of ascending
doc_id, and each range also gets the next range's first document, so texts move once.

Defined results: a null text counts as empty; texts without words share one fingerprint (all zeros), which is wholly
like itself and unlike others; a null doc_id comes before all others; rows that share a doc_id are ordered by their text's
hash; a single document is its own next; an empty table gives no rows. Long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, rows_of, split_words, table

SAMPLES, SHINGLE = 64, 3
_FIRST = -(1 << 63)
_EMPTY = np.zeros(SAMPLES, np.uint16)


@cache
def _tables() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(2015)
    r, c, b = rng.gamma(2.0, 1.0, 1 << 16), rng.gamma(2.0, 1.0, 1 << 16), rng.random(1 << 16)
    odd = rng.integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64) | np.uint64(1)
    return r.astype(np.float32), np.log(c).astype(np.float32), b.astype(np.float32), odd


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def terms(text: bytes | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, and their weights."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = xxhash.xxh64_intdigest
    w = np.array([h(x) for x in words], np.uint64)
    n = min(shingle, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(out, return_counts=True)


def signature(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """SAMPLES codes of 16 bits; zeros for a text without words."""
    h, weight = terms(text, shingle)
    if not len(h):
        return _EMPTY
    gammas, logs, uniform, odd = _tables()
    best = np.full(SAMPLES, np.inf, np.float32)
    code = np.zeros(SAMPLES, np.uint16)
    low = np.uint64(0xFFFF)
    for a in range(0, len(h), 512):
        part = h[a : a + 512, None]
        x = part * odd[0]
        x ^= x >> np.uint64(31)
        r = gammas[(x & low).astype(np.int64)]
        b = uniform[((x >> np.uint64(16)) & low).astype(np.int64)]
        value = logs[(x >> np.uint64(48)).astype(np.int64)]
        heavy = np.flatnonzero(weight[a : a + 512] > 1)
        t = np.zeros((len(part), SAMPLES), np.float32)
        if len(heavy):
            t[heavy] = np.floor(np.log(weight[a : a + 512][heavy, None].astype(np.float32)) / r[heavy] + b[heavy])
        value = value - r * (t - b + 1)
        j = value.argmin(axis=0)
        k = np.arange(SAMPLES)
        won = value[j, k] < best
        best[won] = value[j, k][won]
        made = _mix(part[j, 0] * odd[1] + t[j, k].astype(np.int64).astype(np.uint64)) >> np.uint64(48)
        code[won] = (made[won] | np.uint64(1)).astype(np.uint16)  # zero is the empty text's
    return code


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(code: np.ndarray) -> str:
    return code.astype(">u2").tobytes().hex()


def _row(text: str, sig: np.ndarray, other: str, other_sig: np.ndarray, shingle: int) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + other[:half]).encode()
    edited_sig = signature(edited, shingle)
    return len(text), hashlib.sha256(edited).hexdigest(), as_text(sig), as_text(edited_sig), likeness(sig, edited_sig), likeness(sig, other_sig)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, shingle: int = SHINGLE, ranges: int | None = None) -> DataFrame:
    """OUT for every document."""
    spark = ready(docs.sparkSession)
    n = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(_FIRST))
    cuts = source.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= key)) if cuts else F.lit(0)
    keyed = source.select("doc_id", "text", bucket.cast("int").alias("b"), key.alias("k"))
    firsts = [(r["b"], r["k"]) for r in keyed.groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()]  # one row for each range
    follows = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]  # the first document follows the last range's
    guests = spark.createDataFrame(follows, "k long, guest int")
    marked = keyed.join(F.broadcast(guests), "k", "left")
    places = F.when(F.col("guest").isNull(), F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("g")), F.struct(F.col("guest").alias("b"), F.lit(True).alias("g")))
    )
    dealt = marked.select("doc_id", "text", "k", F.explode(places).alias("p")).select("doc_id", "text", "k", "p.b", "p.g")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("b")).sortWithinPartitions("b", "g", "k", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, c in rows_of(batches, 256):
            rows = []
            for d, text, g in zip(c["doc_id"], c["text"], c["g"]):
                if g and held is None:
                    continue
                sig = signature(text.encode(), shingle)
                if held is not None:
                    rows.append((held[0], *_row(held[1], held[2], text, sig, shingle)))
                held = None if g else (d, text, sig)
            if rows:
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], [x.split()[0] for x in OUT.split(", ")])

    return dealt.select("doc_id", "text", "g").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
