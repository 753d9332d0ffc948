"""Best-fit packing of token sequences by patterns of lengths.

Documents become pieces of at most `capacity` tokens. Their length histogram (at most `capacity` numbers) goes
to the driver, which enumerates patterns of a few lengths that fill a sequence, fits repeat counts to the
histogram by non-negative least squares, rounds them down, and packs what is left by best fit over the
histogram. Each piece has a rank among its length's pieces; the plan maps (length, rank) to a sequence and an
offset. Ranks come from counts of chunks of pieces, so no length's pieces meet in one task.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are pieces of their own;
a null doc_id is kept; an empty table gives no pieces. Long texts are encoded whole and cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, materialize, ready, rows_of, table
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"


def pieces(docs: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None, forget: bool = False) -> DataFrame:
    """PIECES of every document, written to the shared folder; nth counts a chunk's pieces of one length. forget: a worker
    drops its cache of encoded chunks after each task, where other stages need its memory."""
    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b, c in rows_of(batches):
            ids, bounds = encoder(path).encode(c["t"], end)
            ids = ids.astype("<u4")
            rows = []
            for d, a, z in zip(c["doc_id"], bounds[:-1].tolist(), bounds[1:].tolist()):
                for k, at in enumerate(range(a, z, capacity)):
                    n = min(capacity, z - at)
                    rows.append((d, k, at - a, n, zlib.crc32(ids[at : at + n]), chunk, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 5))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"],
            )
        if forget:
            encoder(path).forget()
            give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return materialize(source.mapInArrow(cut, PIECES), "pieces")


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small: accelerated projected gradient steps with restarts."""
    gram, ab = a.T @ a, a.T @ b
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = gram @ v
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.05 * float(v @ (gram @ v)) + 1e-12)
    x = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(z - step * (gram @ z - ab), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (z - new) @ (new - x) > 0:
            t2 = 1.0
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def patterns(histogram: np.ndarray, capacity: int, most: int = 1024) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths that fill a sequence exactly, led by the most frequent lengths; three only
    where no second length completes the first, as short pieces serve the residuals best."""
    there = [int(n) for n in np.flatnonzero(histogram)]
    out = {(capacity,)} if histogram[capacity] else set()
    have = set(there)
    common = sorted(there, key=lambda n: (-histogram[n], -n))
    for n in common:
        if len(out) >= most // 2:
            break
        if capacity - n in have:
            out.add(tuple(sorted((n, capacity - n), reverse=True)))
    for n in [n for n in common if capacity - n not in have][:64]:
        for m in common[:256]:
            if len(out) >= most:
                break
            if 0 < (rest := capacity - n - m) and rest in have:
                out.add(tuple(sorted((n, m, rest), reverse=True)))
    return sorted(out, reverse=True)


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram (index: length) exactly once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if found := patterns(left, capacity):
        a = np.zeros((capacity + 1, len(found)))
        for j, p in enumerate(found):
            for n in p:
                a[n, j] += 1
        used = np.flatnonzero(a.any(axis=1))
        x = nnls(a[used], left[used].astype(float))
        for j in np.argsort(-x, kind="stable"):
            fit = min(int(x[j]), *(int(left[n] // found[j].count(n)) for n in set(found[j])))
            if fit > 0:
                out.append((found[j], fit))
                for n in found[j]:
                    left[n] -= fit
    while (top := int(left.nonzero()[0].max(initial=0))) > 0:
        pattern, space, use = [], capacity, {}
        n = top
        while n:  # the longest piece that still fits, again and again
            use[n] = use.get(n, 0) + 1
            pattern.append(n)
            space -= n
            free = left[: space + 1].copy()
            for k, u in use.items():
                if k <= space:
                    free[k] -= u
            n = int(free.nonzero()[0].max(initial=0))
        repeats = min(int(left[k] // u) for k, u in use.items())
        out.append((tuple(pattern), repeats))
        for k, u in use.items():
            left[k] -= u * repeats
    return out


def slots(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the piece of a length with rank r takes the last
    row whose first rank isn't above r, and the sequence first + r - first rank."""
    rows, used, sequence = [], {}, 0
    for pattern, repeats in found:
        at = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, at))
            used[n] = used.get(n, 0) + repeats
            at += n
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None, forget: bool = False) -> DataFrame:
    """PIECES but for chunk and nth, with sequence_id and offset (place in the sequence, gapless from 0)."""
    spark = docs.sparkSession
    cut = pieces(docs, capacity, end, path, forget)
    counts = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    counts = materialize(counts, "chunk-lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    rows = slots(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast(rows)  # some rows for each length and pattern, however many pieces there are
    before = F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("base"))
    # The bases grow with the corpus, so they are merged, never broadcast.
    ranked = cut.join(bases.hint("merge"), ["chunk", "length"]).select(*cut.columns, (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        big = np.int64(1) << 48
        keys = t[:, 0] * big + t[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            k = np.searchsorted(keys, length * big + rank, side="right") - 1
            cols = [b.column(b.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(t[k, 2] + rank - t[k, 1]), pa.array(t[k, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their places in the packed sequences."""
    return pack(docs.select("doc_id", "text"), forget=True)
