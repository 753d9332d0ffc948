"""Token-ID output, compressed by a Re-Pair grammar per shard.

A shard is a run of documents in ascending doc_id order. Its ids are one sequence, in which the most frequent pairs
of neighbouring symbols become nonterminals (rules) again and again, where a symbol that two chosen pairs claim goes to the
more frequent one. The frequency that a pair needs falls in steps down to `least`; at each step rounds go on until no
pair has it, and each looks only at places whose pairs were frequent before or hold a new symbol.

File format, little-endian: magic "RPR2"; u32 counts of terminals' bound, rules, symbols, documents; u64 tokens; then
the rules' left and right symbols, u32 expansion length of each rule, u32 tokens before every STEP-th symbol, u32
tokens of each document, and the symbols. Symbols below the bound are ids; bound + k is rule k. An array of symbols
is written as their low 16 bits (u16), then each higher bit that the grammar needs as a plane of packed bits. So the
symbols of a range of tokens are found by the marks and read alone, and expand by the rules. Files are rows of a
Parquet table (part, shard, doc_ids, tokens, payload) in the shared folder, which any Hadoop file system can hold.

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows that share a doc_id are
ordered by their text's hash; an empty table has no files. Long texts are encoded whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ready, rows_of, table
from .tokens import encoder

MAGIC, HEADER, STEP = b"RPR2", struct.Struct("<IIIIQ"), 1024
_BITS, _MIX = 20, np.uint64(0x9E3779B97F4A7C15)


def _ranked(s: np.ndarray, at: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places, those whose pair comes `need` times among them; their pairs' ranks (0: most frequent), and the pairs."""
    key = (s[at] << 32) | s[at + 1]
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(np.append(first, len(ranked)))
    often = np.flatnonzero(times >= need)
    often = often[np.argsort(-times[often], kind="stable")]
    rank_of = np.full(len(first), -1)
    rank_of[often] = np.arange(len(often))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.repeat(rank_of, times)
    keep = rank >= 0
    return at[keep], rank[keep], ranked[first[often]]


def _disjoint(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the ascending places don't overlap a place of a lower rank; of a run of one pair every other."""
    none = np.iinfo(np.int32).max
    beside = np.diff(at) == 1
    before, after = np.full(len(at), none), np.full(len(at), none)
    before[1:][beside], after[:-1][beside] = rank[:-1][beside], rank[1:][beside]
    take = (rank < before) & (rank < after)
    run = np.flatnonzero((rank == before) | (rank == after))
    if len(run):
        first = np.concatenate([[True], (np.diff(at[run]) > 1) | (rank[run[1:]] != rank[run[:-1]])])
        own = np.cumsum(first) - 1
        begin = run[first][own]
        end = run[np.concatenate([first[1:], [True]])][own]
        best = (rank[run] < before[begin]) & (rank[run] < after[end])
        take[run[best & ((run - begin) % 2 == 0)]] = True
    return take


def compress(ids: np.ndarray, bound: int, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n x 2), expansion lengths, and the sequence, once no pair comes `least` times (runs of one symbol overlap
    themselves, so theirs counts every other place)."""
    s, need = ids.astype(np.int64), 0
    rules: list[np.ndarray] = []
    size = np.ones(bound, np.int64)
    while len(s) > 1 and need != least:
        slot = ((((s[:-1] << 32) | s[1:]).astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int32)
        bins = np.bincount(slot, minlength=1 << _BITS)  # a pair's bin counts at least as much as the pair
        need = max(least, need // 3 or int(bins.max()) // 2)
        at = np.flatnonzero((bins >= need)[slot])
        while len(at):
            at, rank, pairs = _ranked(s, at, need)
            take = _disjoint(at, rank)
            made = np.flatnonzero(np.bincount(rank[take], minlength=len(pairs)) >= 2)
            if not len(made):
                break
            new = np.full(len(pairs), -1, np.int64)
            new[made] = len(size) + np.arange(len(made))
            two = np.column_stack([pairs[made] >> 32, pairs[made] & 0xFFFFFFFF])
            rules.append(two)
            size = np.concatenate([size, size[two].sum(axis=1)])
            take &= new[rank] >= 0
            done = at[take]
            s[done] = new[rank[take]]
            keep = np.ones(len(s), bool)
            keep[done + 1] = False
            s = s[keep]
            # Only pairs that were frequent already, or hold a new symbol, can be frequent now.
            rest = at[~take]
            rest = rest[keep[rest]]
            now = done - np.arange(len(done))
            rest = rest - np.searchsorted(done, rest)
            mark = np.zeros(len(s), bool)
            mark[rest] = mark[now] = mark[np.maximum(now - 1, 0)] = True
            mark[-1] = False
            at = np.flatnonzero(mark)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), size[bound:], s


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges in order."""
    stops = np.cumsum(lengths)
    return np.repeat(starts - stops + lengths, lengths) + np.arange(int(stops[-1]) if len(stops) else 0)


class Grammar:
    """Expansions of all symbols in one pool: first the ids, then the rules'."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, bound: int):
        self.sizes = np.concatenate([np.ones(bound, np.int64), lengths])
        self.at = np.cumsum(self.sizes) - self.sizes
        self.pool = np.empty(int(self.sizes.sum()), np.uint32)
        self.pool[:bound] = np.arange(bound)
        done = np.arange(len(self.sizes)) < bound
        todo = np.arange(len(rules))
        while len(todo):
            can = done[rules[todo]].all(axis=1)
            if not can.any():
                raise ValueError("a rule refers to itself")
            now = todo[can]
            self.pool[_ranges(self.at[bound + now], lengths[now])] = self.expand(rules[now].ravel())
            done[bound + now] = True
            todo = todo[~can]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[_ranges(self.at[symbols], self.sizes[symbols])]


def _planes(symbols: np.ndarray, width: int) -> bytes:
    low = symbols.astype("<u2", casting="unsafe").tobytes()
    return low + b"".join(np.packbits((symbols >> b) & 1 != 0, bitorder="little").tobytes() for b in range(16, width))


def _planes_size(n: int, width: int) -> int:
    return 2 * n + (max(width, 16) - 16) * ((n + 7) // 8)


def _from_planes(data: memoryview, n: int, width: int, a: int, b: int) -> np.ndarray:
    """Symbols a..b of n (a: a multiple of 8)."""
    out = np.frombuffer(data[2 * a : 2 * b], "<u2").astype(np.int64)
    for k in range(16, width):
        at = 2 * n + (k - 16) * ((n + 7) // 8)
        out |= np.unpackbits(np.frombuffer(data[at + a // 8 : at + (b + 7) // 8], np.uint8), count=b - a, bitorder="little").astype(np.int64) << k
    return out


def write_shard(ids: np.ndarray, per_doc: list[int], **args) -> bytes:
    bound = int(ids.max()) + 1 if len(ids) else 1
    rules, lengths, symbols = compress(ids, bound, **args)
    width = (bound + len(rules) - 1).bit_length()
    sizes = np.concatenate([np.ones(bound, np.int64), lengths])[symbols]
    marks = (np.cumsum(sizes) - sizes)[::STEP]
    head = MAGIC + HEADER.pack(bound, len(rules), len(symbols), len(per_doc), len(ids))
    numbers = b"".join(np.asarray(x).astype("<u4").tobytes() for x in (lengths, marks, per_doc))
    return head + _planes(rules[:, 0], width) + _planes(rules[:, 1], width) + numbers + _planes(symbols, width)


class Shard:
    """A shard's file, read for random access."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("no RPR2 shard")
        data = memoryview(payload)
        self.bound, r, self.n, d, self.tokens = HEADER.unpack_from(payload, 4)
        self.width = (self.bound + r - 1).bit_length()
        at, sides = 4 + HEADER.size, []
        for _ in range(2):
            size = _planes_size(r, self.width)
            sides.append(_from_planes(data[at : at + size], r, self.width, 0, r))
            at += size
        marks = -(-self.n // STEP)
        numbers = np.frombuffer(data[at : at + 4 * (r + marks + d)], "<u4").astype(np.int64)
        lengths, self.marks, self.per_doc = np.split(numbers, [r, r + marks])
        self.grammar = Grammar(np.column_stack(sides), lengths, self.bound)
        self.rules = r
        self.coded = data[at + 4 * (r + marks + d) :]

    def symbols(self, a: int, b: int) -> np.ndarray:
        """Symbols a..b, read alone; a is a multiple of STEP."""
        return _from_planes(self.coded, self.n, self.width, a, b)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens start..stop, from the blocks of STEP symbols that cover them."""
        stop = self.tokens if stop is None else min(stop, self.tokens)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.marks, start, side="right")) - 1
        last = int(np.searchsorted(self.marks, stop, side="left"))
        found = self.grammar.expand(self.symbols(first * STEP, min(last * STEP, self.n)))
        return found[start - self.marks[first] : stop - self.marks[first]]


def write_files(docs: DataFrame, end: int = 2, path: str | None = None, shard_tokens: int = 1 << 20, parts: int | None = None) -> DataFrame:
    """Order, encode, compress: the table of files, as written to the shared folder. Parts ascend with doc_id."""
    spark = ready(docs.sparkSession)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        held, doc_ids, counts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = write_shard(np.concatenate(held), counts)
            ids = pa.array([doc_ids], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), ids, pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "shard", "doc_ids", "tokens", "payload"],
            )

        for b, c in rows_of(batches):
            for k in range(0, b.num_rows, 64):
                ids, bounds = encoder(path).encode(c["t"][k : k + 64], end)
                held.append(ids)
                doc_ids += c["doc_id"][k : k + 64]
                counts += np.diff(bounds).tolist()
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
                    held, doc_ids, counts, size = [], [], [], 0
                    shard += 1
        if doc_ids:
            yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    # Rows that share an id, and even equal rows, may lie in several ranges.
    keyed = source.select("*", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("m"))
    dealt = keyed.repartitionByRange(n, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m")
    return materialize(dealt.select("doc_id", "t").mapInArrow(encode, "part int, shard int, doc_ids array<long>, tokens long, payload binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()  # one row for each part
    bases, total = [], 0
    for r in sums:
        bases.append((r["part"], total))
        total += r["n"]
    spark = files.sparkSession
    base = spark.createDataFrame(bases, "part int, base long")
    within = F.sum("tokens").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    at = files.select("part", "shard", "tokens").select("part", "shard", F.coalesce(within, F.lit(0)).alias("within"))
    placed = at.join(base, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in rows_of(batches, 4):
            for part, shard, doc_ids, payload in zip(c["part"], c["shard"], c["doc_ids"], c["payload"]):
                s = Shard(payload)
                ids = s.ids().astype("<u4", copy=False)
                stops = np.cumsum(s.per_doc)
                starts = stops - s.per_doc
                crcs = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), stops.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(s.per_doc), pa.array(crcs, pa.int64())],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    rows = files.select("part", "shard", "doc_ids", "payload").mapInArrow(decode, schema)
    return rows.join(placed, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents").select("doc_id", "text")))
