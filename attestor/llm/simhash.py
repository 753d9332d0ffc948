"""SimHash near-duplicates: 64-bit fingerprints, links at a few differing bits found by BK-trees.

Fingerprints within `radius` bits agree on at least one of radius + 1 blocks of bits, so each block's
value names a shard of fingerprints. A shard of at most SHARD fingerprints becomes one BK-tree, whose
children are keyed by their integer Hamming distance to the parent; each fingerprint walks only the edges
within the radius. A larger shard is dealt anew by blocks of its remaining bits, so no tree grows with
the corpus. Trees stay in the tasks of their shards: a broadcast of all of them would have no bound.
Links within a shard leave it as a spanning forest, which loses no connection; components over all
shards come from alternating star contractions, each written to the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like
any other; equal rows fall into one component; rows with a null doc_id get a component like others, but
a null is never a component's smallest id unless it has no other. Long texts are read whole.

The pipeline's stage links by that rule and, beyond it, by an exact Jaccard similarity of five-word shingles
(see similar and pairs); rows that share a doc_id and a text leave one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, materialize, ready, rows_of, split_words, sum_vectors, table

BITS = 64
SHARD = 512
LEVELS = 5
#: Of the search for similar sets: bands of minima find most links cheaply, an exact join of prefixes finds the rest.
BANDS, ROWS = 12, 4
#: Bits of a set's parity, and counters of shingles.
PARITY, COUNTERS = 1024, 1 << 20
#: A shingle that more sets hold is compared block by block.
CROWDED = 4096
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_values(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle in order; fewer words are one shingle, none have none."""
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), seed)] if words else [], np.uint64)
    whole, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return np.array([h(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)


def majority(values: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the values."""
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(values), 8192):
        part = values[k : k + 8192]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(values), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The majority of the shingles' XXH64 values, repeats included."""
    return majority(shingle_values(split_words(text), shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (of the text as it is), fp (the fingerprint as a signed long), written to the shared folder."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c in rows_of(batches):
            fp = np.array([fingerprint(t, shingle) for t in c["t"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("t"))
    return materialize(source.mapInArrow(run, "doc_id long, text_hash long, fp long"), "fingerprints")


class BKTree:
    """Insert-only tree of integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the values within radius."""
        if not self.values:
            return []
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> None:
        at = 0
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for every value that isn't its component's first, by one BK-tree over the shard."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _blocks(positions: list[int], parts: int) -> list[list[int]]:
    cut = [round(k * len(positions) / parts) for k in range(parts + 1)]
    return [positions[a:b] for a, b in zip(cut, cut[1:])]


def _mask(positions: list[int]) -> int:
    m = sum(1 << p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def links(distinct: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect whatever lies within radius of each other."""
    spark = distinct.sparkSession
    parts = radius + 1
    left: dict[int, list[int]] = {0: list(range(BITS))}  # path -> bits that its shards don't share
    entries = distinct.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: list[DataFrame] = []

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, a, b = None, [], [], []
        for _, c in rows_of(batches):
            for path, key, fp in zip(c["path"], c["key"], c["fp"]):
                if (path, key) != at:
                    for v, r in forest(held, radius):
                        a.append(v), b.append(r)
                    at, held = (path, key), []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            if len(a) > 10_000:
                yield _pairs(a, b)
                a, b = [], []
        for v, r in forest(held, radius):
            a.append(v), b.append(r)
        yield _pairs(a, b)

    for level in range(LEVELS):
        children: dict[int, list[int]] = {}
        masks = [0] * ((max(left) + 1) * parts + parts)
        for path, bits in left.items():
            for j, block in enumerate(_blocks(bits, parts)):
                child = path * parts + j + 1
                children[child] = [p for p in bits if p not in block]
                masks[child] = _mask([p for p in range(BITS) if p not in children[child]])
        table_of = F.array(*(F.lit(m).cast("long") for m in masks))
        entries = entries.select(F.explode(F.array(*((F.col("path") * parts + j + 1) for j in range(parts)))).alias("path"), "fp")
        entries = entries.withColumn("key", F.col("fp").bitwiseAND(F.element_at(table_of, F.col("path") + 1)))
        counts = entries.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        last = level == LEVELS - 1
        shared = materialize(entries.join(counts, ["path", "key"]).select("path", "key", "fp", "n"), f"entries-{level}")
        small = shared if last else shared.where(F.col("n") <= shard)
        dealt = small.select("path", "key", "fp").repartition(n, "path", "key").sortWithinPartitions("path", "key", "fp")
        found.append(dealt.mapInArrow(trees, "a long, b long"))
        entries = shared.where(F.col("n") > shard).select("path", "fp")
        left = children
        if last or entries.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(cols, ["a", "b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge; columns a and b hold nodes of one type.

    Large-star and small-star contractions alternate until nothing changes. Minima are aggregated and
    joined back, so a node with very many neighbours is never gathered in one task.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "star-0")
    before = None
    for k in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"star-{k}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clusters(docs: DataFrame, shingle: int = 3, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (doc_id, text_hash, fp), and fp -> component_id (its smallest doc_id)."""
    fps = fingerprints(docs, shingle)
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps, placed.join(whole, "root").select("fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, found = clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def minima(values: np.ndarray) -> np.ndarray:
    """The least value under each of BANDS * ROWS hash functions."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 4096):
        v = (values[None, k : k + 4096] ^ _SEEDS[:, None]) * _ODD
        v ^= v >> np.uint64(29)
        v *= _ODD
        np.minimum(low, v.min(axis=1), out=low)
    return low


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    return np.unique(shingle_values(split_words(text), shingle))


def parity(values: np.ndarray) -> np.ndarray:
    """Longs of PARITY bits, each the parity of the values that fall on it: sets differ in at least as many members as bits."""
    odd = np.bincount((values % PARITY).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Of each row: doc_id, text_hash, node (a 128-bit hash of its words in order), fp (three-word fingerprint), and of its
    set of `shingle`-word shingles a 128-bit hash (whole), the size n, the parity bits and the keys of bands of minima."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c in rows_of(batches):
            node, fp, whole, n, bits, bands = [], [], [], [], [], []
            for t in c["t"]:
                words = split_words(t)
                node.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fp.append(majority(shingle_values(words, 3)))
                values = shingle_set(t, shingle)
                whole.append(xxhash.xxh3_128_digest(values.tobytes()))
                n.append(len(values))
                bits.append(parity(values).tolist())
                low = minima(values)
                keys = [xxhash.xxh64_intdigest(low[j * ROWS : (j + 1) * ROWS].tobytes(), j) for j in range(BANDS if words else 0)]
                bands.append(np.array(keys, np.uint64).view(np.int64).tolist())
            more = [pa.array(node, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(whole, pa.binary()), pa.array(n, pa.int32())]
            more += [pa.array(x, pa.list_(pa.int64())) for x in (bits, bands)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], ["doc_id", "text_hash", "node", "fp", "whole", "n", "bits", "bands"])

    out = "doc_id long, text_hash long, node binary, fp long, whole binary, n int, bits array<long>, bands array<long>"
    return materialize(_keyed(docs).mapInArrow(run, out), "sketches")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("t"))


def frequencies(docs: DataFrame, shingle: int = 5) -> np.ndarray:
    """COUNTERS sums of the rows' shingles by the shingle's leading bits: never less than the rows that hold a shingle.

    They only order shingles (any order that all texts share gives the same links), so their number needn't grow."""
    ready(docs.sparkSession)
    block = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for _, c in rows_of(batches):
            seen += np.bincount(_counter(np.concatenate([shingle_set(t, shingle) for t in c["t"]])), minlength=COUNTERS)
        seen = seen.astype(np.float32).reshape(-1, block)  # exact below 2^24, and larger counts stay large
        used = np.flatnonzero(seen.any(axis=1))
        part = TaskContext.get().partitionId()
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([seen[i].tobytes() for i in some], pa.binary())], ["part", "block", "v"])

    texts = docs.select(F.col("text").cast("binary").alias("t"))
    sent = texts.mapInArrow(count, "part long, block int, v binary")
    out = np.zeros((COUNTERS // block, block), np.float32)
    for r in materialize(sum_vectors(sent.select("part", "block", "v"), texts.rdd.getNumPartitions(), np.float32), "frequencies").collect():
        out[r.block] = np.frombuffer(r.v, np.float32)
    return out.ravel()


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefixes(docs: DataFrame, shingle: int = 5, level: float = 0.8) -> DataFrame:
    """Of each set of shingles, by its hash (whole): the rarest n - ceil(level n) + 1 in the order of frequencies(), and how
    many of them at most CROWDED rows hold for certain (cool; they come first)."""
    seen = docs.sparkSession.sparkContext.broadcast(frequencies(docs, shingle))
    crowded = CROWDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in rows_of(batches):
            whole, prefix, cool = [], [], []
            for t in c["t"]:
                values = shingle_set(t, shingle)
                often = seen.value[_counter(values)]
                first = np.lexsort((values, often))[: len(values) - int(np.ceil(level * len(values) - 1e-9)) + 1]
                whole.append(xxhash.xxh3_128_digest(values.tobytes()))
                prefix.append(values[first].view(np.int64))
                cool.append(int((often[first] <= crowded).sum()))
            columns = [pa.array(whole, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(cool, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["whole", "prefix", "cool"])

    texts = docs.select(F.col("text").cast("binary").alias("t"))
    return texts.mapInArrow(run, "whole binary, prefix array<long>, cool int").dropDuplicates(["whole"])


def _may_reach(level: float) -> Column:
    """Whether sets of na and nb members differ in so few parity bits that their similarity can be `level`."""
    differ = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return differ <= (F.col("na") + F.col("nb")) * F.lit((1 - level) / (1 + level)) + F.lit(1e-6)


def _sides(sets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The sets' nodes, sizes and bits for either end of pairs (a, b) of `key`."""
    return tuple(sets.select(F.col(key).alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")


def likely(sets: DataFrame, level: float = 0.8) -> DataFrame:
    """(a, b): each set's node with the smallest of each of its bands. Links among these spare `pairs` most of its work."""
    entries = sets.select("node", F.explode("bands").alias("key"))
    low = entries.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1")
    stars = entries.join(low, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    a, b = _sides(sets.withColumn("at", F.col("node")), "at")
    return stars.join(a, "a").join(b, "b").where(_may_reach(level)).select("a", "b")


def pairs(docs: DataFrame, sets: DataFrame, level: float = 0.8, shingle: int = 5) -> DataFrame:
    """(a, b): every pair of nodes of `sets` whose similarity is `level` or more and whose roots differ, and some others.

    Such sets meet in the first shingle of the common order that both hold, and it is in both prefixes. There each has at
    least the shingles in common left. Keys are 64-bit hashes; nodes of one key all go on to the exact check."""
    keyed = sets.withColumn("id", F.xxhash64("node"))
    held = keyed.select("whole", "id", F.xxhash64("root").alias("r"), "n").join(prefixes(docs, shingle, level), "whole").drop("whole")
    held = materialize(held, "prefixes")
    entries = _cells(held.select("id", "r", "n", "cool", F.posexplode("prefix").alias("p", "key")))
    a, b = (entries.select("key", "cell", F.col("id").alias(x), F.col("r").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * F.lit(1 + level) >= (F.col("na") + F.col("nb")) * F.lit(level) - F.lit(1e-6)
    met = materialize(a.join(b, ["key", "cell"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & enough).select("a", "b").distinct(), "met")
    a, b = _sides(keyed, "id")
    return met.join(a, "a").join(b, "b").where(_may_reach(level)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _cells(entries: DataFrame) -> DataFrame:
    """Each entry with its cell. A shingle of at most CROWDED entries is one cell; those of any other are dealt into b blocks,
    and each block meets each other and itself in a cell of its own. The table of those is written, so its size is known to
    the planner, which broadcasts it only under its threshold."""
    n = entries.where(F.col("p") >= F.col("cool")).groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > CROWDED)
    crowded = materialize(n.select("key", F.ceil(F.col("k") / CROWDED).cast("int").alias("b")), "crowded")
    if crowded.isEmpty():
        return entries.withColumn("cell", F.lit(0).cast("long"))
    b = F.coalesce("b", F.lit(1))
    own = F.pmod(F.xxhash64("id", "key"), b)
    cells = F.transform(F.sequence(F.lit(0), b - 1), lambda j: F.least(own, j) * b + F.greatest(own, j))
    return entries.join(crowded, "key", "left").withColumn("cell", F.explode(cells)).drop("b")


def similar(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int = 5, level: float = 0.8) -> DataFrame:
    """(a, b): candidates whose sets of shingles have an exact Jaccard similarity of `level` or more. nodes: each node with one
    row (r) that has it, so copies don't meet here."""
    candidates = materialize(candidates, "candidates")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = nodes.join(ends, "node").select("node", F.col("r.doc_id").alias("d"), F.col("r.text_hash").alias("h"))
    one = materialize(one, "ends")
    texts = _keyed(docs)
    found = texts.join(one, texts.doc_id.eqNullSafe(one.d) & (F.col("text_hash") == F.col("h"))).select("node", "t").dropDuplicates(["node"])
    found = materialize(found, "texts")
    both = candidates.join(found.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(found.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b, c in rows_of(batches):
            keep = []
            for node, x, y in zip(c["b"], c["ta"], c["tb"]):
                if node != last:
                    last, held = node, shingle_set(y, shingle)
                other = shingle_set(x, shingle)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(common >= level * (len(held) + len(other) - common) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary"), "similar")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and (node, least, r, root) of each node, linked by fingerprints (as in clusters) or by similarity;
    least is the node's smallest doc_id, r its first row. The root is the component's own."""
    rows = sketches(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(row).alias("r"), F.any_value("fp").alias("fp"), F.any_value("whole").alias("whole")), "nodes")
    once = [F.any_value(c).alias(c) for c in ("n", "bits", "bands")]
    sets = materialize(rows.where("n > 0").groupBy("whole").agg(F.min("node").alias("node"), *once), "sets")
    equal = nodes.join(sets.select("whole", F.col("node").alias("b")), "whole").select(F.col("node").alias("a"), "b").where("a <> b")
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "distinct")
    same = nodes.join(by_fp.where("n > 1"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    first = by_fp.select("fp", "first")
    bits = links(by_fp.select("fp")).join(first.withColumnsRenamed({"fp": "a", "first": "x"}), "a")
    bits = bits.join(first.withColumnsRenamed({"fp": "b", "first": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = same.unionByName(bits).unionByName(equal).unionByName(similar(docs, nodes, likely(sets)))
    placed = nodes.select("node", "least", "r").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed, "placed")
    rest = similar(docs, nodes, pairs(docs, sets.join(placed.select("node", "root"), "node")))
    a, b = (placed.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    rest = rest.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    last = components(rest).select(F.col("node").alias("root"), F.col("root").alias("last"))
    placed = placed.join(last, "root", "left").select("node", "least", "r", F.coalesce("last", "root").alias("root"))
    return rows, placed


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component_id and root of each row. Unrelated components may share a component_id, as rows may share
    a doc_id or have none."""
    rows, placed = grouped(docs)
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "text_hash", "node").join(placed.join(whole, "root").select("node", "component_id", "root"), "node").drop("node")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with its own columns, whatever these are called: the one with the smallest doc_id, then
    text hash; a null doc_id comes last. Each node's copies are reduced to one before any join, so copies never meet in a
    task; documents move once, by a key of their id and text."""
    _rows, placed = grouped(docs.select("doc_id", "text"))
    first = placed.groupBy("root").agg(F.min("r").alias("r"))
    i, h = fresh_names(docs.columns, "id_key", "text_key")
    text_key = lambda t, d: F.xxhash64(t, d.isNull())
    keep = first.select(F.coalesce("r.doc_id", F.lit(0)).alias(i), text_key(F.col("r.text_hash"), F.col("r.doc_id")).alias(h))
    marked = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), h: text_key(F.xxhash64("text"), F.col("doc_id"))})
    return marked.join(keep, [i, h], "left_semi").dropDuplicates([i, h]).select(*docs.columns)
