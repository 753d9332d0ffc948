"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax over a pair table.

P(word | context) = P(class | context) * P(word | class, previous class). The most frequent words form
classes by clustering what stands beside them; every other word belongs to a class by a hash of its last bytes.
P(class | context) is a softmax over hashed features: the previous word, the previous two words, and skip
features, the classes 2 and 4 words back. Its weights come from gradient steps over groups of about GROUP_TOKENS training
words. Groups and their order follow from the rows alone, not from partitions; their steps are averaged by row and use.
Within a class of frequent words a softmax with the previous class as its feature is fitted by gradient steps to
corpus-wide counts; in the other classes a word has (c + 1) / (tokens + types + 1) of its class, and all words never seen share one such part.

Pairs of neighbouring words are counted over the whole training corpus, and every one of them, however rare it or its words are, takes
(n - DISCOUNT) / c(previous word) of the probability; what they leave of it goes by the model above. So evidence about word pairs grows with
the corpus. At most `most_pairs` of the most frequent pairs are broadcast; tokens of other pairs are sent, with the model's probability, to
the block of the pair table that holds theirs, and the sums for their texts come back. So `most_pairs` and `head` bound memory and change no share
of a pair. Words outside the head go by 63-bit hashes there, and pairs with them by a hash of both.

Counts cover every training document. The counts of the words above a frequency threshold (at most `head`
words) are broadcast; the rest of the words are joined with the count table, and as each of them comes less often
than the threshold none is a hot key. Training data are texts whose crc32(doc_id as text) modulo 7 isn't 2.

Defined results: a null or empty text is one end token; repeated rows are scored each; a null doc_id counts as
empty text for the split; without training rows every count is zero and N = V = 0. Long texts are scored whole.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, ready, remainder, rows_of, split_words, sum_vectors, table
from .tokens import KIND, SHORT, ShortTable, pairs_of

HEAD, FREQUENT, BESIDE = 1 << 18, 2048, 128
CLUSTERS, SUFFIXES = 15, 16
END_CLASS = CLUSTERS
CLASSES = CLUSTERS + 1 + SUFFIXES
START = CLASSES  # the class before a text's first word
ROWS = 4096
SKIPS = (2, 4)
TABLE_ROWS = 2 * ROWS + len(SKIPS) * (CLASSES + 1) + 1
BLOCK = 128
#: Training words of a group, pairs of words that are broadcast, and what each pair leaves to the rest.
GROUP_TOKENS, PAIRS, DISCOUNT = 4_000_000, 2_000_000, 0.75
#: Tokens of a block of the pair table, and tokens and texts that a task scores before it sends what it asks of the table.
BLOCK_TOKENS, SENT_TOKENS, SENT_TEXTS = 2_000_000, 2_000_000, 1 << 15
#: Bytes of an Arrow batch of packed rows, and the fewest bytes of which those of each place are packed apart.
BATCH_BYTES, APART = 1 << 20, 1 << 14
TABLE, FOLLOWED, ASK, TEXTS, SUMS = range(5)
END = b""
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def suffix_class(word: bytes) -> int:
    return CLUSTERS + 1 + zlib.crc32(word[-3:]) % SUFFIXES


class Vocabulary:
    """words: head words by falling count, whose places are their ids; id len(words) is the end token, the next SUFFIXES ids
    the rest's classes. Short words are looked up in arrays, many at once."""

    def __init__(self, words: Iterable[bytes], counts: np.ndarray, class_of: np.ndarray):
        self.words, self.counts, self.class_of, self._tables = list(words), counts, class_of, None

    def __getstate__(self) -> tuple:
        return self.words, self.counts, self.class_of, None

    def __setstate__(self, state: tuple) -> None:
        self.words, self.counts, self.class_of, self._tables = state

    @property
    def width(self) -> int:
        return len(self.words) + 1 + SUFFIXES

    def _find(self, joined: bytes, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self._tables is None:
            size = np.fromiter(map(len, self.words), np.int64, len(self.words))
            brief = np.flatnonzero(size <= SHORT)
            raw = np.frombuffer(b"".join([*self.words, b" " * (SHORT + 1)]), np.uint8)
            short = ShortTable(len(self.words))
            short.add(*pairs_of(raw, (np.cumsum(size) - size)[brief], size[brief]), brief.astype(np.int32))
            self._tables = short, {self.words[i]: i for i in np.flatnonzero(size > SHORT).tolist()}
        short, long = self._tables
        out, few = np.empty(len(starts), np.int64), np.flatnonzero(length > SHORT)
        brief = np.flatnonzero(length <= SHORT)
        out[brief] = short.find(*pairs_of(np.frombuffer(joined, np.uint8), starts[brief], length[brief]))
        out[few] = np.fromiter((long.get(joined[a : a + n], -1) for a, n in zip(starts[few].tolist(), length[few].tolist())), np.int64, len(few))
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ids of all texts with an end token each, each text's offset (one more than texts), and its other words."""
        end = len(self.words)
        joined = b" ".join([b"", *(t or b"" for t in texts), b" " * (SHORT + 1)]).lower()
        dark = KIND[np.frombuffer(joined, np.uint8)] != 0
        edges = np.flatnonzero(dark[1:] != dark[:-1]) + 1
        starts, length = edges[::2], edges[1::2] - edges[::2]
        ids = self._find(joined, starts, length)
        missing = np.flatnonzero(ids < 0)
        names = [joined[a : a + n] for a, n in zip(starts[missing].tolist(), length[missing].tolist())]
        ids[missing] = end + 1 + np.fromiter((zlib.crc32(w[-3:]) % SUFFIXES for w in names), np.int64, len(names))
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)  # each text's first word
        bounds = first + np.arange(len(first))
        out = np.full(len(ids) + len(texts), end, np.int64)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(first))] = ids
        cut = np.searchsorted(missing, first).tolist()
        return out, bounds, [names[a:z] for a, z in zip(cut, cut[1:])]


def word_ids(ids: np.ndarray, rest: list[list[bytes]], end: int) -> np.ndarray:
    """ids with a word's own, negative id in place of the class of each word outside the head."""
    out, names = ids.copy(), [w for r in rest for w in r]
    out[ids > end] = (np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names), np.uint64, len(names)) | np.uint64(1 << 63)).view(np.int64)
    return out


def before_of(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The id before each token; the end token stands before a text."""
    last = np.empty(len(ids), np.int64)
    last[1:] = ids[:-1]
    last[bounds[:-1]] = end
    return last


def contexts(ids: np.ndarray, bounds: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's feature rows in the weight table (its last row is the bias), and the class before it."""
    n = len(ids)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    cls = class_of[ids]

    def back(values: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(n, none, values.dtype)
        out[k:] = values[: n - k] if n > k else values[:0]
        out[place < k] = none
        return out

    one, two = back(ids, 1, -1).astype(np.uint64), back(ids, 2, -1).astype(np.uint64)
    f = [((one * _A) >> np.uint64(52)).astype(np.int64), (((one * _A) ^ (two * _B + _A)) * _B >> np.uint64(52)).astype(np.int64) + ROWS]
    for j, k in enumerate(SKIPS):
        f.append(back(cls, k, START) + 2 * ROWS + j * (CLASSES + 1))
    return np.stack(f, axis=1), back(cls, 1, START)


def largest(z: np.ndarray) -> np.ndarray:
    """z.max(axis=1, keepdims=True), by halves, as rows are short."""
    while z.shape[1] > 1 and z.shape[1] % 2 == 0:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z.max(axis=1, keepdims=True) if z.shape[1] > 1 else z


def log_classes(weights: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log P(class) of each token's class."""
    z = np.take(weights, rows[:, 0], axis=0)
    z += weights[-1]
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0)
    z -= largest(z)
    own = z[np.arange(len(cls)), cls]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def steps(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """Adaptive gradient steps on the tokens, in small batches, in place. All features' rows are sorted and summed at once."""
    for a in range(0, len(cls), 512):
        r, c = rows[a : a + 512], cls[a : a + 512]
        g = np.take(weights, r[:, 0], axis=0)
        g += weights[-1]
        for k in range(1, r.shape[1]):
            g += np.take(weights, r[:, k], axis=0)
        g -= largest(g)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(c)), c] -= 1
        flat = r.T.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # a radix sort
        ranked = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        times = np.diff(np.append(first, len(flat)))
        total = np.take(g, order[first] % len(c), axis=0)
        if (several := np.flatnonzero(times > 1)).size:  # a sum of one row costs as much as one of many
            many = times[several]
            total[several] = np.add.reduceat(np.take(g, order[np.repeat(times > 1, times)] % len(c), axis=0), np.cumsum(many) - many, axis=0)
        at = np.concatenate([ranked[first], [len(weights) - 1]])
        total = np.concatenate([total, g.sum(axis=0, keepdims=True)])
        s = np.take(squares, at, axis=0)
        s += total * total
        squares[at] = s
        s += np.float32(1e-6)
        np.sqrt(s, out=s)
        total /= s
        total *= np.float32(rate)
        weights[at] -= total
        used[at] += np.append(times, len(c))


def word_counts(training: DataFrame, flush: int = 200_000) -> DataFrame:
    """(w, c) of every token of the training texts; the empty word is the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "c"])

        for _, c in rows_of(batches):
            for t in c["t"]:
                held.update(split_words(t))
                held[END] += 1
            if len(held) > flush:
                yield out()
                held.clear()
        yield out()

    return training.mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int, most_bytes: int = 1 << 26) -> list[tuple[bytes, int]]:
    """Every word above a frequency threshold that at most `most` words of `most_bytes` bytes in all pass, by falling count."""
    words = counts.where(F.length("w") > 0)
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    spread = sorted((tuple(r) for r in words.groupBy(level.alias("l")).agg(F.count("*"), F.sum(F.length("w").cast("long"))).collect()), reverse=True)
    total, size, floor = 0, 0, None
    for lev, n, n_bytes in spread:
        total, size = total + n, size + n_bytes
        if total > most or size > most_bytes:
            break
        floor = lev
    if floor is None:
        return []
    got = words.where(level >= floor).select("w", "c").toArrow()
    return sorted(zip(got["w"].to_pylist(), got["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


def press(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, by zstd where that is shorter: many numbers by the place of a byte in each, as the upper ones repeat; few at once."""
    places = [p for x in arrays for p in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T]
    pieces = [p.tobytes() for p in places]
    if sum(map(len, pieces)) < APART:
        pieces = [b"".join(pieces)]
    out = [min(p, pa.compress(p, "zstd", asbytes=True), key=len) if p else p for p in pieces]
    return np.array([len(x) for x in out], "<u4").tobytes() + b"".join(out)


def unpress(blob: bytes, at: int, *kinds: tuple[str, int]) -> tuple[list[np.ndarray], int]:
    """The arrays of these types and lengths that press() packed, from `at` on, and where they end."""
    sizes = [n for kind, n in kinds for _ in range(np.dtype(kind).itemsize)]
    if sum(sizes) < APART:
        sizes = [sum(sizes)]
    lengths = np.frombuffer(blob, "<u4", len(sizes), at).tolist()
    at, pieces = at + 4 * len(sizes), []
    for length, size in zip(lengths, sizes):
        piece = blob[at : at + length]
        pieces.append(piece if length == size else pa.decompress(piece, size, "zstd", asbytes=True))
        at += length
    whole, k, out = np.frombuffer(b"".join(pieces), np.uint8), 0, []
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(whole[k : k + n * width].reshape(width, n).T).view(kind).ravel())
        k += n * width
    return out, at


def pack_pairs(key: np.ndarray, n: np.ndarray, width: int) -> bytes:
    """Ascending keys (previous id * width + id) and their counts: each previous id with how many follow it, then these."""
    before, after = key // width, key % width
    first = np.flatnonzero(np.diff(before, prepend=-1))
    over = np.flatnonzero(n > 254)
    parts = [before[first].astype("<u4"), np.diff(np.append(first, len(key))).astype("<u4"), (after & 0xFFFF).astype("<u2"), (after >> 16).astype("u1")]
    parts += [np.minimum(n, 255).astype("u1"), over.astype("<u4"), n[over].astype("<i8")]
    return struct.pack("<III", len(first), len(key), len(over)) + press(*parts)


def unpack_pairs(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    f, k, o = struct.unpack_from("<III", blob)
    out, _ = unpress(blob, 12, ("<u4", f), ("<u4", f), ("<u2", k), ("u1", k), ("u1", k), ("<u4", o), ("<i8", o))
    before, follow, low, high, times, over, exact = (x.astype(np.int64) for x in out)
    times[over] = exact
    return np.repeat(before, follow) * width + (low | high << 16), times


def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key) if n is not None else slice(None)
    key = key[order]
    if n is None:
        key.sort()  # in place: the caller's array is no longer its own
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if n is None:
        return key[first], np.diff(np.append(first, len(key)))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def rare_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One negative key for each pair with a word outside the head."""
    x = a.view(np.uint64) * _A
    x = ((x ^ (x >> np.uint64(32))) + b.view(np.uint64)) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return ((x ^ (x >> np.uint64(32))) | np.uint64(1 << 63)).view(np.int64)


def leaves_key(a: np.ndarray) -> np.ndarray:
    """The key by which a word outside the head has what it leaves, instead of a pair's share."""
    return rare_key(a, np.full(len(a), np.iinfo(np.int64).max))


def rare_block(a: np.ndarray, b: np.ndarray, first: int, blocks: int) -> np.ndarray:
    """The block of each pair with a word outside the head: by its second word if that one is outside, otherwise by the first. Such words
    come less often than the head's threshold, so no block is crowded."""
    return first + np.where(b < 0, _dealt(b, blocks) + blocks, _dealt(a, blocks))


def _dealt(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.view(np.uint64) >> np.uint64(8) & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64)


def sum_rare(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its n."""
    if not len(a):
        return a, b, n
    key = rare_key(a, b)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return a[order[first]], b[order[first]], np.add.reduceat(n[order], first)


def sums_by(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of n over all rows of its id."""
    if not len(ids):
        return n
    order = np.argsort(ids)
    ranked = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(ids), n.dtype)
    out[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(ids))))
    return out


def pack_rare(a: np.ndarray, b: np.ndarray, *numbers: np.ndarray) -> bytes:
    over = [np.flatnonzero(n > 254) for n in numbers]
    parts = [x for n, o in zip(numbers, over) for x in (np.minimum(n, 255).astype("u1"), o.astype("<u4"), n[o].astype("<i8"))]
    return struct.pack(f"<{1 + len(over)}I", len(a), *map(len, over)) + press(a, b, *parts)


def unpack_rare(blob: bytes, numbers: int = 1) -> list[np.ndarray]:
    k, *over = struct.unpack_from(f"<{1 + numbers}I", blob)
    kinds = [x for o in over for x in (("u1", k), ("<u4", o), ("<i8", o))]
    (a, b, *rest), _ = unpress(blob, 4 + 4 * numbers, ("<i8", k), ("<i8", k), *kinds)
    out = [a, b]
    for times, at, exact in zip(rest[::3], rest[1::3], rest[2::3]):
        n = times.astype(np.int64)
        n[at] = exact
        out.append(n)
    return out


def by_block(block: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each block that has any."""
    order = np.argsort(block.astype(np.uint16 if block.max(initial=0) < 1 << 16 else np.uint32), kind="stable")
    ranked, columns = block[order], [x[order] for x in columns]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(ranked)]):
        yield int(ranked[a]), [x[a:z] for x in columns]


def in_batches(blobs: Iterable[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Blocks and their bytes, of about BATCH_BYTES at a time: Spark holds a whole Arrow batch outside its heap."""
    there, data, size = [], [], 0
    for j, x in blobs:
        there.append(j), data.append(x)
        if (size := size + len(x)) > BATCH_BYTES:
            yield there, data
            there, data, size = [], [], 0
    if there:
        yield there, data


def pair_block(key: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """The block of each pair of ids: by the previous id, where that one is frequent by the second too, so that no block is crowded."""
    before = (key // width).astype(np.int32)
    after = (key - before.astype(np.int64) * width).astype(np.int32)
    after[(before >= FREQUENT) & (before < width - 1 - SUFFIXES)] = 0
    after += before
    after %= blocks
    return after


def pair_counts(training: DataFrame, vocabulary: Vocabulary, blocks: int, rare_blocks: int, fan: int = 64) -> DataFrame:
    """(block, blob): the counts of all neighbouring ids of the training texts (the end token also stands before a text), by
    pair_block. Ids are bounded, so a block is too; a task gets at most `fan` parts of one. Further blocks hold those pairs of words of
    which one is outside the head: `rare_blocks` blocks by the first word where it is outside, and as many more, by the second, for the others."""
    spark = training.sparkSession
    shared, width = spark.sparkContext.broadcast(vocabulary), vocabulary.width
    schema = "part long, block int, blob binary"

    def blobs(held: list[np.ndarray], rare: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        """Takes what the lists hold, so that it is not in memory twice."""
        key = np.concatenate(held)
        held.clear()
        key, n = _summed(key)
        for j, x in by_block(pair_block(key, width, blocks), key, n):
            yield j, pack_pairs(*x, width)
        del key, n
        a, b = (np.concatenate(x) for x in zip(*rare))
        rare.clear()
        a, b, n = sum_rare(a, b, np.ones(len(a), np.int64))
        for j, x in by_block(blocks + np.where(a < 0, _dealt(a, rare_blocks), rare_blocks + _dealt(b, rare_blocks)), a, b, n):
            yield j, pack_rare(*x)

    def dealt(part: int, held: list[np.ndarray], rare: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for there, data in in_batches(blobs(held, rare)):
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(there), pa.int64()), pa.array(there, pa.int32()), pa.array(data, pa.binary())], ["part", "block", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, part, held, rare, size = shared.value, TaskContext.get().partitionId(), [], [], 0
        end = len(voc.words)
        for _, c in rows_of(batches, 128):
            ids, bounds, rest = voc.encode(c["t"])
            held.append(before_of(ids, bounds, end) * width + ids)
            b = word_ids(ids, rest, end)
            a = before_of(b, bounds, end)
            mine = np.flatnonzero((a < 0) | (b < 0))
            rare.append((a[mine], b[mine]))
            size += len(ids) + 2 * len(mine)
            if size > 8_000_000:
                yield from dealt(part, held, rare)
                held, rare, size = [], [], 0
        if held:
            yield from dealt(part, held, rare)

    def merge(key, rows):
        block = key[0].as_py()
        if block < blocks:
            both = [unpack_pairs(x.as_py(), width) for x in rows["blob"]]
            blob = pack_pairs(*_summed(*(np.concatenate(x) for x in zip(*both))), width)
        else:
            blob = pack_rare(*sum_rare(*(np.concatenate(x) for x in zip(*(unpack_rare(x.as_py()) for x in rows["blob"])))))
        return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([block], pa.int32()), "blob": pa.array([blob], pa.binary())})

    out, parts = training.mapInArrow(count, schema), training.rdd.getNumPartitions()
    while True:
        out = out.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(merge, schema)
        parts = -(-parts // fan)
        if parts <= 1:
            return materialize(out.select("block", "blob"), "pairs")


def over_pairs(pairs: DataFrame, width: int, cells, unpack=None) -> pa.Table:
    """Sums of n by `at`, where cells(key, count) gives arrays of at and n of one block: the caller bounds how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in rows_of(batches, 8):
            for blob in c["blob"]:
                at, n = cells(*(unpack(blob) if unpack else unpack_pairs(blob, width)))
                if len(at):
                    at, n = _summed(at, n)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    return pairs.select("blob").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()


def inside_head(key: np.ndarray, width: int, words: int) -> np.ndarray:
    """Which pairs have head words or the end token only."""
    return (key % width <= words) & (key // width <= words)


def kept_pairs(pairs: DataFrame, width: int, words: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ascending keys and counts of the pairs to broadcast: those inside the head from the lowest frequency on that at most `most`
    of them have; and whether these are all. The others are looked up in the blocks of the pair table."""

    def spread(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.minimum(n[inside_head(key, width, words)], 4096)
        return n, np.ones(len(n), np.int64)

    seen = over_pairs(pairs, width, spread)
    total, least = 0, None
    for n, k in sorted(zip(seen["at"].to_pylist(), seen["n"].to_pylist()), reverse=True):
        if (total := total + k) > most:
            break
        least = n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), not len(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in rows_of(batches, 8):
            for blob in c["blob"]:
                key, n = unpack_pairs(blob, width)
                keep = (n >= least) & inside_head(key, width, words)
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(n[keep])], ["key", "n"])

    got = pairs.select("blob").mapInArrow(run, "key long, n long").toArrow()  # at most `most` rows
    order = np.argsort(got["key"].to_numpy())
    return got["key"].to_numpy()[order], got["n"].to_numpy()[order], total <= most


SENT = "block int, kind int, part long, data binary"


def sent(blocks: np.ndarray, kind: int, part: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int64)), pa.array(data, pa.binary())], ["block", "kind", "part", "data"]
    )


def followed(pairs: DataFrame, blocks: int, rare_blocks: int) -> DataFrame:
    """Pairs of two words outside the head, from the blocks of the first to those of the second, with how many words follow the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in rows_of(batches, 8):
            for blob in c["blob"]:
                a, b, n = unpack_rare(blob)
                follow = sums_by(a, np.ones(len(a), np.int64))
                mine = np.flatnonzero(b < 0)
                a, b, n, follow = a[mine], b[mine], n[mine], follow[mine]
                for there, data in in_batches((j, pack_rare(*x)) for j, x in by_block(rare_block(a, b, blocks, rare_blocks), a, b, n, follow)):
                    yield sent(np.array(there), FOLLOWED, 0, data)

    return pairs.where(F.col("block").between(blocks, blocks + rare_blocks - 1)).select("blob").mapInArrow(run, SENT)


def asked(part: int, tokens: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Tokens (block, key, log_p, text) whose pairs aren't broadcast, by ascending keys, for the blocks of the pair table that hold them. An
    infinite log_p asks for what a word leaves. Takes what the list holds; columns are put in order one at a time."""
    block, key, log_p, text = (list(x) for x in zip(*tokens))
    tokens.clear()
    key = np.concatenate(key)
    order = np.argsort(key)
    block = np.concatenate(block)[order]
    by = np.argsort(block.astype(np.uint16 if block.max(initial=0) < 1 << 16 else np.uint32), kind="stable")
    order, block = order[by], block[by]
    del by
    key, log_p, text = key[order], np.concatenate(log_p)[order].astype("<f4"), np.concatenate(text)[order].astype("<u2")
    del order
    first = np.flatnonzero(np.diff(block, prepend=-1))

    def packed() -> Iterator[tuple[int, bytes]]:
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
            yield int(block[a]), struct.pack("<I", z - a) + press(np.diff(key[a:z], prepend=0).astype("<i8"), log_p[a:z], text[a:z])

    for there, data in in_batches(packed()):
        yield sent(np.array(there), ASK, part, data)


def unpack_asked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, log_p and texts."""
    (n,) = struct.unpack_from("<I", data)
    (steps_up, log_p, text), _ = unpress(data, 4, ("<i8", n), ("<f4", n), ("<u2", n))
    return np.cumsum(steps_up), log_p, text


def answers(context: np.ndarray, width: int, blocks: int, rare_blocks: int):
    """Over rows of SENT by block and kind: for each ASK what the shares of its pairs add to the log probabilities of its texts, as SUMS."""

    def opened(block: int, tables: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Keys and the log of each pair's share, as against what else its token has by its words outside the head: c + 1, and what the
        word before leaves."""
        if not tables:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        if block < blocks:
            key, n = (np.concatenate(x) for x in zip(*(unpack_pairs(t, width) for _, t in tables)))
            value = np.log(n - DISCOUNT) - np.log(context[key // width])
        elif block < blocks + rare_blocks:
            a, b, n = (np.concatenate(x) for x in zip(*(unpack_rare(t) for _, t in tables)))
            leaves = DISCOUNT * sums_by(a, np.ones(len(a), np.int64))
            _, first = np.unique(a, return_index=True)
            key = np.concatenate([rare_key(a, b)[b >= 0], leaves_key(a[first])])
            value = np.concatenate([(np.log(n - DISCOUNT) - np.log(leaves))[b >= 0], np.log(leaves[first] / sums_by(a, n)[first])])
        else:
            both = [unpack_rare(t, 1 + (kind == FOLLOWED)) for kind, t in tables]
            a, b, n = (np.concatenate(x) for x in zip(*(x[:3] for x in both)))
            over = np.concatenate([DISCOUNT * x[3] if len(x) > 3 else context[x[0]] for x in both])
            key, value = rare_key(a, b), np.log(n - DISCOUNT) - np.log(over) - np.log(sums_by(b, n) + 1.0)
        order = np.argsort(key)
        return key[order], value[order].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, found = None, [], None
        for whole in batches:
            for block, kind, part, data in zip(*(whole.column(i) for i in range(4))):
                block, kind, part = block.as_py(), kind.as_py(), part.as_py()
                if block != now:
                    now, tables, found = block, [], None
                if kind in (TABLE, FOLLOWED):
                    tables.append((kind, data.as_py()))
                elif kind == TEXTS:
                    yield sent(np.array([block]), TEXTS, part, [data.as_py()])
                else:
                    key, value = found = found or opened(block, tables)
                    tables = []
                    want, log_p, text = unpack_asked(data.as_py())
                    at = np.searchsorted(key, want)
                    hit = np.flatnonzero(at < len(key))
                    hit = hit[key[at[hit]] == want[hit]]
                    if len(hit):
                        log_p, gain = log_p[hit].astype(np.float64), value[at[hit]].astype(np.float64)
                        more = np.bincount(text[hit], np.where(np.isinf(log_p), gain, np.logaddexp(0, gain - log_p)))
                        there = np.flatnonzero(more)
                        yield sent(np.array([block]), SUMS, part, [there.astype("<u2").tobytes() + more[there].astype("<f4").tobytes()])
        give_back()

    return run


def put_together(key, rows):
    """The texts of one part, with what the pair table adds to their scores."""
    texts, more = None, np.zeros(1 << 16)
    for kind, data in zip(rows["kind"].to_pylist(), rows["data"].to_pylist()):
        if kind == TEXTS:
            texts = pa.ipc.open_stream(data).read_all()
        else:
            n = len(data) // 6
            more[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<f4", n, 2 * n)
    at = texts.schema.get_field_index("score")
    return texts.set_column(at, "score", pa.array(texts["score"].to_numpy() + more[: len(texts)]))


class PairTable:
    """key -> log of its share, by open addressing. Keys are put in some at a time, so that little besides the table is in memory."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(8, (2 * len(key)).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        for a in range(0, len(key), 1 << 16):
            self._add(key[a : a + (1 << 16)], value[a : a + (1 << 16)])

    def _add(self, key: np.ndarray, value: np.ndarray) -> None:
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.key[slot] < 0
            self.key[slot[free]] = key[todo[free]]
            mine = self.key[slot] == key[todo]
            self.value[slot[mine]] = value[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _A) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are there, and their values."""
        slot, todo, at, value = self._slot(key), np.arange(len(key)), [], []
        while len(todo):
            there = self.key[slot]
            hit = there == key[todo]
            at.append(todo[hit]), value.append(self.value[slot[hit]])
            more = (there >= 0) & ~hit
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return (np.concatenate(at), np.concatenate(value)) if at else (todo, np.zeros(0, np.float32))


def cluster(pairs: DataFrame, width: int, k: int) -> np.ndarray:
    """A cluster for each of the k most frequent words, by k-means on the square roots of how often the BESIDE most frequent
    words stand right before or after it, over all training texts."""
    if k <= CLUSTERS:
        return np.arange(k)

    def cells(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = key // width, key % width
        after, before = (a < k) & (b < BESIDE), (b < k) & (a < BESIDE)
        return np.concatenate([(a * 2 * BESIDE + b)[after], (b * 2 * BESIDE + BESIDE + a)[before]]), np.concatenate([n[after], n[before]])

    got = over_pairs(pairs, width, cells)  # at most k * 2 * BESIDE rows
    x = np.zeros(k * 2 * BESIDE)
    x[got["at"].to_numpy()] = np.sqrt(got["n"].to_numpy())
    x = x.reshape(k, -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centers = x[np.linspace(0, min(k, 512) - 1, CLUSTERS).astype(int)].copy()
    for _ in range(25):
        own = (x @ centers.T).argmax(axis=1)
        for j in range(CLUSTERS):
            if (mine := own == j).any():
                centers[j] = x[mine].sum(axis=0)
        centers /= np.linalg.norm(centers, axis=1, keepdims=True) + 1e-9
    return (x @ centers.T).argmax(axis=1)


def follow_counts(pairs: DataFrame, vocabulary: Vocabulary, frequent: int) -> np.ndarray:
    """How often each frequent word follows each class; the class before a text's first word is START."""
    width, end, class_of = vocabulary.width, len(vocabulary.words), vocabulary.class_of

    def cells(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = key // width, key % width
        own = b < frequent
        cls = np.where(a[own] == end, START, class_of[a[own]])
        return cls * frequent + b[own], n[own]

    out = np.zeros((CLASSES + 1) * frequent)
    got = over_pairs(pairs, width, cells)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(CLASSES + 1, frequent)


def train_classes(training: DataFrame, vocabulary: Vocabulary, prior: np.ndarray, groups: int, rounds: int = 1, rate: float = 0.1) -> np.ndarray:
    """The class weights. training: t and its group; each group learns from the same start, in the order of its texts' hashes."""
    spark = training.sparkSession
    weights = np.zeros((TABLE_ROWS, CLASSES), np.float32)
    weights[-1] = prior
    width = BLOCK * (CLASSES + 1)
    words = spark.sparkContext.broadcast(vocabulary)
    dealt = training.repartitionById(groups, F.col("group")).sortWithinPartitions("h").select("t")
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, voc = start.value.copy(), words.value
            squares, used = np.full(w.shape, 1.0, np.float32), np.zeros(len(w), np.int64)
            for _, c in rows_of(batches, 128):
                ids, bounds, _rest = voc.encode(c["t"])
                rows, _before = contexts(ids, bounds, voc.class_of)
                steps(w, squares, used, rows, voc.class_of[ids], rate)
            if not used[-1]:
                return
            sent = np.hstack([(w - start.value) * used[:, None], used[:, None]]).astype(np.float32).ravel()
            sent = np.concatenate([sent, np.zeros(-len(sent) % width, np.float32)]).reshape(-1, width)
            full = np.flatnonzero(sent.any(axis=1))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(full), pa.int64()), pa.array(full.astype(np.int32)), pa.array([sent[i].tobytes() for i in full], pa.binary())],
                ["part", "block", "v"],
            )

        got = sum_vectors(dealt.mapInArrow(learn, "part long, block int, v binary"), groups, np.float32).toArrow()  # the table's fixed number of blocks
        flat = np.zeros(-(-TABLE_ROWS * (CLASSES + 1) // width) * width)
        for block, v in zip(got["block"].to_pylist(), got["v"].to_pylist()):
            flat[block * width : (block + 1) * width] = np.frombuffer(v, np.float32)
        moved = flat[: TABLE_ROWS * (CLASSES + 1)].reshape(TABLE_ROWS, CLASSES + 1)
        weights = weights + (moved[:, :-1] / np.maximum(moved[:, -1:], 1)).astype(np.float32)
    return weights


def within_classes(follows: np.ndarray, class_of: np.ndarray, counts: np.ndarray, l2: float = 2.0, rounds: int = 40) -> np.ndarray:
    """log P(frequent word | its class, class before), by damped Newton steps on a softmax for each class and class before."""
    out = np.zeros(follows.shape)
    for c in np.unique(class_of):
        mine = np.flatnonzero(class_of == c)
        base = np.log(counts[mine] + 1.0)
        n = follows[:, mine]
        u = np.zeros(n.shape)
        for _ in range(rounds):
            z = base + u
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            e = p * n.sum(axis=1, keepdims=True)
            u += np.clip(0.5 * (n - e - l2 * u) / (e + l2), -1, 1)  # where e is small, its curvature holds for a short way only
        z = base + u
        z -= z.max(axis=1, keepdims=True)
        out[:, mine] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Spark removes files of shuffles that nothing will read again when its driver collects garbage; large tables wait for that on disk.
    Spark's listeners hold the last query, and so its shuffles, until another one ends: here a query of one row."""
    spark._jsparkSession.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, modulus: int = 7, held: int = 2, head: int = HEAD, frequent: int = FREQUENT, rounds: int = 1, most_pairs: int = PAIRS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = ready(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"), (remainder("doc_id", modulus) == held).alias("held_out"))
    training = source.where(~F.col("held_out"))
    counts = materialize(word_counts(training.select("t")), "counts")
    group = F.crc32(F.substring("w", -3, 3)) % SUFFIXES
    totals = counts.groupBy(F.when(F.length("w") == 0, -1).otherwise(group).alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    n_train, types = sum(r["c"] for r in totals), sum(r["v"] for r in totals)
    found = head_words(counts, head)
    words = [w for w, _ in found]
    frequent = min(frequent, len(words))
    size = np.array([c for _, c in found], np.int64)
    plain = Vocabulary(words, size, np.zeros(len(words) + 1 + SUFFIXES, np.int64))
    blocks = int(min(max(n_train // BLOCK_TOKENS, 16), 1 << 16))
    rare_blocks = blocks // 4
    table_rows = pair_counts(training.select("t"), plain, blocks, rare_blocks)
    pairs = table_rows.where(F.col("block") < blocks)
    own = cluster(pairs, plain.width, frequent)
    group_of = np.array([suffix_class(w) for w in words], np.int64)
    class_of = np.concatenate([own, group_of[frequent:], np.arange(END_CLASS, CLASSES)]).astype(np.int64)
    tokens_of, types_of, end_count = np.zeros(CLASSES), np.zeros(CLASSES), 0
    for r in totals:
        if r["g"] < 0:
            end_count = r["c"]
        else:
            tokens_of[CLUSTERS + 1 + r["g"]], types_of[CLUSTERS + 1 + r["g"]] = r["c"], r["v"]
    np.subtract.at(tokens_of, group_of[:frequent], size[:frequent])
    np.subtract.at(types_of, group_of[:frequent], 1)
    part_of = tokens_of + types_of + 1.0
    in_class = part_of.copy()
    in_class[:CLUSTERS] = np.bincount(own, size[:frequent], minlength=CLUSTERS)[:CLUSTERS] + 1e-6
    in_class[END_CLASS] = end_count + 1
    vocabulary = Vocabulary(words, size, class_of)
    groups = max(1, -(-n_train // group_tokens))
    text_hash = F.xxhash64("doc_id", "t")
    weights = train_classes(training.select("t", text_hash.alias("h"), F.pmod(F.xxhash64(text_hash), F.lit(groups)).cast("int").alias("group")), vocabulary, np.log(in_class / in_class.sum()), groups, rounds)
    follows = follow_counts(pairs, vocabulary, frequent)
    key, times, whole = kept_pairs(pairs, plain.width, len(words), most_pairs)
    context = np.maximum(np.concatenate([size, [end_count], np.zeros(SUFFIXES, np.int64)]), 1).astype(np.float64)
    share = (times - DISCOUNT) / context[key // plain.width]
    # Every pair leaves DISCOUNT; what words outside the head leave is asked of the pair table.
    inner = over_pairs(pairs, plain.width, lambda key, n: ((x := key[inside_head(key, plain.width, len(words))] // plain.width), np.ones(len(x), np.int64)))
    outer = over_pairs(table_rows.where(F.col("block") >= blocks + rare_blocks), plain.width, lambda a, n: (a, np.ones(len(a), np.int64)), lambda blob: unpack_rare(blob)[::2])
    different = np.zeros(plain.width)
    for got in (inner, outer):  # at most a row for each head word
        different[got["at"].to_numpy()] += got["n"].to_numpy()
    left = np.log(np.where(different > 0, DISCOUNT * different / context, 1.0))
    # What a token adds besides its class and, for words that aren't in the head, log(c + 1).
    adds = np.concatenate([np.log(size + 1.0) - np.log(part_of[group_of]), [0.0], -np.log(part_of[END_CLASS + 1 :])])
    known = np.concatenate([np.ones(len(words), np.int64), [int(end_count > 0)], np.zeros(SUFFIXES, np.int64)])
    base = np.concatenate([np.log(size + 1.0), [np.log(end_count + 1.0)], np.zeros(SUFFIXES)])
    inside = within_classes(follows, own, size[:frequent]) if frequent else np.zeros((CLASSES + 1, 0))
    adds[:frequent] = 0.0
    model = spark.sparkContext.broadcast((vocabulary, weights, adds, known, base, inside, frequent, PairTable(key, np.log(share).astype(np.float32)), left))
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<w: binary, n: long>>"
    width, all_blocks, some_rare = plain.width, blocks + 2 * rare_blocks, types > len(words) + int(end_count > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, w, plus, is_known, log_c, log_in, top, kept, log_left = model.value
        end = len(voc.words)
        part, texts, asks, leaves, n_texts, n_tokens = TaskContext.get().partitionId() << 24, [], [], [], 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(texts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield sent(np.array([(part + (part >> 24)) % all_blocks]), TEXTS, part, [sink.getvalue().to_pybytes()])
            for of_kind in (asks, leaves):
                if of_kind:
                    yield from asked(part, of_kind)

        for b, c in rows_of(batches, 128):
            ids, bounds, rest = voc.encode(c["t"])
            total = plus[ids]
            for a in range(0, len(ids), 1 << 17):  # features reach back 6 words, so a part begins 8 earlier
                z = min(a + (1 << 17), len(ids))
                lo = max(0, a - 8)
                part_bounds = np.concatenate([[lo], bounds[(bounds > lo) & (bounds < z)], [z]])
                rows, before = contexts(ids[lo:z], part_bounds - lo, voc.class_of)
                rows, before = rows[a - lo :], before[a - lo :]
                for k in range(0, z - a, 1024):
                    own_ids = ids[a + k : min(a + k + 1024, z)]
                    got = log_classes(w, rows[k : k + 1024], voc.class_of[own_ids]).astype(np.float64)
                    mine = own_ids < top
                    got[mine] += log_in[before[k : k + 1024][mine], own_ids[mine]]
                    total[a + k : a + k + len(own_ids)] += got
            last = before_of(ids, bounds, end)
            total += log_left[last]
            pair = last * width + ids
            at, log_share = kept.find(pair)
            total[at] = np.logaddexp(total[at], log_share)
            text = np.repeat(np.arange(n_texts, n_texts + b.num_rows), np.diff(bounds)).astype(np.uint16)
            if not whole:
                elsewhere = inside_head(pair, width, end)
                elsewhere[at] = False
                where = np.flatnonzero(elsewhere)
                asks.append((pair_block(pair[where], width, blocks), pair[where], total[where].astype(np.float32), text[where]))
            if some_rare:
                own = word_ids(ids, rest, end)
                last = before_of(own, bounds, end)
                where = np.flatnonzero((last < 0) | (own < 0))
                one, two = last[where], own[where]
                asks.append((rare_block(one, two, blocks, rare_blocks), rare_key(one, two), total[where].astype(np.float32), text[where]))
                where = where[one < 0]
                one = one[one < 0]
                leaves.append((blocks + _dealt(one, rare_blocks), leaves_key(one), np.full(len(one), np.inf, np.float32), text[where]))
            starts = bounds[:-1]
            others = [Counter(o) for o in rest]
            flat = pa.StructArray.from_arrays(
                [pa.array([w_ for o in others for w_ in o], pa.binary()), pa.array([n for o in others for n in o.values()], pa.int64())], ["w", "n"]
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(o) for o in others])]).astype(np.int32))
            rid = (part << 16) + n_texts
            texts.append(pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + b.num_rows)), b.column(0), b.column(2), pa.array(np.diff(bounds)),
                    pa.array(np.add.reduceat(is_known[ids], starts)), pa.array(np.add.reduceat(log_c[ids], starts)),
                    pa.array(np.add.reduceat(total, starts)), pa.ListArray.from_arrays(offsets, flat),
                ],
                ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"],
            ))
            n_texts, n_tokens = n_texts + b.num_rows, n_tokens + len(ids)
            if n_tokens > SENT_TOKENS or n_texts > SENT_TEXTS:
                yield from send()
                part, texts, asks, leaves, n_texts, n_tokens = part + 1, [], [], [], 0, 0
        if texts:
            yield from send()

    tables = table_rows.select("block", F.lit(TABLE).alias("kind"), F.lit(0).cast("long").alias("part"), F.col("blob").alias("data"))
    met = source.mapInArrow(run, SENT).unionByName(tables).unionByName(followed(table_rows, blocks, rare_blocks))
    drop_shuffles(spark)
    met = met.repartitionById(all_blocks, F.col("block")).sortWithinPartitions("block", "kind")
    scored = materialize(met.mapInArrow(answers(context, width, blocks, rare_blocks), SENT).groupBy("part").applyInArrow(put_together, schema), "scored")
    drop_shuffles(spark)
    rare = scored.select("rid", F.explode("rest").alias("r")).select("rid", "r.w", "r.n")
    more = rare.join(counts, "w").groupBy("rid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("rare_log"))
    whole_rows = scored.drop("rest").join(more, "rid", "left")
    ten, shared = float(np.log(10)), float(np.log(n_train + types + 1))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return whole_rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        ((F.col("base") + rare_log - F.col("n_tokens") * shared) / ten).alias("base_score"),
        ((F.col("score") + rare_log) / ten).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
