"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Training words stream through the automaton, which tracks the longest item passage that ends at each
word; passages of at least `window` words (or a whole shorter item) are hits. Words that no item has reset
it, so only runs of item words are walked. Items are read in blocks of at most about BLOCK_BYTES of text, one
automaton each; a block is what gets broadcast. Documents are scanned against one block after another, and a
worker holds one automaton at a time (about 60 bytes for each item word and 120 for each distinct one), built once a block.

The pipeline's stage drops contaminated documents (the coverage limit) and cuts passages of `window` words or more (the
length limit) out of the others; texts without such a passage stay as they are.

Defined results: a null or empty text has no words and is clean; an item without words has no window; a
null item text counts as empty; a null item_id is written as empty text; items that repeat count once by
id; repeated documents each get their row; a column of the documents that has the name of the result is an error.
Long texts are read whole.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, materialize, ready, table

BLOCK_BYTES = 8_000_000
#: A-Z in lower case; what isn't 0-9, a-z or beyond ASCII parts words.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_built: dict = {}


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """States of a suffix automaton of several word sequences; each knows the items it occurs in.

    Most states have one move and one owner, which stand in arrays; further ones are in dictionaries."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        self.names = [name for name, _ in items]
        self.link, self.len, self.word, self.move = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1])
        self.moves: dict[int, dict[int, int]] = {}
        for ids in sequences:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        none = array("i", [-1])
        self.owner, self.owners, seen = none * len(self.len), {}, none * len(self.len)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, ids in enumerate(sequences):  # every prefix's state and its suffix links occur in the item
            at = 0
            for c in ids:
                at = up = self._step(at, c)
                while up > 0 and seen[up] != item:
                    seen[up] = item
                    if self.owner[up] < 0:
                        self.owner[up] = item
                    else:
                        self.owners.setdefault(up, []).append(item)
                    up = self.link[up]
            if 0 < len(ids) < window:
                self.short.setdefault(at, []).append((len(ids), item))
        self.least = min([window, *(len(ids) for ids in sequences if ids)])
        self.above = none * len(self.len)  # the nearest state, itself or above, that ends a short item
        if self.short:
            for s in np.argsort(np.frombuffer(self.len, np.int32), kind="stable")[1:].tolist():
                self.above[s] = s if s in self.short else self.above[self.link[s]]

    def _step(self, state: int, c: int) -> int:
        """The state after word c, or -1."""
        if self.word[state] == c:
            return self.move[state]
        more = self.moves.get(state)
        return -1 if more is None else more.get(c, -1)

    def _set(self, state: int, c: int, to: int) -> None:
        if self.word[state] == c or self.word[state] < 0:
            self.word[state], self.move[state] = c, to
        else:
            self.moves.setdefault(state, {})[c] = to

    def _new(self, length: int, link: int) -> int:
        self.link.append(link), self.len.append(length), self.word.append(-1), self.move.append(-1)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        if (q := self._step(last, c)) >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur, p = self._new(self.len[last] + 1, 0), last
        while p >= 0 and (q := self._step(p, c)) < 0:
            self._set(p, c, cur)
            p = self.link[p]
        if p >= 0:
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.len[p] + 1, self.link[q])
        self.word[copy], self.move[copy] = self.word[q], self.move[q]
        if q in self.moves:
            self.moves[copy] = dict(self.moves[q])
        self.link[q] = copy
        while p >= 0 and self._step(p, c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (start, end) in words, merged, and the items whose windows occur."""
        known = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        inside = np.concatenate([[0], known >= 0, [0]])
        edge = np.flatnonzero(np.diff(inside))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= self.least:
                self._walk(known[a:b].tolist(), int(a), spans, items)
        return spans, {self.names[i] for i in items}

    def _walk(self, ids: list[int], at: int, spans: list, items: set) -> None:
        state = length = 0
        step, link, lens, window = self._step, self.link, self.len, self.window
        for i, c in enumerate(ids, at + 1):
            while (to := step(state, c)) < 0 and state:
                state = link[state]
                length = lens[state]
            if to < 0:
                continue
            state, length = to, length + 1
            reach = 0
            if length >= window:
                up = state
                while lens[link[up]] >= window:
                    up = link[up]
                items.add(self.owner[up])
                items.update(self.owners.get(up, ()))
                reach = length
            up = self.above[state]
            while up > 0:
                for n, item in self.short[up]:
                    if n <= length:
                        items.add(item)
                        reach = max(reach, n)
                up = self.above[link[up]]
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items as (id, text), in blocks of about block_bytes at most by a hash of the row."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), text.alias("t")).distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("t") + F.length("i")), F.lit(0))).first()[0]
    blocks = 1 if size <= block_bytes else 2 * (size // block_bytes + 1)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield [(r.i, bytes(r.t)) for r in part.toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, name: str = "hits") -> DataFrame:
    """docs with the struct column `name`: n_words, spans (array of start, end in words) and items (array of ids, sorted)."""
    spark = ready(docs.sparkSession)
    if fresh_names(docs.columns, name) != [name]:
        raise ValueError(f"docs has a column {name} already")
    blocks = item_blocks(benchmark, block_bytes)
    first = next(blocks)
    scan = lambda items: _scanner(spark.sparkContext.broadcast(items), window)(F.col("text").cast("binary"))
    if (second := next(blocks, None)) is None:
        scanned = docs.withColumn(name, scan(first))
        return scanned.withColumn(name, F.struct(F.col(f"{name}.n_words"), F.arrays_zip(F.col(f"{name}.starts").alias("start"), F.col(f"{name}.ends").alias("end")).alias("spans"), F.col(f"{name}.items")))
    (row,) = fresh_names([*docs.columns, name], "row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    texts = keyed.select(row, "text")
    found = []
    for k, items in enumerate(chain([first, second], blocks)):  # a job for each, so that a worker needs one automaton at a time
        some = texts.select(row, scan(items).alias("s")).select(row, "s.*")
        found.append(materialize(some if k == 0 else some.where(F.size("items") > 0), f"block-{k}"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    flat = lambda c: F.flatten(F.collect_list(c))
    whole = every.groupBy(row).agg(F.max("n_words").alias("n_words"), _merger()(flat("starts"), flat("ends")).alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    return keyed.join(whole.select(row, F.struct("n_words", "spans", "items").alias(name)), row).drop(row)


def _automaton(shared, window: int):
    """A function that gives the shared block's automaton. A worker keeps the last block's."""
    token = uuid.uuid4().hex

    def get() -> Automaton:
        if token not in _built:
            _built.clear()
            _built[token] = Automaton([(i, item_words(t)) for i, t in shared.value], window)
        return _built[token]

    return get


def _scanner(shared, window: int):
    """A pandas function text -> n_words, starts, ends, items of the shared block."""
    automaton = _automaton(shared, window)

    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = item_words(t)
            spans, found = automaton().scan(words)
            rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(found)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return F.pandas_udf(scan, "n_words long, starts array<long>, ends array<long>, items array<string>")


def _merger():
    """A pandas function (starts, ends) -> merged spans, for hits from several blocks."""

    def merge(starts: pd.Series, ends: pd.Series) -> pd.Series:
        rows = []
        for a, b in zip(starts, ends):
            merged: list[list[int]] = []
            for s, e in sorted(zip(a, b)):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            rows.append([{"start": int(s), "end": int(e)} for s, e in merged])
        return pd.Series(rows)

    return F.pandas_udf(merge, "array<struct<start: long, end: long>>")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, name: str = "hits", **args) -> DataFrame:
    """hits() with n_hit and contaminated in its struct: any hit, and at least one word of `share` hit."""
    found = hits(docs, benchmark, window, name=name, **args)
    n_hit = F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn(name, F.col(name).withField("n_hit", n_hit))
    n_hit = F.col(f"{name}.n_hit")
    return found.withColumn(name, F.col(name).withField("contaminated", (n_hit > 0) & (n_hit * share >= F.col(f"{name}.n_words"))))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, longest: int = 0, share: int = 20, drop: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs whose text lacks the hit spans of over `longest` words. A document over the coverage limit (one word of `share`)
    loses all its spans or, with `drop`, goes. Words of a removed span go together with what parts them. Where docs has a
    column n_chars, it is the new text's length in code points. With one block of items a text is scanned and cut in one
    go, so that a task needs one Python worker."""
    spark = ready(docs.sparkSession)
    name, after = fresh_names(docs.columns, "hits", "after")

    def cut(text: str | None, spans: list[tuple[int, int]], n_words: int) -> tuple[bool, str | None]:
        """Whether the document is over the limit, and its new text; None if it doesn't change."""
        n_hit = sum(e - s for s, e in spans)
        over = n_hit > 0 and n_hit * share >= n_words
        gone = [(s, e) for s, e in spans if over or e - s > longest]
        return over, without(text, gone) if gone and not (drop and over) else None

    blocks = list(islice(item_blocks(benchmark, block_bytes), 2))
    if len(blocks) == 1:
        automaton = _automaton(spark.sparkContext.broadcast(blocks[0]), window)

        def scan_and_cut(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                words = item_words(t.encode() if t else None)
                rows.append(cut(t, automaton().scan(words)[0], len(words)))
            return pd.DataFrame(rows, columns=["over", "text"])

        found = docs.withColumn(after, F.pandas_udf(scan_and_cut, "over boolean, text string")(F.col("text")))
    else:
        scanned = judged(docs, benchmark, window, share, name, block_bytes=block_bytes)

        def cut_all(texts: pd.Series, spans: pd.Series, n_words: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([cut(t, [(x["start"], x["end"]) for x in s], n) for t, s, n in zip(texts, spans, n_words)], columns=["over", "text"])

        found = scanned.withColumn(after, F.pandas_udf(cut_all, "over boolean, text string")("text", f"{name}.spans", f"{name}.n_words"))
    if drop:
        found = found.where(~F.col(f"{after}.over"))
    new = F.col(f"{after}.text")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length(new).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return found.withColumn("text", F.coalesce(new, F.col("text"))).select(*docs.columns)


def without(text: str, gone: list[tuple[int, int]]) -> str:
    raw = text.encode()
    folded = raw.translate(_FOLD)
    bounds, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in gone:
        kept.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        "hits.contaminated",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated, without the item passages of 13 words or more that they hold."""
    return remove_spans(docs, table(spark, sf_dir, "benchmark"), longest=12, drop=True)


#: Windows of 13 item words (or whole shorter items) against every window of the documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT i, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM v),
o AS (SELECT r, p, s.n, array_to_string(w[p : p + s.n - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) x, s WHERE p + s.n - 1 <= len(w)),
h AS (SELECT DISTINCT o.r, o.p, o.n, v.i FROM o JOIN v ON o.n = v.n AND o.g = v.g),
k AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, i FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
