"""The pipeline's near-duplicate stage against brute force over five-word shingles and fingerprints."""

import random
from collections import defaultdict

import numpy as np

from attestor.llm import simhash
from test_counts_and_digests import brute_fingerprint


def shingles(text, n=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)} if words else set()


def brute_groups(rows):
    """id -> the smallest id of its group: at most three differing bits, or a Jaccard similarity of 0.8 or more."""
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    sets = {i: shingles(t) for i, t in rows}
    fps, by_fp, holders = {i: brute_fingerprint(t) for i, t in rows}, {}, defaultdict(list)
    for i in ids:
        link(i, by_fp.setdefault(fps[i], i))
        for s in sets[i]:
            holders[s].append(i)
    values = np.array(list(by_fp), np.uint64)
    for f, i in by_fp.items():
        for g in values[np.bitwise_count(values ^ np.uint64(f)) <= 3].tolist():
            link(i, by_fp[g])
    for i in ids:
        common = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                common[j] += j < i
        for j, c in common.items():
            if c and 10 * c >= 8 * (len(sets[i]) + len(sets[j]) - c):
                link(i, j)
    return {i: root(i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_against_brute_force(spark):
    """Copies with a few words changed (similarity from 0.6 to 0.99), a chain of edits, and clean texts."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 500))]
        rows.append(" ".join(base))
        rows += [edited(rng, base, max(1, len(base) // d)) for d in (30, 50, 60, 80, 100)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 300))) for _ in range(100)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want = brute_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[got[i]] == want[i] for i in want)  # nothing is joined that brute force keeps apart
    assert len(set(got.values())) <= len(set(want.values())) + 2  # a link at just 0.8 is found in 99 of 100 cases
    assert len(set(want.values())) < 200


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """More near copies than a tree or a shard takes are one group still."""
    monkeypatch.setattr(simhash, "CROWDED", 200)
    monkeypatch.setattr(simhash, "SHARD", 64)
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(k, edited(rng, base, 3)) for k in range(900)] + [(1000 + k, edited(rng, base, 150)) for k in range(20)]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").toPandas()
    assert sorted(kept.doc_id) == [0, *range(1000, 1020)]


def test_the_tables_groups(spark, sf, documents):
    want = brute_groups(list(zip(documents.doc_id, documents.text)))
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


def family(rng, members, planted):
    """Texts of one template with own tails, any two at about 0.75, and for some of them a copy just over 0.8."""
    def tail(n):
        return [f"o{rng.randrange(10**9)}" for _ in range(n)]

    common = [f"c{k}" for k in range(204)]
    texts = [common + tail(33) for _ in range(members)]
    texts += [t[: 204 + 12] + tail(21) for t in texts[:planted]]
    rows = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(rows)
    return rows


def test_planted_pairs_in_a_template(spark):
    """Likelier candidates that the exact check rejects don't take the place of a true partner."""
    rows = family(random.Random(8), 300, 40)
    want = brute_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len(set(want.values())) > 200


def test_copies_that_differ_in_repeats(spark):
    """Sets of shingles that are (all but) equal, from texts that repeat a line twice or thirty times."""
    rng = random.Random(9)
    rows = []
    for k in range(30):
        base, line = ([f"{x}{k}w{rng.randrange(10**6)}" for _ in range(n)] for x, n in (("b", 600), ("l", 20)))
        rows += [(2 * k, " ".join(base + line * 2)), (2 * k + 1, " ".join(base + line * 30))]
    far = sum((simhash.majority(simhash.shingle_values(a.encode().split(), 5)) ^ simhash.majority(simhash.shingle_values(b.encode().split(), 5))).bit_count() > 18 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    assert far > 5
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows) == {k: k - k % 2 for k in range(60)}


def test_planted_pairs_in_a_crowd(spark, monkeypatch):
    """Shingles that more texts hold than CROWDED are compared block by block, and no pair is parted."""
    monkeypatch.setattr(simhash, "CROWDED", 50)
    rows = family(random.Random(10), 300, 40)
    cells = []
    plain = simhash._cells
    monkeypatch.setattr(simhash, "_cells", lambda e: cells.append(plain(e).agg({"cell": "max"}).first()[0]) or plain(e))
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cells[0] > 10
    assert got == brute_groups(rows)


def test_rows_without_an_id_or_with_a_shared_one(spark):
    """A component is known by its root: unrelated texts stay, whether their ids are null or equal."""
    rng = random.Random(11)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (5, d), (5, e), (6, d), (7, e), (5, e), (8, f)]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (1, c), (5, d), (5, e), (8, f)])
