"""Queries whose every value brute force can give."""

import hashlib
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from attestor.llm import decontaminate, lm_scoring, packing, repair, simhash, weighted_sampling
from attestor.llm.common import materialize
from attestor.llm.tokens import ChunkEncoder, default_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def reference_ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [t.encode(x, add_special_tokens=False).ids for x in documents["text"]]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    texts = ["", "A b", " x y it's <|endoftext|> 12 3!? é ́z Straße İstanbul ΑΣ", "\x1c\x1d a\x85b", "a" * 3000, "日本語 テキスト", "Éa, a.b. x,. y., 1,2, 3. it's. <|ENDOFTEXT|>, AB", "naïve, ǅ ﬁ ª ſ e\u0301x, ño. ß", "x…, y,… <|startoftext|>. Q"]
    ids, bounds = ChunkEncoder(entries=3).encode([x.encode() for x in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_tokenizer_on_mixtures():
    """Signs, marks, controls, special tokens and letters of many kinds, side by side."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(default_path()), np.random.default_rng(1)
    parts = [*"abAB19 .,#$*&'_<|>-\n\t\u0301\u0307éÉßİſǅﬁªΩК漢…“क़\x00\x1c\x85\xa0²½٣Ⅷ  ", "<|endoftext|>", "word", "the", "'s", "x" * 16]
    encoders = [ChunkEncoder(), ChunkEncoder(entries=20)]
    for k in range(120):
        texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(20)]
        texts = [x.replace("<|", "") for x in texts] if k % 2 else texts
        for e in encoders:
            ids, bounds = e.encode([x.encode() for x in texts])
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_base_scores_and_held_out_gain(spark, sf, documents):
    got = lm_scoring.query(spark, sf).toPandas().set_index("doc_id").sort_index()
    words = {d: [*SPACE.findall(lower(t)), ""] for d, t in zip(documents.doc_id, documents.text)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    count = {}
    for d, w in words.items():
        if not held[d]:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for d, w in words.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in count for x in w), n)
        assert np.isclose(r.base_score, sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w), rtol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_model_is_a_probability():
    """Over all classes and words, seen or not, the parts sum to one."""
    words = {b"a": 0, b"b": 1, b"c": 2}
    voc = lm_scoring.Vocabulary(words, np.array([5, 4, 3]), np.concatenate([[0, 1, lm_scoring.END_CLASS + 5], np.arange(lm_scoring.END_CLASS, lm_scoring.CLASSES)]))
    ids, bounds, rest = voc.encode([b"A b zz", None])
    assert rest == [[b"zz"], []] and bounds.tolist() == [0, 4, 5]
    rows, before = lm_scoring.contexts(ids, bounds, voc.class_of)
    w = np.random.default_rng(1).normal(size=(lm_scoring.TABLE_ROWS, lm_scoring.CLASSES)).astype(np.float32)
    every = [lm_scoring.log_classes(w, rows, np.full(len(rows), c)) for c in range(lm_scoring.CLASSES)]
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    assert before.tolist() == [lm_scoring.START, 0, 1, voc.class_of[ids[2]], lm_scoring.START]
    inside = lm_scoring.within_classes(np.ones((lm_scoring.CLASSES + 1, 3)), np.array([0, 0, 1]), np.array([5, 4, 3]))
    assert np.allclose(np.exp(inside[:, :2]).sum(axis=1), 1)


def test_score_does_not_depend_on_partitions(spark, sf, documents):
    """The same model from 1, 5 and 40 partitions, well above the unigrams on held-out texts and near an interpolated bigram."""
    docs = spark.createDataFrame(documents[["doc_id", "text"]], "doc_id long, text string")
    got = [lm_scoring.score(docs.repartition(n)).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (1, 5, 40)]
    for g in got[1:]:
        assert np.allclose(g.score, got[0].score, rtol=1e-5)
    held = got[0][got[0].held_out]
    words = {d: [*SPACE.findall(lower(t)), ""] for d, t in zip(documents.doc_id, documents.text)}
    train = [w for d, w in words.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    count, pair, follow = {}, {}, {}
    for w in train:
        for a, b in zip(["", *w], w):
            count[b] = count.get(b, 0) + 1
            if (a, b) not in pair:
                follow[a] = follow.get(a, 0) + 1
            pair[a, b] = pair.get((a, b), 0) + 1
    n, v = sum(count.values()), len(count)
    bigram = 0.0
    for d in held.doc_id:
        for a, b in zip(["", *words[d]], words[d]):
            c, t = count.get(a, 0), follow.get(a, 0)
            bigram += np.log10(pair.get((a, b), 0) / max(c + t, 1) + (t / (c + t) if c else 1) * (count.get(b, 0) + 1) / (n + v + 1))
    assert held.score.sum() > held.base_score.sum() + 0.8 * (bigram - held.base_score.sum())


def test_score_by_hand(spark):
    """Two texts, no frequent words: the score is the class softmax, the class's share of the word and the pair's share, put together."""
    rows = [(0, "aa bb aa cc"), (3, "aa bb dd"), (4, "aa bb zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scoring.score(docs, frequent=0, rounds=0).toPandas().set_index("doc_id")
    train = [t.split() + [""] for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    flat = [w for t in train for w in t]
    count = {w: flat.count(w) for w in flat}
    pairs = [p for t in train for p in zip(["", *t], t)]
    group = {w: lm_scoring.suffix_class(w.encode()) for w in {*flat, "zz", "dd", "cc"} - {""}}
    parts = {g: sum(count[w] for w in count if w and group[w] == g) + sum(1 for w in count if w and group[w] == g) + 1.0 for g in range(lm_scoring.CLUSTERS + 1, lm_scoring.CLASSES)}
    total = sum(parts.values()) + lm_scoring.CLUSTERS * 1e-6 + count[""] + 1
    for d, t in rows:
        want, last = 0.0, ""
        for w in [*t.split(), ""]:
            p = (count[""] + 1) / total if not w else (count.get(w, 0) + 1) / total
            context = count[last] if last in count else 0
            kept = {b: max(pairs.count((last, b)) - lm_scoring.DISCOUNT, 0) / context for b in count if (last, b) in pairs} if context else {}
            want += np.log10(kept.get(w, 0) + (1 - sum(kept.values())) * p)
            last = w
        assert np.isclose(got.loc[d].score, want, rtol=1e-4), d


@pytest.mark.parametrize("head, most_pairs", [(1 << 18, 1 << 18), (1 << 18, 0), (1 << 18, 5), (4, 1 << 18), (4, 2), (0, 0)])
def test_no_pair_is_dropped(spark, head, most_pairs):
    """Neither a bound on broadcast pairs nor one on head words takes a pair's share away: scores equal those of all pairs."""
    rng = np.random.default_rng(7)
    words = [*"abcdefghij", "Éé", "a-word-of-more-than-sixteen-letters", "x" * 70]
    rows = [(d, " ".join(rng.choice(words, rng.integers(0, 12), p=np.arange(13, 0, -1) / 91))) for d in range(60)] + [(60, "new a b new new"), (61, None)]
    rows += [(d, "unseen a unseen b c j") for d in range(62, 300) if zlib.crc32(str(d).encode()) % 7 == 2]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=0, rounds=0, head=head, most_pairs=most_pairs).toPandas().set_index("doc_id")
    train = [[*SPACE.findall(lower(t)), ""] for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    flat = [w for t in train for w in t]
    count, pair = {w: flat.count(w) for w in flat}, {}
    for t in train:
        for p in zip(["", *t], t):
            pair[p] = pair.get(p, 0) + 1
    classes = {lm_scoring.suffix_class(w.encode()) for w in {*words, "new", "unseen"}}
    per_class = sum(count[w] + 1.0 for w in count if w) + lm_scoring.SUFFIXES
    total = per_class + lm_scoring.CLUSTERS * 1e-6 + count[""] + 1
    assert len(classes) > 1 and len(got) == len(rows)
    for d, t in rows:
        want, last = 0.0, ""
        for w in [*SPACE.findall(lower(t)), ""]:
            follow = [n for (a, _), n in pair.items() if a == last]
            left = lm_scoring.DISCOUNT * len(follow) / count[last] if follow else 1
            own = (pair[last, w] - lm_scoring.DISCOUNT) / count[last] if (last, w) in pair else 0
            want += np.log10(own + left * (count.get(w, 0) + 1) / total)
            last = w
        assert np.isclose(got.loc[d].score, want, rtol=1e-5), d


def test_pairs_pack_and_unpack():
    key = np.unique(np.random.default_rng(5).integers(0, 300_000**2, 2000))
    n = np.random.default_rng(6).integers(1, 400, len(key)) ** 3
    a, b = lm_scoring.unpack_pairs(lm_scoring.pack_pairs(key, n, 300_000), 300_000)
    assert (a == key).all() and (b == n).all()
    assert len(lm_scoring.unpack_pairs(lm_scoring.pack_pairs(key[:0], n[:0], 7), 7)[0]) == 0
    table = lm_scoring.PairTable(key, np.log(n).astype(np.float32))
    at, value = table.find(np.concatenate([key[::3], key[::3] + 1]))
    assert set(range(len(key[::3]))) <= set(at.tolist()) and np.allclose(value[at < len(key[::3])][np.argsort(at[at < len(key[::3])])], np.log(n[::3]), rtol=1e-5)


def test_tokens_sent_to_the_pair_table_in_little_memory():
    """They come back whole from batches that are small, take fewer than 14 bytes each, and need little beside what is held of them."""
    rng, n = np.random.default_rng(8), 600_000
    key = np.concatenate([rng.integers(0, 1 << 36, n - 5000), -rng.integers(1, 1 << 62, 5000)])
    block, log_p, text = np.where(key < 0, 50 + key % 9, key % 50), -rng.gamma(2, 4, n).astype(np.float32), rng.integers(0, 4000, n).astype(np.uint16)
    log_p[::1000] = np.inf
    want = sorted(zip(block.tolist(), key.tolist(), log_p.tolist(), text.tolist()))
    tracemalloc.start()
    try:
        tokens = [tuple(x[a : a + 50_000].copy() for x in (block, key, log_p, text)) for a in range(0, n, 50_000)]
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        batches = 0
        got = []
        for b in lm_scoring.asked(3, tokens):
            batches += 1
            assert b.nbytes < 2 * lm_scoring.BATCH_BYTES and set(b["part"].to_pylist()) == {3}
            got.append((b["block"].to_pylist(), b["data"].to_pylist()))
        assert tracemalloc.get_traced_memory()[1] < 3 * held
    finally:
        tracemalloc.stop()
    assert batches > 1 and not tokens
    rows = [(j, x) for there, data in got for j, x in zip(there, data)]
    assert sum(len(x) for _, x in rows) < 9 * n
    back = [(j, *t) for j, x in rows for t in zip(*(v.tolist() for v in lm_scoring.unpack_asked(x)))]
    assert sorted(back) == want
    assert list(lm_scoring.asked(0, [(block[:0], key[:0], log_p[:0], text[:0])])) == []


def test_pair_table_is_made_in_little_memory():
    key = np.unique(np.random.default_rng(9).integers(0, 1 << 36, 1_000_000))
    number = np.arange(len(key), dtype=np.float32)
    tracemalloc.start()
    try:
        table = lm_scoring.PairTable(key, number)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.25 * (table.key.nbytes + table.value.nbytes)
    at, value = table.find(key)
    assert (np.sort(at) == np.arange(len(key))).all() and (value == number[at]).all()


def test_shuffles_of_the_last_query_are_dropped(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x.rsplit("/", 1)[-1] for x in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x and x.endswith(".data")}

    before = shuffles()
    materialize(spark.range(50_000).repartition(4, "id").sortWithinPartitions("id"), "shuffled")
    mine = shuffles() - before
    lm_scoring.drop_shuffles(spark)
    for _ in range(50):
        if mine.isdisjoint(shuffles()):
            break
        time.sleep(0.1)
    assert mine and mine.isdisjoint(shuffles())


@pytest.mark.parametrize("n", [0, 1, 900, 40_000])
def test_press(n):
    rng = np.random.default_rng(n)
    want = [rng.integers(-(1 << 62), 1 << 62, n), rng.integers(0, 3, n).astype("u1"), rng.normal(size=n).astype("<f4"), np.arange(n, dtype="<u4"), np.zeros(n // 3, "<i8")]
    blob = b"xyz" + lm_scoring.press(*want) + b"z"
    got, end = lm_scoring.unpress(blob, 3, *((x.dtype.str, len(x)) for x in want))
    assert end == len(blob) - 1 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want))


def test_lm_odd(odd, empty):
    got = lm_scoring.score(odd).toPandas()
    assert len(got) == 11 and np.isfinite(got[["base_score", "score"]]).all().all()
    assert (got[got.doc_id.isin([2, 3, 4])].n_tokens == 1).all()
    assert lm_scoring.score(empty).count() == 0


def test_packing(spark, sf, documents, reference_ids):
    got = packing.query(spark, sf).toPandas()
    want = {}
    for d, ids in zip(documents.doc_id, reference_ids):
        ids = [*ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[d, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    check_packing(got, 4096)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def check_packing(got, capacity):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity


def test_packing_odd(odd, empty):
    got = packing.pack(odd, capacity=64).toPandas()
    check_packing(got, 64)
    assert (got[got.doc_id.isin([2, 3, 4])].length == 1).all() and len(got[got.doc_id == 5]) == 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(rng.integers(1, 257, 4000) if seed else np.full(500, 200), minlength=257)
    plan = packing.plan(h, 256)
    used = np.zeros(257, int)
    for p, n in plan:
        assert n > 0 and sum(p) <= 256
        for x in p:
            used[x] += n
    assert (used == h).all()
    least = -(-(h * np.arange(257)).sum() // 256) if seed else 500
    assert sum(n for _, n in plan) <= least * 1.01 + 1


def test_token_files(spark, sf, documents, reference_ids):
    got = repair.query(spark, sf).toPandas().set_index("doc_id").sort_index()
    start = 0
    for d, ids in zip(documents.doc_id, reference_ids):
        ids = np.array([*ids, 2], "<u4")
        r = got.loc[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_odd(odd, empty):
    got = repair.read_files(repair.write_files(odd, shard_tokens=50)).toPandas().sort_values("start")
    assert len(got) == 11 and got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    assert repair.read_files(repair.write_files(empty)).count() == 0


@pytest.mark.parametrize("ids", [np.array([7]), np.full(1001, 3), np.tile([1, 2, 3, 1, 2], 300), np.random.default_rng(3).integers(0, 9, 20000), np.repeat(np.arange(5), 37)])
def test_grammar_round_trip_and_random_access(ids):
    data = repair.write_shard(ids.astype(np.uint32), [len(ids)])
    s = repair.Shard(data)
    assert (s.ids() == ids).all()
    for a in range(0, len(ids), max(1, len(ids) // 17)):
        assert (s.ids(a, a + 13) == ids[a : a + 13]).all()
    if len(ids) > 1000 and ids.max() < 9:
        assert s.n < len(ids)


def test_grammar_is_exhausted():
    """No pair that comes `least` times is left, beyond overlaps in runs of one symbol."""
    ids = np.random.default_rng(4).zipf(1.3, 60000) % 500
    rules, lengths, symbols = repair.compress(ids, 500)
    key = (symbols[:-1] << 32) | symbols[1:]
    pairs, times = np.unique(key[symbols[:-1] != symbols[1:]], return_counts=True)
    assert times.max() < 12 and len(rules) == len(lengths) > 100


def test_a_range_reads_only_its_blocks(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 70000, 50000).astype(np.uint32)
    s = repair.Shard(repair.write_shard(ids, [len(ids)]))
    read, plain = [], repair._from_planes
    monkeypatch.setattr(repair, "_from_planes", lambda data, n, width, a, b: read.append(b - a) or plain(data, n, width, a, b))
    assert (s.ids(20000, 20010) == ids[20000:20010]).all() and sum(read) <= 2 * repair.STEP


def test_operators_agree_on_the_session(spark, odd):
    """The one setting they lower is the same for all, and a smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, want in (("10000", "512"), ("100", "100"), ("0", "512")):
        spark.conf.set(key, given)
        repair.read_files(repair.write_files(odd)).count()
        weighted_sampling.fingerprint_edits(odd).count()
        assert spark.conf.get(key) == want


def test_decontamination_brute_force(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    compare_hits(decontaminate.query(spark, sf).toPandas(), zip(documents.doc_id, documents.text), zip(items.item_id, items.text))


def compare_hits(got, docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = rx.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    got = got.set_index("doc_id")
    for d, t in docs:
        w = rx.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (o := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= o
        r = got.loc[d]
        r = r if r.ndim == 1 else r.iloc[0]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("block_bytes", [10**6, 150])
def test_decontamination_small_items(spark, odd, block_bytes):
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(rng.choice(list("abcd"), rng.integers(0, 60)))) for k in range(120)]
    items = [(k, " ".join(rng.choice(list("abcd"), rng.integers(0, 16)))) for k in range(25)] + [(3, "a b"), (99, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judged(d, b, block_bytes=block_bytes)
    from pyspark.sql import functions as F

    got = found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").alias("n_items"), F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), "hits.contaminated").toPandas()
    compare_hits(got, docs, items)
    assert decontaminate.judged(odd, b).count() == 11
    cut = decontaminate.remove_spans(d, b, block_bytes=block_bytes).toPandas()
    assert all(len(t) <= len(dict(docs)[k]) for k, t in zip(cut.doc_id, cut.text))


def test_a_worker_builds_each_block_once(spark, monkeypatch):
    """Twenty blocks over ten batches take twenty automata, one held at a time, as each block is a job of its own."""
    import pandas as pd

    built = []
    plain = decontaminate.Automaton
    monkeypatch.setattr(decontaminate, "Automaton", lambda items, window: built.append(len(items)) or plain(items, window))

    class Shared:
        def __init__(self, value):
            self.value = value

    for k in range(20):
        scan = decontaminate._scanner(Shared([(str(k), b"a b c d")]), 13).func
        for _ in range(10):
            scan(pd.Series([b"x a b c d y", None]))
        assert len(decontaminate._built) == 1
    assert len(built) == 20


def test_the_stage_cuts_passages(spark, sf, tmp_path):
    """A passage of 13 words goes from a document under the coverage limit, one over it goes whole, others stay as they are."""
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, "Start, " + item.upper() + "; " + "x " * 900, 7), (2, item, 8), (3, "a  clean\ttext q1 q2", 9), (4, "q30 " + "y " * 100, 3)]
    spark.createDataFrame([(1, item), (2, "q30")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.stage(spark, docs, str(tmp_path)).collect()}
    cut = "Start, ; " + "x " * 900
    assert got == {1: (cut, len(cut)), 3: (rows[2][1], 9), 4: (rows[3][1], 3)}


def test_spans_are_cut_out():
    assert decontaminate.without("Keep THIS, cut-that one; end.", [(2, 4)]) == "Keep THIS,  one; end."


def brute_fingerprint(t):
    w = [x.encode() for x in SPACE.findall(lower(t))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in distinct}


def test_simhash(spark, sf, documents):
    got = simhash.query(spark, sf).toPandas().set_index("doc_id").sort_index()
    fps = [brute_fingerprint(t) for t in documents.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    root = brute_components(fps)
    least = {}
    for d, f in zip(documents.doc_id, fps):
        least[root[f]] = min(d, least.get(root[f], d))
    assert got.component_id.tolist() == [least[root[f]] for f in fps]


def test_links_of_crowded_shards(spark):
    """Chains and crowds that outgrow a shard are dealt by further blocks and lose no connection."""
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(150)}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = simhash.components(simhash.links(df, shard=8)).toPandas()
    mine = {int(np.int64(a).astype(np.uint64)): int(b) for a, b in zip(got.node, got.root)}
    root = brute_components(fps)
    groups, ours = {}, {}
    for f in fps:
        groups.setdefault(root[f], set()).add(f)
        ours.setdefault(mine.get(f, f"single {f}"), set()).add(f)
    for r in [x for x in ours if isinstance(x, int)]:
        ours[r].add(int(np.int64(r).astype(np.uint64)))
    singles = [x for x in ours if not isinstance(x, int)]
    for s in singles:
        if any(len(v) > 1 and next(iter(ours[s])) in v for k, v in ours.items() if k != s):
            ours.pop(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_simhash_odd(spark, odd, empty):
    fps, found = simhash.clusters(odd)
    got = fps.join(found, "fp").toPandas()
    assert len(got) == 11 and set(got[got.doc_id.isin([2, 3, 4])].component_id) == {2} and set(got[got.doc_id.isin([1, 5])].component_id) == {1}
    kept = simhash.stage(spark, odd, "").toPandas()
    assert sorted(kept.doc_id.fillna(-1)) == [-1, 1, 2, 7, 8, 9, 10] and list(kept.columns) == odd.columns
    assert simhash.stage(spark, empty, "").count() == 0


def test_fingerprints(spark, sf, documents):
    got = weighted_sampling.query(spark, sf).toPandas().set_index("doc_id").sort_index()
    check_fingerprints(got, documents.doc_id.tolist(), documents.text.tolist())


def check_fingerprints(got, ids, texts):
    jaccards, near = [], []
    for k, (d, t) in enumerate(zip(ids, texts)):
        other = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got.loc[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == weighted_sampling.as_text(weighted_sampling.signature(t.encode()))
        a, b, c = (dict(zip(*(x.tolist() for x in weighted_sampling.terms(x.encode())))) for x in (t, edited, other))
        for x, y in ((b, r.near_edited), (c, r.near_next)):
            both = set(a) | set(x)
            j = sum(min(a.get(w, 0), x.get(w, 0)) for w in both) / max(1, sum(max(a.get(w, 0), x.get(w, 0)) for w in both))
            if a and x:
                jaccards.append(j), near.append(y)
    error = np.array(near) - np.array(jaccards)
    assert abs(error.mean()) < 0.01 and np.sqrt((error**2).mean()) < 0.05


def test_weighted_terms_collide_as_generalised_jaccard():
    a = ("x " * 30 + "y " * 5 + "z " * 10).encode()
    b = ("x " * 10 + "y " * 15 + "z " * 10).encode()
    j = (10 + 5 + 10) / (30 + 15 + 10)
    rates = [weighted_sampling.likeness(*(weighted_sampling.signature(t.replace(b"x", b"x%d" % k).replace(b"y", b"y%d" % k).replace(b"z", b"z%d" % k), 1) for t in (a, b))) for k in range(60)]
    assert abs(np.mean(rates) - j) < 0.03


def test_fingerprints_odd(spark, odd, empty):
    got = weighted_sampling.fingerprint_edits(odd).toPandas()
    assert len(got) == 11 and got[got.doc_id.isin([2, 3, 4])].fingerprint.nunique() == 1
    assert weighted_sampling.fingerprint_edits(empty).count() == 0
    one = weighted_sampling.fingerprint_edits(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_within_classes_settles_on_extreme_counts():
    """Words that are rare but for one class before: the fit stays near the counts' shares and never far below them."""
    counts = np.array([100_000, 50, 40, 3])
    follows = np.zeros((lm_scoring.CLASSES + 1, 4))
    follows[0], follows[1] = [90_000, 0, 0, 0], [0, 900, 1, 0]
    got = np.exp(lm_scoring.within_classes(follows, np.zeros(4, int), counts))
    assert np.allclose(got.sum(axis=1), 1) and got[0, 0] > 0.99 and got[1, 1] > 0.97 and got[1, 0] < 0.05
    assert np.allclose(got[5], (counts + 1) / (counts + 1).sum())
