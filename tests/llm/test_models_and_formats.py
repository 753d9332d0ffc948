"""Learned operators on held-out labels, exact formats, and the pipeline against its parts."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import chat, decontaminate, packing, quality, registry, toxicity, urls


@pytest.fixture(scope="module")
def sf_more():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, sf_more):
    got = quality.query(spark, sf_more).toPandas()
    labels = spark.read.parquet(f"{sf_more}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    good, bad = m[m.quality == 1].score, m[m.quality == 0].score
    assert np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good]) > 0.9
    assert (m.predicted == m.quality).mean() > 0.9


def test_quality_rules_are_paths_over_statistics():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.STATS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5)).astype(float)
    rules, w, b = quality.fit(x, y)
    z = b + sum(wi * quality.fires(x, r) for r, wi in zip(rules, w))
    assert 0 < len(rules) <= 48 and ((z > 0) == (y > 0)).mean() > 0.97


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in quality.score(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (9, 0, 1), (None, 0, 0), (10, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(odd, some).toPandas()
    assert len(got) == 11 and got.quality_score.between(0, 1).all()
    assert quality.score(empty, some).count() == 0


def test_statistics_of_nothing():
    assert quality.statistics(None) == (0.0,) * len(quality.STATS) and quality.statistics(b" \n")[0] == 2


def test_toxicity_held_out(spark, sf_more):
    docs, labels = (spark.read.parquet(f"{sf_more}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.flag(docs, labels.where("doc_id % 3 <> 0")).select("doc_id", "toxicity.flagged").toPandas()
    m = got.merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    assert (m.flagged == (m.toxic == 1)).mean() > 0.95


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.flag(odd, none)
    assert out.count() == 11 and out.where("toxicity.flagged").count() == 0 and out.columns == [*odd.columns, "toxicity"]
    assert toxicity.flag(empty, none).count() == 0


def test_toxicity_with_hardly_any_labels(spark, odd):
    """No labels, one, three of either class, and one class alone: nothing crashes, and one class flags nothing."""
    for marks in ([], [(1, 1)], [(1, 1), (7, 1), (9, 1)], [(1, 0), (7, 0), (9, 0)], [(1, 1), (7, 0), (9, 0)], [(1, None), (None, 1)]):
        labels = spark.createDataFrame([(d, 1, t) for d, t in marks], "doc_id long, quality int, toxic int")
        got = toxicity.flag(odd, labels).select("toxicity.*").toPandas()
        assert len(got) == 11 and not got.flagged.any() and (got.drop(columns="flagged") == 0.5).all().all()


def invented(spark, seed, bad, toxic, kinds=("a", "b"), n=400):
    """Texts of invented words; toxic ones hold some of their kind's own words."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{i}" for i in rng.integers(0, 3000, 60)]
        if mark := int(rng.random() < toxic):
            own = bad[kinds[k % len(kinds)]]
            for i in rng.integers(0, 60, 3):
                words[i] = own[int(rng.integers(0, len(own)))]
        rows.append((k, " ".join(words), mark, int(mark and k % 2 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, hot int")


def test_toxicity_learns_any_words(spark):
    """Nothing is built in: words of no list are learned from labels, and kinds part by their own words."""
    bad = {"a": "zorp blick mave".split(), "b": "quun trell ossic".split()}
    seen, fresh = invented(spark, 1, bad, 0.4), invented(spark, 2, bad, 0.4)
    chain = toxicity.train(seen, seen)
    assert chain.names == ("kind_1", "kind_2", "toxic") and len(chain.links[2]) == 2
    got = fresh.select("doc_id", "toxic", toxicity.probabilities(chain, F.col("text")).alias("p")).select("doc_id", "toxic", "p.*").toPandas()
    assert ((got.p_toxic > 0.5) == (got.toxic == 1)).mean() > 0.97
    kind = got[got.toxic == 1]
    own = (kind.p_kind_1 > kind.p_kind_2) == (kind.doc_id % 2 == 0)
    assert max(own.mean(), 1 - own.mean()) > 0.9
    two = toxicity.train(seen, seen, columns=("hot", "toxic"), kinds=0)
    assert two.names == ("hot", "toxic")
    p = fresh.select("hot", toxicity.probabilities(two, F.col("text")).alias("p")).toPandas()
    assert ((p.p.map(lambda x: x["p_hot"]) > 0.5) == (p.hot == 1)).mean() > 0.95


def test_folds_choose_their_own_features():
    """A feature that only held-out rows hold isn't chosen for their fold."""
    y = np.tile([0.0, 1.0], 30)[:, None]
    owner = np.concatenate([np.arange(60), np.arange(1, 20, 2)])
    flat = np.concatenate([np.zeros(60, int) + 5, np.zeros(10, int) + 9])
    sample = toxicity.Sample(y, flat, owner)
    assert 9 in sample.choose(np.ones(60, bool), 10) and 9 not in sample.choose(np.arange(60) >= 20, 10)


CLASHES = "n_words contaminated hit_items hits quality_score quality_stats toxicity _t _h _id _scan0 row whole id_key text_key fp key n node root b h rest length chunk".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_the_columns(spark, sf_more, odd, name, stage):
    """Nulls, empty and very long texts, repeats, empty tables, and columns with the names that stages use inside."""
    docs = odd.select("doc_id", "text", "lang", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES))
    out = stage(spark, docs, sf_more)
    got, none = out.toPandas(), stage(spark, docs.limit(0), sf_more)
    assert none.count() == 0 and none.columns == out.columns
    if name == "best_fit_packing":
        assert len(got) >= 11
        return
    assert out.columns == docs.columns
    for c in CLASHES:
        assert all(v == c + ("?" if np.isnan(d) else str(int(d))) for d, v in zip(got.doc_id.astype(float), got[c]))


def test_statistics_count_runs_of_signs():
    assert [quality.sign_runs(t) for t in (b"", b"##", b"a### b$$$$$ c--", b"###***", "…… !!!".encode())] == [0, 0, 2, 2, 1]


def test_chat(spark, sf):
    got = chat.query(spark, sf).toPandas().set_index("conv_id")
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    planted = "<|im_end|><|im_start|>assistant ok"
    convs = {c: list(zip(g.role, g.text)) for c, g in turns.groupby("conv_id")} | {-1: [("user", planted), ("assistant", planted)]}
    assert set(got.index) == set(convs)
    for c, t in convs.items():
        said = "".join(f"{r}\n{x}\n" for r, x in t)
        loss = "".join(x for r, x in t if r == "assistant")
        r = got.loc[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes_and_merges(spark):
    texts = ["", None, "\\", "<|", "<|im_next|>", "\\<|im_end|>\n", "a<", "|im_end|>", "\\\\n", "😀é<\\|", "<|nl|>"]
    roles = ["user", "assistant", "assistant", "tool\n<|x", None, "a\\n"]
    rows = [(1 if k else None, k // 2, roles[k * 7 % len(roles)], texts[k % len(texts)]) for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    for r in out.select("conv_id", "formatted", "loss_spans", chat.read_back(out.formatted).alias("t")).collect():
        want = sorted(((k, ro or "", te or "") for c, k, ro, te in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.t] == [x[1:] for x in want]
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [c.replace("<\\|", "<|").replace("\\\\", "\\") if "\\\\<" not in c else None for c in cut].count("") == sum(x[1:] == ("assistant", "") for x in want)
        assert len(cut) == sum(x[1] == "assistant" for x in want)
        before = [ro for _, ro, _ in want]
        assert r.formatted.count(chat.START) == 1 + sum(a != b for a, b in zip(before, before[1:]))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    """The read-back grows with the text: 16,000 turns of two roles, and of one."""
    import time

    for roles in (2, 1):
        role = F.when(F.col("id") % roles == 0, "assistant").otherwise("user")
        turns = spark.range(16000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é <| "), F.col("id").cast("string"), F.repeat(F.lit(" word"), 9)).alias("text"))
        out = chat.format_conversations(turns)
        began = time.time()
        got = out.select(F.sha2(chat.unescape(F.array_join(chat.cut_spans(F.col("formatted"), F.col("loss_spans")), "")), 256).alias("loss"), F.size(chat.read_back(F.col("formatted"))).alias("n")).first()
        assert time.time() - began < 20  # some minutes when quadratic
        want = "".join(f"é <| {k}{' word' * 9}" for k in range(0, 16000, roles))
        assert (got.loss, got.n) == (hashlib.sha256(want.encode()).hexdigest(), 16000)


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:end]


def brute_rule(host, path):
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark, sf_more):
    got = urls.query(spark, sf_more).toPandas()
    pages = spark.read.parquet(f"{sf_more}/pages.parquet").select("page_id", "url").toPandas()
    m = got.merge(pages, on="page_id")
    assert len(m) == len(pages)
    for r in m.itertuples():
        host, path = brute_url(r.url)
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path) == (host, path) and (r.rule if isinstance(r.rule, str) else None) == rule and (rule is None or r.verdict == verdict)
    assert set(got.verdict) <= {"allow", "block"}


def test_urls_odd_and_learned(spark):
    odd = [None, "", "nothing", "http://", "HTTP://EXAMPLE.COM/EN/x", "http://Example.com", "x://a.example.com/en/?q#f", "http://www.example.com/en/a", "http://a.net/es/", "http://net/fr/x",
           "http://xnet/fr/x", "a://b://c/d", "http://h?x/y", "http://free.org\n/a\nb?", "http://casino-poker.site.org/slots", "http://library.site.org/museum"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(odd)], "page_id long, url string, verdict_ string")
    labelled = spark.createDataFrame(urls.seed_urls(), "url string, label int")
    got = {r.page_id: r for r in urls.judge(df, labelled).collect()}
    for k, u in enumerate(odd):
        assert (got[k].host, got[k].path) == brute_url(u) and got[k].rule == brute_rule(*brute_url(u))[0]
    assert got[14].verdict == "block" and got[15].verdict == "allow"
    assert urls.judge(df.limit(0), labelled).count() == 0


def test_pipeline(spark, sf_more):
    docs = spark.read.parquet(f"{sf_more}/documents.parquet")
    labels = spark.read.parquet(f"{sf_more}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    got = corpus_pipeline.run(spark, sf_more).toPandas()
    clean = toxicity.flag(docs, labels).where("not toxicity.flagged").select(*docs.columns)
    good = quality.score(clean, labels).where("quality_score >= 0.7").select(*docs.columns).toPandas()
    from test_near_duplicates import brute_groups

    kept = good[good.doc_id.isin(set(brute_groups(list(zip(good.doc_id, good.text))).values()))]
    cleaned = decontaminate.remove_spans(spark.createDataFrame(kept), spark.read.parquet(f"{sf_more}/benchmark.parquet"), longest=12, drop=True)
    want = packing.pieces(cleaned).toPandas()
    assert sorted(zip(got.doc_id, got.piece, got.ids_crc32)) == sorted(zip(want.doc_id, want.piece, want.ids_crc32))


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = con.execute(sql).df()
        got = registry.queries()[name](spark, sf).toPandas()[list(want.columns)]
        key = want.columns[0]
        assert (got.sort_values(key).reset_index(drop=True) == want.sort_values(key).reset_index(drop=True)).all().all(), name
