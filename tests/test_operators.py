"""Operators at their edges: nulls, ties, hot keys, empty tables; and what the catalogue's SQL can't say."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import longitudinal as L
from attestor.operators import measures as M
from attestor.operators import relational as R
from attestor.operators import similarity
from attestor.operators import validation as V
from attestor.plans import stages
from attestor.sources import files


def test_best_per_key_nulls_lose(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 3, "b"), (1, 5, "c"), (2, None, "d"), (None, 1, "e")], "k int, o int, v string")
    assert sorted(r.v for r in R.best_per_key(df, ["k"], ["o"]).collect()) == ["c", "d", "e"]
    assert sorted(r.v for r in R.best_per_key(df, ["k"], ["o"], latest=False).collect()) == ["b", "d", "e"]
    assert R.best_per_key(df.limit(0), ["k"], ["o"]).count() == 0 and R.best_per_key(df, ["k"], ["o"]).columns == df.columns


def test_a_hot_key_is_limited_before_the_shuffle(spark):
    plan = R.best_per_key(spark.range(10).selectExpr("id % 2 k", "id o"), ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_as_of_across_buckets(spark):
    rng = random.Random(3)
    stamp = lambda m: f"2024-01-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}:00"
    facts = [(i, rng.choice([1, 1, 1, 2, None]), rng.randrange(20 * 1440)) for i in range(400)]
    marks = [(rng.choice([1, 1, 2, None]), rng.randrange(20 * 1440), rng.choice([rng.randrange(50), None])) for _ in range(60)]
    f = spark.createDataFrame([(i, k, stamp(m)) for i, k, m in facts], "i int, k int, at string").withColumn("at", F.to_timestamp("at"))
    g = spark.createDataFrame([(k, stamp(m), v) for k, m, v in marks], "k int, since string, v int").withColumn("since", F.to_timestamp("since"))
    for bucket in ("day", "hour", "month"):
        got = {r.i: r.v for r in R.as_of(f, g, ["k"], "at", "since", "v", bucket).collect()}
        for i, k, m in facts:
            before = [(n, v) for k2, n, v in marks if k2 == k and n <= m and v is not None]
            assert got[i] == (max(before)[1] if before else None)


def test_line_starts(spark):
    rng = random.Random(4)
    texts = ["", "\n", "a", "a\nbb\n\nccc", "\n".join("x" * rng.randrange(9) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("lines", F.split("t", "\n"))
    for r in df.select("t", R.line_starts(F.col("lines")).alias("s")).collect():
        want, at = [], 0
        for line in r.t.split("\n"):
            want.append(at)
            at += len(line) + 1
        assert r.s == want


def test_containing_moves_no_text_with_words(spark):
    texts = spark.createDataFrame([(1, "the red fox ran off"), (2, "a red foxes ran"), (3, None), (4, "")], "d int, t string")
    quotes = spark.createDataFrame([(1, "red fox ran"), (2, "fox"), (3, "no such words here")], "q int, w string")
    got = sorted((r.d, r.q) for r in R.containing(texts, quotes, "t", "w", "d", "q").collect())
    assert got == [(1, 1), (1, 2), (2, 2)]


def brute_links(rows):
    sets = {}
    for k, t in rows:
        w = t.lower().split()
        sets.setdefault(frozenset(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset(), []).append(k)
    name = {s: min(ks) for s, ks in sets.items()}
    links = {c: sum(1 for o, d in name.items() if d != c and s and o and len(s & o) >= 0.8 * len(s | o)) for s, c in name.items()}
    return {k: (name[s], links[name[s]]) for s, ks in sets.items() for k in ks}


@pytest.mark.parametrize("crowd", [4096, 7])
def test_similar_texts_by_cells(spark, crowd):
    """A template that all share, so that its shingles are crowded, and near copies at many levels: every link is found."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    rows = [(k, " ".join(common + [f"o{rng.randrange(10**6)}" for _ in range(15)])) for k in range(60)]
    for k in range(60, 120):
        words = rows[k - 60][1].split()
        words[rng.randrange(len(words)) :] = [f"x{k}"] * rng.randrange(6)
        rows.append((k, " ".join(words)))
    rows += [(200, ""), (201, " "), (202, "one two"), (203, rows[0][1])]
    got = {r.k: (r.class_id, r.links) for r in similarity.similar_texts(spark.createDataFrame(rows, "k int, t string"), "k", "t", crowd=crowd).collect()}
    assert got == brute_links(rows) and any(n for _, n in got.values())


def test_cells_meet_once(spark):
    entries = spark.createDataFrame([(c, 7, 50) for c in range(50)] + [(c, 8, 2) for c in range(2)], "c long, t long, f long")
    cells = {}
    for r in similarity.in_cells(entries, "c", "t", "f", 8).collect():
        cells.setdefault((r.t, r.cell), set()).add(r.c)
    for t, n in ((7, 50), (8, 2)):
        for a in range(n):
            for b in range(a):
                assert sum(k[0] == t and {a, b} <= v for k, v in cells.items()) >= 1
    assert max(len(v) for v in cells.values()) < 40


def test_document_errors():
    schema = {
        "type": "object", "additionalProperties": False, "required": ["id", "when"], "$defs": {"tag": {"enum": ["a", "b"]}},
        "properties": {"id": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^x"}, "when": {"type": "string", "format": "date"}, "at": {"type": ["string", "null"], "format": "date-time"}, "n": {"type": "integer", "minimum": 0, "maximum": 9}, "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/tag"}}, "more": {"type": "object", "additionalProperties": {"type": "boolean"}}},
    }
    assert V.document_errors(schema, {"id": "xyz", "when": "2022-01-31", "at": None, "n": 3, "tags": ["a", "b"], "more": {"k": True}}) == []
    bad = V.document_errors(schema, {"id": "yyyyy", "when": "2022-02-31", "at": "noon", "n": True, "tags": ["a", "a", "c"], "more": {"k": 1}, "extra": 1})
    assert bad == ["$.at: not a date-time", "$.extra: not allowed", "$.id: does not match", "$.id: too long", "$.more.k: not of type boolean", "$.n: not of type integer", "$.tags: repeated items", "$.tags[2]: not in enum", "$.when: not a date"]
    assert V.document_errors(schema, []) == ["$: not of type object"] and V.document_errors(schema, {}) == ["$.id: required", "$.when: required"]


def test_seeded_sample_is_the_generators_own(spark):
    rows = [(f"{k:010d}", ["73", "unknown", "OTHER" if k % 3 else "none", "r", "low"]) for k in range(40)]
    got = sorted(r.cik for r in M.seeded_sample(spark.createDataFrame(rows, "cik string, stratum array<string>"), "stratum", "cik", 3, 42).collect())
    want = []
    for s in {tuple(s) for _, s in rows}:
        members = sorted(c for c, t in rows if tuple(t) == s)
        want += random.Random(repr((42, s))).sample(members, 3)
    assert got == sorted(want)
    with pytest.raises(ValueError):
        M.seeded_sample(spark.createDataFrame(rows, "cik string, stratum array<string>"), "stratum", "cik", 0, 42)


def test_provider_boundary(spark):
    asked = spark.createDataFrame([(k, f"prompt {k}") for k in range(5)], "k int, prompt string")
    with pytest.raises(PermissionError):
        M.answered(asked, "k", len)
    live = M.answered(asked, "k", lambda rows: [r["prompt"].upper() for r in rows], allow_live=True)
    assert {r.k: r.answer for r in live.collect()} == {k: f"PROMPT {k}" for k in range(5)}
    replay = spark.createDataFrame([(1, "yes")], "k int, answer string")
    assert {r.k: r.answer for r in M.answered(asked, "k", None, replay=replay).collect()} == {0: None, 1: "yes", 2: None, 3: None, 4: None}


def test_two_way_slope_of_an_unbalanced_panel(spark):
    rng = np.random.default_rng(6)
    rows = [(u, t, float(rng.normal() + u), 0.0) for u in range(30) for t in range(6) if rng.random() < 0.7]
    rows = [(u, t, x, 2.5 * x + 3 * u - 7 * t + 0.01 * float(rng.normal())) for u, t, x, _ in rows]
    df = spark.createDataFrame(rows, "u int, t int, x double, y double")
    got = M.two_way_slope(df, "u", "t", "y", "x").first()
    assert got.n == len(rows) and abs(got.slope - 2.5) < 0.01
    assert M.two_way_slope(df.limit(0), "u", "t", "y", "x").first().slope is None


def test_role_decomposition_adds_up(spark):
    rng = random.Random(7)
    rows = [(u, r, t, rng.choice([None, rng.random()]), rng.randrange(1, 5)) for u in range(12) for r in "ab" for t in range(4) if rng.random() < 0.7]
    out = L.decompose_roles(spark.createDataFrame(rows, "u int, r string, t long, x double, w int"), "u", "r", "t", "x", "w").collect()
    for o in out:
        mean = lambda t: sum(x * w for _, _, s, x, w in rows if s == t and x is not None) / sum(w for _, _, s, x, w in rows if s == t and x is not None)
        assert abs(o.change - (mean(o.period) - mean(o.period - 1))) < 1e-9
        assert abs(o.within + o.role + o.mix + o.entry + o.exit + o.coverage - o.change) < 1e-9
    assert len(out) == 3


def test_sinks(spark, tmp_path):
    files.write_json(spark, {"b": 1, "a": {"z": None}}, f"{tmp_path}/doc")
    text = next((tmp_path / "doc").glob("part-*")).read_text()
    assert json.loads(text) == {"b": 1, "a": {"z": None}} and text.startswith('{\n  "a"')
    df = spark.range(100).selectExpr("id % 3 AS company", "id % 2 AS kind", "id")
    files.write_partitioned(df, f"{tmp_path}/parts", ["company", "kind"], ["id"])
    back = spark.read.parquet(f"{tmp_path}/parts")
    assert back.count() == 100 and files.count_files(spark, f"{tmp_path}/parts/company=*/kind=*") == 6 and files.count_files(spark, f"{tmp_path}/none*") == 0
    assert files.content_hash(df) == files.content_hash(df.orderBy(F.rand(1))) != files.content_hash(df.where("id < 99"))
    assert files.content_hash(df.limit(0)) == files.content_hash(df.where("false"))


def test_environment(spark):
    got = {r.name: r.value for r in stages.environment(spark, {"project_name": "p"}).collect()}
    assert got["project_name"] == "p" and got["full_run_enabled"] == "False" and got["spark"] == spark.version and got["schema_version"] is None


def test_scalars_of_nothing(spark):
    row = spark.createDataFrame([(None, None)], "s string, a array<string>").select(
        M.availability(F.col("s")).alias("state"), S.scale_rank(F.col("s"), ["x"]).alias("rank"), M.overlap(F.array(), F.array()).alias("none"), M.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("flat"), M.source_kind(F.col("s"), F.col("s"), ["h"], [("^/", "k")], "other").alias("kind")
    ).first()
    assert (row.state, row["rank"], row.none, row.flat, row.kind.official, row.kind.kind) == ("unknown", None, 0.0, None, False, "other")


def test_entry_survives_without_the_training_data_folder(tmp_path):
    """A copy without the folder, with an empty one, and with one that lacks a module still has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(k.startswith('op') for k in q))"
    for change in ("none", "empty", "broken"):
        if change == "empty":
            (tmp_path / "r/attestor/llm").mkdir()
            (tmp_path / "r/corpus_pipeline.py").write_text("from attestor.llm import packing\n")
        if change == "broken":
            (tmp_path / "r/attestor/llm/__init__.py").write_text("import a_module_that_is_not_there\n")
        done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "r", capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
        n, m, ops = map(int, done.stdout.split())
        assert n == m > 90 and ops == 0
