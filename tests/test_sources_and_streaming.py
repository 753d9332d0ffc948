"""Readers, write-once sinks, streamed logs and the stage registry."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from attestor.operators import longitudinal as L
from attestor.operators import metrics as M
from attestor.operators import validation as V
from attestor.plans import stages as P
from attestor.sources import files
from attestor.streaming import logs


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2}], indent=1))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "a.json"), "k int, v string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2, "w": 3}\n')
    assert sorted(r["k"] for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k int").collect()) == [1, 2]
    from pyspark.sql.types import IntegerType, StructType

    assert [tuple(r) for r in files.unknown_keys(spark, str(tmp_path / "b.jsonl"), StructType().add("k", IntegerType())).collect()] == [("w", 1)]
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int").collect()


def test_keyed_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"7": [{"t": "a"}, {"t": "b"}], "8": []}, indent=1))
    got = files.read_keyed_json(spark, str(tmp_path / "m.json"), "struct<t:string>").select("key", "ord", "value.t").collect()
    assert [tuple(r) for r in got] == [("7", 0, "a"), ("7", 1, "b")]


def test_write_once_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    files.write_jsonl(df, str(tmp_path / "o"))
    lines = [json.loads(x) for p in (tmp_path / "o").glob("*.json") for x in p.read_text().splitlines()]
    assert {"a": None, "b": 2} in lines and all(list(x) == ["a", "b"] for x in lines)
    with pytest.raises(Exception):
        files.write_jsonl(df, str(tmp_path / "o"))
    files.run_directory(spark, str(tmp_path), "r1")
    with pytest.raises(FileExistsError):
        files.run_directory(spark, str(tmp_path), "r1")
    with pytest.raises(ValueError):
        files.run_directory(spark, str(tmp_path), "../r2")


def test_append_unique(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id string, v int"
    empty = spark.createDataFrame([], schema)
    files.append_unique(empty, spark.createDataFrame([("a", 1)], schema), "id", path)
    log = spark.read.parquet(path)
    for rows in ([("a", 2)], [("b", 1), ("b", 2)]):
        with pytest.raises(ValueError):
            files.append_unique(log, spark.createDataFrame(rows, schema), "id", path)
    files.append_unique(log, spark.createDataFrame([("b", 2)], schema), "id", path)
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_streams(spark, tmp_path):
    at = lambda h: datetime.datetime(2022, 1, 1, h)
    rows = [("a", at(1)), ("a", at(2)), ("b", at(3)), ("c", at(20))]
    spark.createDataFrame(rows, "id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "in"))

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert sorted(r["id"] for r in drain(logs.unique_log(stream, "id", "ts"), "u").collect()) == ["a", "b", "c"]
    late = drain(logs.quarantine(stream, "ts", F.lit(at(10))), "q")
    assert sorted((r["id"], r["late"]) for r in late.collect()) == [("a", False), ("a", False), ("b", False), ("c", True)]
    n = drain(logs.windowed_counts(stream, "ts", ["id"], "12 hours"), "w", "complete")
    assert sorted((r["id"], r["n"]) for r in n.collect()) == [("a", 2), ("b", 1), ("c", 1)]


def stage(n, **more):
    return dict(id=f"{n:02d}", name="n", phase="p", script="a.py", spec="a.md", description="d", inputs=["i"], outputs=[f"o{n}"], gate="g", status="ready") | more


def test_stage_registry(spark):
    reg = [stage(0), stage(1, status="stub"), stage(1), stage(2, status="odd"), stage(3, script="gone.py"), stage(4, gate=None), stage(13)]
    got = sorted(tuple(r)[1:] for r in P.registry_findings(spark, reg, lambda p: p != "gone.py").collect())
    assert got == [("duplicate_stage_id", "01"), ("invalid_status", "02"), ("missing_fields", "04: gate"), ("missing_script", "03: gone.py")]
    assert P.registry_findings(spark, [], bool).first()["code"] == "missing_stages"
    assert P.by_id(reg, 3)["id"] == "03" and P.select(reg, "ready") == ["00", "01", "03", "04", "13"]
    with pytest.raises(KeyError):
        P.by_id(reg, 9)
    assert P.run_stage(reg, 0).blocked == "dry_run" and P.run_stage(reg, 1, execute=True).blocked == "stage_is_stub" and P.run_stage(reg, 13, execute=True).blocked == "full_run_disabled"
    assert {(r["stage"], r["exists"]) for r in P.declared_outputs(spark, reg[:2], lambda o: o == "o1").collect()} == {("00", False), ("01", True)}


def test_stage_runs(tmp_path):
    (tmp_path / "a.py").write_text("import sys; print('ran', sys.argv[1]); sys.exit(3)")
    out = P.run_stage([stage(0)], 0, execute=True, args=["x"], cwd=str(tmp_path))
    assert out.executed and out.returncode == 3 and out.output.strip() == "ran x"


def test_schema_errors(spark):
    df = spark.createDataFrame([("A", 5, ["x", None], (None,)), (None, None, [], ("bad",)), ("B", 99, None, None)], "s string, n int, a array<string>, o struct<p:string>")
    schema = {"required": ["s"], "properties": {"s": {"enum": ["A"]}, "n": {"maximum": 10}, "a": {"minItems": 1, "items": {"pattern": "^x$"}}, "o": {"required": ["p"], "properties": {"p": {"pattern": "^g"}}}}}
    got = [r["e"] for r in df.select(V.schema_errors(schema).alias("e")).collect()]
    assert got == [["$.o.p: required"], ["$.a: too few items", "$.o.p: does not match", "$.s: required"], ["$.n: above maximum", "$.s: not in enum"]]


def test_markers_quotes_and_verdict(spark):
    df = spark.createDataFrame([("p1", "a password", "pass"), ("p1", "x", " "), ("p9", None, "x")], "pid string, t string, q string")
    assert [r["m"] for r in df.select(V.markers_in(F.col("t"), ["pass", "x"]).alias("m")).collect()] == [["pass"], ["x"], []]
    passages = spark.createDataFrame([("p1", "the pass is here")], "pid string, text string")
    assert sorted((r["q"], r["resolves"]) for r in V.cited_quotes(df, passages, "pid", "q", "text").collect()) == [(" ", False), ("pass", True), ("x", False)]
    rows = spark.createDataFrame([(None, 0, 0, 0), (True, 1, 1, 1), (True, 0, 1, 1), (True, 0, 0, 1), (True, 0, 0, 0)], "e boolean, c int, g int, o int")
    assert [r[0] for r in rows.select(V.verdict(*map(F.col, "ecgo"))).collect()] == ["not_executed", "rejected_critical", "rejected_gate", "pending_review", "accepted"]


def test_components_of_a_chain_and_a_hot_name(spark):
    rows = [(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(200)] + [(k, "hot", None) for k in range(300, 500)] + [(k, None, None) for k in (900, 901)]
    got = {r["k"]: r["component"] for r in L.alias_components(spark.createDataFrame(rows, "k long, a string, b string"), "k", ["a", "b"]).collect()}
    assert got == {k: 0 if k < 200 else 300 if k < 500 else k for k, _, _ in rows}
    empty = spark.createDataFrame([], "k long, a string, b string")
    assert L.alias_components(empty, "k", ["a", "b"]).count() == 0


def test_metrics_of_no_answers(spark):
    pairs = M.confusion(spark.createDataFrame([("x", None), (None, None)], "g string, p string"), "g", "p")
    assert [tuple(r) for r in M.label_counts(pairs).collect()] == [("x", 0, 0, 1)]
    a = M.abstention(pairs).first()
    assert (a["n"], a["answered"], a["coverage"], a["selective_risk"], a["false_confidence"]) == (2, 0, 0.0, None, 0.0)
    k = M.weighted_kappa(pairs, {"x": 0, "y": 1}).first()
    assert k["n"] is None and k["weighted_kappa"] is None
