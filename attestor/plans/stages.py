"""The stage registry: what is declared, what is wrong with it, which stages a mode selects, and whether one may run."""

from __future__ import annotations

import subprocess
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FIELDS = ["id", "name", "phase", "script", "spec", "description", "inputs", "outputs", "gate", "status"]
STATUSES = ["stub", "sentinel", "ready", "frozen"]
FULL_RUN_ONLY = ["13", "14"]

_TEXT = [f for f in FIELDS if f not in ("inputs", "outputs")]
SCHEMA = ", ".join([*(f"{f} string" for f in _TEXT), "inputs array<string>", "outputs array<string>"])
_MODES: dict[str, Callable[[str], bool]] = {"all": lambda s: True, "runnable": lambda s: s != "stub", "ready": lambda s: s in ("ready", "frozen")}


@dataclass
class Outcome:
    command: list[str]
    executed: bool
    blocked: str | None = None
    returncode: int | None = None
    output: str = ""


def frame(spark: SparkSession, stages: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(s.get(f) for f in (*_TEXT, "inputs", "outputs")) for s in stages], SCHEMA)


def registry_findings(spark: SparkSession, stages: list[dict], exists: Callable[[str], bool]) -> DataFrame:
    """(severity, code, subject): absent fields, repeated ids, unknown statuses, scripts and specs that aren't there. A stage
    that lacks fields has no other findings; an empty registry has one."""
    schema = "severity string, code string, subject string"
    if not stages:
        return spark.createDataFrame([("error", "missing_stages", "registry")], schema)
    df = frame(spark, stages)
    lacks = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS)))
    df = df.withColumn("_lacks", lacks)
    whole = df.where(F.size("_lacks") == 0)
    paths = sorted({s[k] for s in stages for k in ("script", "spec") if s.get(k)})
    gone = [p for p in paths if not exists(p)]
    error = lambda d, code, c: d.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), c.alias("subject"))
    out = error(df.where(F.size("_lacks") > 0), "missing_fields", F.concat(F.coalesce("id", F.lit("?")), F.lit(": "), F.array_join(F.array_sort("_lacks"), ", ")))
    out = out.unionByName(error(whole.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_stage_id", F.col("id")))
    out = out.unionByName(error(whole.where(~F.col("status").isin(STATUSES)), "invalid_status", F.col("id")))
    for k in ("script", "spec"):
        out = out.unionByName(error(whole.where(F.col(k).isin(gone)), f"missing_{k}", F.concat_ws(": ", "id", k)))
    return out


def by_id(stages: list[dict], stage_id: str | int) -> dict:
    """Numbers may be given without their leading zero."""
    want = str(stage_id).zfill(2) if str(stage_id).isdigit() else str(stage_id)
    for s in stages:
        if str(s["id"]) == want:
            return s
    raise KeyError(f"no stage {stage_id}")


def select(stages: list[dict], mode: str) -> list[str]:
    if mode not in _MODES:
        raise ValueError(f"mode {mode!r} is none of {sorted(_MODES)}")
    return [str(s["id"]) for s in stages if _MODES[mode](s["status"])]


def declared_outputs(spark: SparkSession, stages: list[dict], exists: Callable[[str], bool]) -> DataFrame:
    """(stage, output, exists), a row a declared output."""
    there = [o for s in stages for o in s.get("outputs") or [] if exists(o)]
    return frame(spark, stages).select(F.col("id").alias("stage"), F.explode("outputs").alias("output")).withColumn("exists", F.col("output").isin(there))


def run_stage(stages: list[dict], stage_id: str | int, *, execute: bool = False, allow_stub: bool = False, full_run: bool = False, args: Iterable[str] = (), cwd: str | None = None, timeout: int | None = None) -> Outcome:
    """A dry run unless `execute`; stubs and, without `full_run`, the last stages are refused."""
    stage = by_id(stages, stage_id)
    command = [sys.executable, stage["script"], *map(str, args)]
    if not execute:
        return Outcome(command, False, "dry_run")
    if stage["status"] == "stub" and not allow_stub:
        return Outcome(command, False, "stage_is_stub")
    if str(stage["id"]) in FULL_RUN_ONLY and not full_run:
        return Outcome(command, False, "full_run_disabled")
    done = subprocess.run(command, cwd=cwd, capture_output=True, text=True, timeout=timeout, check=False)
    return Outcome(command, True, None, done.returncode, done.stdout + done.stderr)


def environment(spark: SparkSession, project: dict, cwd: str | None = None) -> DataFrame:
    """(name, value): what a run's report needs to know of where it ran."""
    try:
        revision = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=cwd, capture_output=True, text=True, timeout=15, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        revision = "unknown"
    found = {"python": sys.version.split()[0], "executable": sys.executable, "platform": sys.platform, "spark": spark.version, "master": spark.sparkContext.master, "git_commit": revision}
    found |= {k: project.get(k) for k in ("project_name", "schema_version", "observation_window")} | {"full_run_enabled": bool(project.get("full_run_enabled", False))}
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in found.items()], "name string, value string")
