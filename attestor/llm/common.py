"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
PACKAGE = Path(__file__).resolve().parents[1]
BATCH_ROWS, _BATCH = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"
_state: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """The package on every worker's path. Workers that inherit a PYTHONPATH with this repository need no copy; others get
    a zip. Arrow batches of more than BATCH_ROWS rows are too large for a worker where texts are long, so a session that
    allows them is lowered to that; every operator needs the same value, and no other setting is touched."""
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    inherited = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in inherited and _state.get("shipped") != sc.applicationId:
        made = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(made, "w") as z:
            for p in PACKAGE.rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(made)
        _state["shipped"] = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder made
    here; a cluster's executors couldn't see one, so there it is an error."""
    sc = spark.sparkContext
    if given := sc.getConf().get("spark.checkpoint.dir"):
        return given.rstrip("/")
    if _state.get("app") != sc.applicationId:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = os.path.realpath(tempfile.mkdtemp(prefix="checkpoint-"))
        sc.setCheckpointDir(made)
        _state.update(app=sc.applicationId, dir=made)
    return _state["dir"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage, and a lost
    executor costs only a re-read. The folders are removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    owned = _state.setdefault("owned", [])
    if not owned:
        atexit.register(_remove_owned)
    owned.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Remove every folder that materialize() made; frames read from them stop working."""
    for session, path in _state.pop("owned", []):
        try:
            jvm = session.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone already
            return


def _remove_owned() -> None:
    drop_materialized(None)


def remainder(key: str, m: int) -> Column:
    """crc32 of the key as text, modulo m; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % m


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Batches of at most `rows` rows, as Arrow and with their columns as Python lists. When all are read the worker, which
    stays for later tasks, gives its free memory back."""
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            b = whole.slice(k, rows)
            yield b, {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """A name for each of the wanted ones that no column has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def sum_vectors(sent: DataFrame, parts: int, kind: type, fan: int = 64) -> DataFrame:
    """(block, v): the sums of the vectors v (bytes of numbers of `kind`) of each block. sent: part (0 to parts - 1), block, v.
    Parts are summed `fan` at a time, again and again, so no task gets more than `fan` vectors of a block."""

    def add(key, rows):
        total = np.sum([np.frombuffer(v, kind) for v in rows["v"].to_pylist()], axis=0, dtype=kind)
        return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    while True:
        sent = sent.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(add, "part long, block int, v binary")
        parts = -(-parts // fan)
        if parts <= 1:
            return sent.select("block", "v")


def split_words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, words of [^\\x20\\x09-\\x0D]+ (bytes.lower and bytes.split are ASCII only)."""
    return text.lower().split() if text else []
