"""Typed readers and write-once sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document or array a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A record a line; blank lines don't count; a malformed line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keyed_json(spark: SparkSession, path: str, element: str) -> DataFrame:
    """An object of arrays as rows of (key, ord, value); ord is the place in the array. Malformed text fails."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", f"map<string, array<{element}>>", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias("key", "a")).select("key", F.posexplode("a").alias("ord", "value"))


def read_config(spark: SparkSession, path: str) -> tuple[dict, str]:
    """A small YAML or JSON file, by its name's ending, and the sha256 of its bytes. YAML needs the yaml module."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if path.endswith(".json"):
        return json.loads(raw), hashlib.sha256(raw).hexdigest()
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: YAML can't be read here; write the configuration as .json") from e
    return yaml.safe_load(raw), hashlib.sha256(raw).hexdigest()


def unknown_keys(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Keys that the schema lacks (Spark drops them silently), with how many records have each."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = lines.select(F.explode(F.json_object_keys("value")).alias("key"))
    return keys.where(~F.col("key").isin(schema.fieldNames())).groupBy("key").agg(F.count("*").alias("n"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One document, indented, with sorted keys; dates and the like as text. The folder holds one file."""
    text = json.dumps(document, sort_keys=True, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Parquet in folders by keys (say company, source type and date), sorted inside files. Rows are dealt by the keys, and a
    partition that is too large for a task is split by the planner (a rebalance hint), so a hot key makes several files."""
    df.hint("rebalance", *keys).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).mode("errorifexists").parquet(path)


def count_files(spark: SparkSession, pattern: str) -> int:
    """How many files or folders match a glob on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return len(found) if found is not None else 0


def content_hash(df: DataFrame) -> str:
    """A hash of all rows as a multiset: each row's sha256 in eight numbers, summed over the rows, and their count. No row or
    file has to fit anywhere whole, and neither order nor file names count."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    row = df.agg(F.count("*"), *parts).first()
    return hashlib.sha256(" ".join(str(x or 0) for x in row).encode()).hexdigest()


def append_unique(log: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Append to an append-only Parquet log; a known or repeated key is an error and nothing is written."""
    known = new.join(log.select(key), key, "left_semi")
    twice = new.groupBy(key).count().where("count > 1")
    if not known.isEmpty() or not twice.isEmpty():
        raise ValueError(f"{key} is in the log already, or twice in the batch")
    new.write.mode("append").parquet(path)


def run_directory(spark: SparkSession, base: str, run_id: str) -> str:
    """A new folder for a run's tables; an existing one is refused."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"bad run id {run_id!r}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{run_id}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(f"{base}/{run_id}")
    fs.mkdirs(path)
    return f"{base}/{run_id}"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
