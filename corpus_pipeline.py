"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import decontaminate, packing, quality, simhash, toxicity
from attestor.llm.common import materialize, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("quality", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: The learned and tokenizer stages aren't SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = materialize(out, name)
    return out
