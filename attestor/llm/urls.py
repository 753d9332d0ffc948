"""URL filters: explicit host and path rules first, else logistic regression on hashed character n-grams of host and path.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule, and gets the model's
verdict on the empty strings; repeated rows get a row each; an empty table gives no rows. Urls are read whole.
The labelled table is bounded (LABEL_ROWS), as is the model (BUCKETS weights).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table
from .linear import logistic

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
LABEL_ROWS = 20_000
#: Rules as (host, path, verdict), written host + path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A small labelled URL table: 1 is to be blocked. Invented hosts under reserved names.
BLOCKED_WORDS = "casino poker jackpot slots bet escort xxx porn adult warez torrent crack keygen pills viagra loan payday replica spam clickbait freemoney hotdeals".split()
ALLOWED_WORDS = "library school museum news weather recipes garden science history music travel maps health sport open archive docs wiki forum radio blog journal".split()
PLACES = ("example.org", "example.net", "example.edu", "site.test")


def seed_urls() -> list[tuple[str, int]]:
    """Every word of both lists as a host's label and as a path's part."""
    rows = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for k, w in enumerate(words):
            place = PLACES[k % len(PLACES)]
            rows += [(f"http://{w}.{place}/", label), (f"https://www.{w}{k}.{place}/en/{1000 + 37 * k}", label), (f"https://{place}/{w}/page{k}.html", label), (f"http://m.{place}/de/{w}-{words[k - 1]}?x={k}", label)]
    plain = ("the", "thing", "here", "blog", "old", "main")
    rows += [(f"http://{h}.{p}/{lang}/{n}", 0) for n, h in enumerate(plain, 101) for p in PLACES for lang in ("en", "de", "fr", "es")]
    return rows


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host + path) and its verdict; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of the host (marked ^ and $) and of the path."""
    out = []
    for salt, s in ((7, f"^{host}$"), (11, path)):
        raw = np.frombuffer(s.encode(), np.uint8).astype(np.uint64)
        for n in GRAMS:
            if len(raw) >= n:
                h = np.full(len(raw) - n + 1, salt * 131 + n, np.uint64)
                for k in range(n):
                    h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(0x100000001B3)
                out.append((h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, label) of at most LABEL_ROWS rows, chosen by a hash."""
    rows = labelled.where(F.col("label").isNotNull()).orderBy(F.xxhash64("host", "path"), "label").limit(LABEL_ROWS).toPandas()
    grams = [_grams(h, p) for h, p in zip(rows["host"], rows["path"])]
    used = np.unique(np.concatenate(grams)) if len(grams) else np.zeros(0, np.int64)
    x = np.zeros((len(grams), len(used)), np.float32)
    for i, g in enumerate(grams):
        x[i, np.searchsorted(used, g)] = 1 / np.sqrt(max(1, len(g)))
    w, b = logistic(x, rows["label"].to_numpy(float), l2=1e-4, steps=150)
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, block_probability and verdict. labelled: url, label (1: block)."""
    ready(pages.sparkSession)
    w, b = train(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"))

    @F.pandas_udf("double")
    def block(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([_one(h, p) for h, p in zip(host, path)], dtype="float64")

    def _one(h: str, p: str) -> float:
        g = _grams(h, p)
        return float(1 / (1 + np.exp(-np.clip(b + w[g].sum() / np.sqrt(max(1, len(g))), -35, 35))))

    parted = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = parted.withColumns({"rule": rule, "_by_rule": verdict, "block_probability": block("host", "path")})
    learned = F.when(F.col("block_probability") > threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_by_rule", learned)).drop("_by_rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(seed_urls(), "url string, label int")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labelled).select("page_id", "host", "path", "rule", "verdict")
