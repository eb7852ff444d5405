"""URL filters: explicit rules, and logistic regression on hashed character n-grams for the rest.

Host and path are parsed and the rules applied with built-in functions. Where no rule fits,
a logistic regression decides: character n-grams of host and path, hashed into ``DIMS``
weights, trained on a small labelled URL table, at most ``TRAIN`` rows of each verdict
(those of smallest hash). Training runs on that bounded table; the model (one float per
dimension) is broadcast and scoring is a map over all pages, without a shuffle.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and
are judged by the model like any other; without labelled rows of both verdicts the model
allows what it is asked; null ``page_id`` is passed through; repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path); the longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRAIN = 5000
DIMS = 1 << 16
GRAMS = (3, 4, 5)
ROUNDS = 60
L2 = 1e-4


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host + path, and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct dimensions of the character n-grams of host and path, each bounded by marks."""
    found = {0}  # the intercept
    for part in (b"h^" + host.encode("utf-8", "replace") + b"$", b"p^" + path.encode("utf-8", "replace") + b"$"):
        for n in GRAMS:
            found.update(zlib.crc32(part[:1] + part[i : i + n]) % (DIMS - 1) + 1 for i in range(1, max(2, len(part) - n + 1)))
    return np.fromiter(found, dtype=np.int32)


class Rows:
    """Sparse binary rows, each scaled to length 1."""

    def __init__(self, pairs):
        each = [features(h, p) for h, p in pairs]
        self.lengths = np.array([len(x) for x in each])
        self.dims = np.concatenate(each) if each else np.zeros(0, dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if each else np.zeros(0, dtype=int)
        self.scale = 1 / np.sqrt(np.maximum(self.lengths, 1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.dims], self.starts) * self.scale if len(self.starts) else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.dims, np.repeat(g * self.scale, self.lengths), DIMS)


def train(labelled: DataFrame, most: int = TRAIN) -> np.ndarray:
    """Weights of the logistic regression from ``labelled`` (host, path, verdict)."""
    rows = []
    for verdict in ("allow", "block"):
        part = labelled.where(F.col("verdict") == verdict).select("host", "path").distinct()
        rows.append(part.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most).collect())
    if not rows[0] or not rows[1]:
        w = np.zeros(DIMS)
        w[0] = -1.0
        return w
    x = Rows([tuple(r) for part in rows for r in part])
    y = np.repeat([0.0, 1.0], [len(rows[0]), len(rows[1])])
    share = np.where(y > 0, 0.5 / len(rows[1]), 0.5 / len(rows[0]))  # both verdicts weigh the same
    w, seen = np.zeros(DIMS), np.full(DIMS, 1e-8)
    for _ in range(ROUNDS):  # AdaGrad over the whole table: the same weights on every run
        g = x.back((1 / (1 + np.exp(-x.dot(w))) - y) * share) + L2 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's chance of ``block``) per page.

    ``labelled`` (host, path, verdict) trains the model; by default the pages that the rules
    decide, which then stand as labels for the others.
    """
    rule, verdict = ruled(rules)
    known = parsed(pages).withColumns({"rule": rule, "verdict": verdict})
    weights = train(labelled if labelled is not None else known.where("rule is not null"))
    model = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            z = Rows(zip(p["host"], p["path"])).dot(model.value)
            score = 1 / (1 + np.exp(-z.astype(np.float64)))
            own = pd.Series(np.where(score > 0.5, "block", "allow"), index=p.index, dtype=object)
            yield p.assign(verdict=p["verdict"].where(p["verdict"].notna(), own), score=score)

    kind = pages.schema["page_id"].dataType.simpleString()
    return known.mapInPandas(scored, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
