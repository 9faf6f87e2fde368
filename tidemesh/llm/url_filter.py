"""Operator 6: URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Defined results: a null URL, or one without `://`, has empty host and path, no rule, and the method's verdict on
empty strings, which is allow; very long URLs are read whole; of rules that fit the longest holds, and no two are
equally long; repeated rows and null ids are judged like others; extra columns are ignored; an empty table gives an
empty table.  A labelled table without both classes gives a model that allows everything.
"""

from __future__ import annotations

import csv
import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, start of the path, verdict); the longest that fits holds.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: The small labelled table (url, blocked) that the production model is trained from.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def labelled_rows(path: Path = LABELLED) -> list[tuple[str, int]]:
    with path.open(encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["blocked"])) for r in csv.DictReader(f)]


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    grams: tuple[int, ...] = (3, 4, 5)
    steps: int = 300
    rate: float = 2.0
    ridge: float = 1e-4
    #: A labelled table is read up to this many rows, by URL; it is small by contract.
    most_labelled: int = 100_000
    #: A URL of which nothing is known has about 0.5; only clear evidence blocks.
    threshold: float = 0.75


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path, both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain of it and the path's start."""
    rule = verdict = F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, s: Settings) -> np.ndarray:
    """Buckets of the distinct n-grams; host and path are hashed apart."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in s.grams:
            found.update(zlib.crc32((kind + text[k : k + n]).encode("utf-8", "replace")) % s.buckets for k in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, host: str, path: str) -> float:
        at = features(host, path, self.settings)
        if not len(at) or not host:
            return 0.0
        return float(1 / (1 + np.exp(-(self.bias + self.weights[at].sum() / np.sqrt(len(at))))))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", s: Settings = Settings()) -> Model:
    """Full-batch gradient descent on at most `most_labelled` labelled URLs (smallest URLs first)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = labelled.select(host.alias("h"), path.alias("p"), F.col(label_col).cast("int").alias("y")).where("y is not null").orderBy("h", "p", "y").limit(s.most_labelled).collect()
    weights, bias = np.zeros(s.buckets), 0.0
    if len({r.y for r in rows}) < 2:
        return Model(weights, -1.0, s)
    sets = [features(r.h, r.p, s) for r in rows]
    row, col = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    value = np.concatenate([np.full(len(x), 1 / np.sqrt(max(1, len(x)))) for x in sets])
    y = np.array([float(r.y > 0) for r in rows])
    weigh = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(s.steps):
        z = bias + np.bincount(row, value * weights[col], len(sets))
        error = weigh * (1 / (1 + np.exp(-z)) - y)
        weights -= s.rate * 10 * (np.bincount(col, value * error[row], s.buckets) + s.ridge * weights)
        bias -= s.rate * error.sum()
    return Model(weights, bias, s)


def judge(pages: DataFrame, model: Model, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else the model's.  The model's size is fixed
    by `buckets`; only the id and the URL are read, and no row is shuffled."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    sent = parts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        for batch in batches:
            scores = [known.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["page_id", "host", "path", "score"])

    scored = parts.mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= model.settings.threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
