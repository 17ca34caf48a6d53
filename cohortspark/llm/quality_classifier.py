"""Quality classifier: Bradley-Terry scores from preference pairs.

Labelled documents give preference pairs (a document of quality 1 is preferred
to one of quality 0). The probability that i beats j is the logistic function
of w.(x_i - x_j), where x are shape features of the whole text; w minimises
the logistic loss on the feature differences plus a small ridge (Newton
steps). A document's raw score is w.x. The decision threshold is a quantile of
the raw scores of all documents: of ``LEVELS`` evenly spaced quantiles, the one
whose cut tells the labelled training rows apart best. The reported score is the
logistic function of the distance to that threshold, shifted so that the
threshold falls on 0.7.

Only the fit is on a bounded sample: at most ``max_rows`` labelled rows, chosen
by a hash of doc_id. Quantiles and the choice among them take all documents and
all labelled training rows.

Defined results: null text counts as empty, and empty texts are scored like any
other; a null doc_id is not held out and is never learnt from; labels other
than 0 and 1 and documents labelled both ways teach nothing; without both labels
every document gets 0.7 or more (nothing is known against it); repeated rows are
scored each; ties in score fall on the same side; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import read, whole_text

MAX_ROWS = 20_000
LEVELS = 1000
PASS = 0.7
#: Just above logit(0.7), so that a score on the threshold rounds to 0.7 or more.
PASS_LOGIT = float(np.log(PASS / (1 - PASS))) + 1e-9
N_FEATURES = 13

_KIND = np.zeros(256, np.int64)  # other symbols
_KIND[list(range(97, 123)) + list(range(128, 256))] = 1  # lower case, and bytes of other letters
_KIND[65:91] = 2  # upper case
_KIND[48:58] = 3  # digits
_KIND[[32, *range(9, 14)]] = 4  # white space
_KIND[[33, 44, 46, 58, 59, 63]] = 5  # ! , . : ; ?


def features(text: str) -> np.ndarray:
    """Shape of a whole text; zeros for an empty one."""
    x = np.zeros(N_FEATURES)
    raw = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return x
    kinds = np.zeros(6)
    np.add.at(kinds, _KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256))
    n, w = len(raw), len(words)
    kinds /= n
    lines = text.split("\n")
    longest = run = repeated = 0
    for a, b in pairwise(words):
        if a == b:
            repeated += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
    letters = kinds[1] + kinds[2] + 1e-9
    x[0] = np.log1p(n)
    x[1] = kinds[1] + kinds[2]
    x[2] = kinds[2] / letters
    x[3] = kinds[3]
    x[4] = kinds[5]
    x[5] = np.sqrt(kinds[0])
    x[6] = n / w / 10
    x[7] = len(set(words)) / w
    x[8] = np.sqrt(repeated / w)
    x[9] = np.log1p(longest)
    x[10] = 1 - len(set(lines)) / len(lines)
    x[11] = np.log1p(n / len(lines))
    x[12] = sum(len(v) == 1 and not v.isalnum() for v in words) / w
    return x


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = float("-inf")

    def raw(self, text: Column) -> Column:
        """The raw score of a text column."""
        mean, scale, weights = self.mean, self.scale, self.weights

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            # one text at a time: the same text gets the same bits in any batch
            return pd.Series([float(((features(t) - mean) / scale * weights).sum()) for t in texts], dtype=float)

        return score(text)

    def score(self, raw: Column) -> Column:
        """0 to 1; at least 0.7 from the threshold on."""
        if self.threshold == float("-inf"):
            return F.lit(PASS)
        return 1 / (1 + F.exp(-(raw - F.lit(self.threshold)) - F.lit(PASS_LOGIT)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): rows that may teach, one per document."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 2))
    both = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return both.where("quality = most").select("doc_id", "quality")


def bradley_terry(x: np.ndarray, y: np.ndarray, per_row: int = 4, ridge: float = 1e-3, steps: int = 25) -> Model:
    """Weights from preference pairs: every row of the larger class meets
    ``per_row`` rows of the smaller one."""
    if len(x) == 0:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (x - mean) / scale
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(x.shape[1])
    if len(good) and len(bad):
        rows = np.arange(max(len(good), len(bad)))
        turns = [rows * per_row + c for c in range(per_row)]
        i = np.concatenate([rows if len(good) >= len(bad) else t for t in turns]) % len(good)
        j = np.concatenate([rows if len(bad) > len(good) else t for t in turns]) % len(bad)
        d = good[i] - bad[j]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
            gradient = d.T @ (p - 1) / len(d) + ridge * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
    return Model(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The weights, from at most ``max_rows`` labelled rows."""
    turn = F.xxhash64(F.col("doc_id"))
    few = training_labels(labels).orderBy(turn, "doc_id").limit(max_rows)  # bounds the broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(few), "doc_id")
    shape = F.pandas_udf(lambda texts: pd.Series([features(t).tolist() for t in texts], dtype=object), "array<double>")
    rows = found.select("doc_id", "quality", shape("text").alias("x")).orderBy(turn, "doc_id", "x").limit(max_rows).collect()
    return bradley_terry(np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES), np.array([r["quality"] for r in rows]))


def choose_threshold(model: Model, scored: DataFrame, labels: DataFrame, levels: int = LEVELS) -> Model:
    """``scored`` (doc_id, raw), all documents -> the model with its threshold:
    the quantile of all raw scores that has the best balanced accuracy on all
    labelled training rows (of equals, the middle one)."""
    ranks = [i / levels for i in range(1, levels)]
    cuts = scored.agg(F.percentile_approx("raw", ranks, 10_000).alias("q")).first()["q"]
    if not cuts or not np.any(model.weights):
        return model
    cuts = sorted(set(cuts))
    at = F.aggregate(F.lit(cuts).cast("array<double>"), F.lit(0), lambda n, c: n + (F.col("raw") >= c).cast("int"))  # cuts at or below
    seen = scored.join(training_labels(labels), "doc_id").groupBy(at.alias("at"), "quality").agg(F.count("*").alias("n")).collect()
    held = np.zeros((2, len(cuts) + 1))
    for r in seen:
        held[r["quality"], r["at"]] += r["n"]
    if not held.sum(axis=1).all():
        return model
    kept = held[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] / held.sum(axis=1, keepdims=True)  # share of each class from each cut on
    value = kept[1] + 1 - kept[0]
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return Model(model.mean, model.scale, model.weights, float(cuts[best[len(best) // 2]]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, raw) of all documents, written once."""
    model = learn(docs, labels, max_rows)
    scored = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), model.raw(whole_text()).alias("raw")), "quality-raw")
    return choose_threshold(model, scored, labels), scored


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    model, scored = fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    out = scored.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), model.score(F.col("raw")).alias("score"), "raw")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= PASS).cast("int").alias("predicted"), "raw")
