"""Quality by positive-unlabelled learning: a linear scorer that minimises the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches, memory_of, remainder_of_id

#: The fit sees at most about so many trusted positives and so many unlabelled rows, those with the smallest hashes.
FIT_ROWS = 20_000
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 6))
for _c in range(256):
    _CLASSES[_c, 0] = 97 <= _c <= 122
    _CLASSES[_c, 1] = 65 <= _c <= 90
    _CLASSES[_c, 2] = 48 <= _c <= 57
    _CLASSES[_c, 3] = chr(_c) in ".,;:'\"?-()"
    _CLASSES[_c, 4] = _c < 128 and chr(_c) in "!#$%&*+/<=>@[\\]^_`{|}~"
    _CLASSES[_c, 5] = _c > 127
_RATES = (0.01, 0.05, 0.2)
N_FEATURES = 14 + 4 * len(_RATES)


def features(text: str | None) -> list[float]:
    """Shape of the whole text: shares of byte classes, words and lines, repetition, lengths, and how far bad signs go."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    letters, upper, digits, marks, symbols, beyond = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n).tolist()
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    echoes = sum(map(eq, words, words[1:])) / w
    repeated = 1 - len(set(lines)) / m if lines else 0.0
    distinct = len(set(words)) / w
    mean = sum(map(len, words)) / w
    shape = [letters, upper, digits, marks, symbols, beyond, echoes, repeated, distinct, mean / 10, np.log1p(n) / 10, np.log1p(w) / 10, np.log1p(m) / 10, float(not words)]
    return shape + [float(np.tanh(x / r)) for x in (symbols, max(0.0, upper - 0.05), echoes, repeated) for r in _RATES]


def nonnegative_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, decay: float = 1e-3, biased: bool = False) -> dict:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` under logistic loss by full-batch Adam steps.

    Where the bracket falls below zero the step climbs on it instead, which keeps the estimate from overfitting.
    ``biased`` takes the unlabelled as negative, ``prior * R_p(+) + R_u(-)``: a scorer that tells one sample from the other.
    """
    correction = 0.0 if biased else prior
    every = np.vstack([positive, unlabelled])
    mean, spread = every.mean(axis=0), every.std(axis=0) + 1e-6
    p, u = ((np.clip((x - mean) / spread, -8, 8)) for x in (positive, unlabelled))
    weight, bias = np.zeros(p.shape[1]), 0.0
    first, second = np.zeros(len(weight) + 1), np.zeros(len(weight) + 1)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, rounds + 1):
        zp, zu = p @ weight + bias, u @ weight + bias
        down_p, down_u = sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        negative = np.logaddexp(0, zu).mean() - correction * np.logaddexp(0, zp).mean()
        grad_n = np.append(u.T @ down_u - correction * (p.T @ down_p), down_u.sum() - correction * down_p.sum())
        if negative >= 0:
            up = (sigmoid(zp) - 1) / len(p)
            grad = prior * np.append(p.T @ up, up.sum()) + grad_n
        else:
            grad = -grad_n
        grad[:-1] += decay * weight
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return {"weight": weight, "bias": bias, "mean": mean, "spread": spread, "prior": prior}


def model_scores(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8) @ model["weight"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the two samples alone.

    A scorer learns on one half to tell the samples apart. On the other half, above any score, the unlabelled's
    share over the positives' bounds the prior from above (few negatives score so high); the score taken is the one whose
    bound with its margin of error is smallest. Both halves take turns, and the mean counts.
    """
    found = []
    for half in (0, 1):
        taught, kept = ((positive[k::2], unlabelled[k::2]) for k in (half, 1 - half))
        if not min(map(len, (*taught, *kept))):
            continue
        model = nonnegative_fit(*taught, prior=1.0, rounds=300, biased=True)
        p, u = (np.sort(model_scores(x, model)) for x in kept)
        cuts = np.unique(p)
        above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
        margin = np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p)))
        best = int(np.argmin((above_u + margin) / above_p))
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def scored(docs: DataFrame, model: dict, text: str = "text", keep: list[Column] | None = None, at_least: float | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) of the whole text to the columns ``keep`` (default: all).

    Null and empty texts are scored as texts without words. Narrow: no shuffle; repeated rows repeat. Only the text
    is read for the score. With ``at_least`` rows of lower scores go and no column is added.
    """
    bounded_batches(docs.sparkSession)
    keep = [F.col(f"`{c}`") for c in docs.columns] if keep is None else keep
    names = docs.select(*keep).columns
    rows = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[: len(keep)])), "score double"])

    n_keep = len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("quality")
        for batch in batches:
            x = np.array([features(t) for t in batch.column(n_keep).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keep], pa.array(model_scores(x, model), pa.float64())], names=[*(f"k{i}" for i in range(n_keep)), "score"])

    out = rows.mapInArrow(score, schema)
    if at_least is not None:
        return out.where(F.col("score") >= at_least).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "score")


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, those with the smallest hashes of id and text; all if there are fewer."""
    n = rows.count()
    return rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(n, 1))) + 1)


def learned_quality(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on trusted positives (label 1) and unlabelled documents, with the class prior that ``estimated_prior`` finds.

    At most about FIT_ROWS of each are used; labels other than 1 aren't. Without positives there is nothing to
    learn and the result is None.
    """
    labels = labels.select(F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("lid").isNotNull())
    trusted = labels.where("quality = 1").select("lid").distinct()
    docs = docs.select("doc_id", "text")

    def gathered(rows: DataFrame) -> np.ndarray:
        made = rows.select("text").mapInArrow(_feature_batches, "x array<double>")
        return np.array([r["x"] for r in made.collect()], dtype=float).reshape(-1, N_FEATURES)

    positives = gathered(docs.join(_sample_ids(trusted), F.col("doc_id") == F.col("lid"), "left_semi"))
    unlabelled = gathered(_sample(docs, FIT_ROWS))
    if not len(positives) or not len(unlabelled):
        return None
    return nonnegative_fit(positives, unlabelled, estimated_prior(positives, unlabelled))


def _sample_ids(ids: DataFrame) -> DataFrame:
    n = ids.count()
    return ids.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_ROWS / max(n, 1))) + 1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory_of("quality")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["x"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``; labels of four of five folds teach.

    Where no label is 1, nothing tells good from bad: the score is 0 if there are labels, all of them 0, else 0.5. Rows
    without an id are not held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder_of_id("doc_id", 5) != 0)
    held_out = F.coalesce(remainder_of_id("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    model = learned_quality(docs, labels)
    if model is None:
        out = docs.select("doc_id", held_out, F.lit(0.5 if labels.where("quality IS NOT NULL").isEmpty() else 0.0).alias("score"))
    else:
        out = scored(docs, model, keep=[F.col("doc_id"), held_out])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored under THRESHOLD go; where no positives teach, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder_of_id("doc_id", 5) != 0)
    model = learned_quality(docs, labels)
    return docs if model is None else scored(docs, model, at_least=THRESHOLD)
