"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any other text is unlabelled. The risk of calling the unlabelled
negative is corrected by the class prior: prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]). The
classifier is linear over the presence of words and is fitted in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import materialise, small_batches, unused

#: Bounds of the sample that the classifier is fitted on.
POSITIVE_ROWS, UNLABELLED_ROWS = 10_000, 40_000
#: Features of the classifier at most, and how many standard errors more common among positives they have to be.
FEATURES, SURPRISE = 256, 4.0
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6)
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Words of letters in lower case, and the beginnings of longer ones, which words of one stem share."""
    words = set(_WORDS.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(features_of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["p", "words"])


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1: their labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = self.weights
        z = self.bias + sum(found[w] for w in sorted(features_of(text) & found.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(positive: list[tuple[frozenset[str], int]], unlabelled: list[tuple[frozenset[str], int]], prior: float, steps: int = 600, rate: float = 0.1, l2: float = 0.5) -> Classifier:
    """Minimise the non-negative risk with the logistic loss by Adam; rows are (words of the classifier, how often)."""
    start = float(np.log(prior / (1 - prior)))
    at = {w: k for k, w in enumerate(sorted({w for x, _ in (*positive, *unlabelled) for w in x}))}
    if not positive or not unlabelled or not at:
        return Classifier({}, start)

    def matrix(rows: list[tuple[frozenset[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        out, weight = np.zeros((len(rows), len(at)), np.float32), np.array([n for _, n in rows], float)
        for r, (x, _) in enumerate(rows):
            out[r, [at[w] for w in x]] = 1
        return out, weight / weight.sum()

    (p, of_p), (u, of_u) = matrix(positive), matrix(unlabelled)
    l2 /= sum(n for _, n in (*positive, *unlabelled))
    w, b = np.zeros(len(at)), start
    m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for step in range(1, steps + 1):
        z_p, z_u = p @ w + b, u @ w + b
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        as_negative = of_u @ np.logaddexp(0, z_u) - prior * (of_p @ np.logaddexp(0, z_p))
        g_u, g_p = of_u * s_u, prior * of_p * s_p  # gradients of the two terms of that risk
        d_u, d_p = (g_u, prior * of_p * (s_p - 1) - g_p) if as_negative >= 0 else (-g_u, g_p)
        gradient = np.append(u.T @ d_u + p.T @ d_p + l2 * w, d_u.sum() + d_p.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier({x: round(float(w[k]), 6) for x, k in at.items()}, round(float(b), 6))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Classifier:
    """Fit on a bounded sample of the rows that are not held out; the sample is the same on every run.

    Only labels of 1 are read as such: every other text of the sample is unlabelled. The class prior is the share
    of confirmed toxic rows among the labelled ones that are not held out. Spark counts in how many texts of either
    kind a word is, and of each text only the words of the classifier come to the driver, equal sets together.
    """
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    known = labels.select(ids, F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    prior = min(0.9, max(0.001, (counts.k or 0) / counts.n)) if counts.n else 0.01
    mixed = F.xxhash64("doc_id", F.lit(3))
    some_p = known.filter("toxic = 1").select("doc_id").distinct().orderBy(mixed, "doc_id").limit(positives)
    bodies = docs.select(ids, F.col(text).cast("string").alias("text")).filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    some_u = bodies.select("doc_id").distinct().orderBy(mixed, "doc_id").limit(unlabelled)
    wanted = some_p.withColumn("p", F.lit(1)).union(some_u.withColumn("p", F.lit(0)))
    small_batches(docs.sparkSession)
    sample = bodies.join(F.broadcast(wanted), "doc_id").select("p", "text").mapInArrow(_words, "p int, words array<string>")  # the limits bound what is sent
    sample = materialise(sample, "toxicity")  # read three times
    size = {r.p: r.n for r in sample.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p or not n_u:
        return fit([], [], prior)
    in_p, in_u = F.col("in_p") / n_p, F.col("in_u") / n_u
    spread = F.sqrt((F.col("in_p") + F.col("in_u")) / (n_p + n_u) * (1 / n_p + 1 / n_u))
    common = (
        sample.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("in_p"), F.sum(1 - F.col("p")).alias("in_u"))
        .filter("in_p >= 3").withColumn("surprise", (in_p - in_u) / spread).filter(F.col("surprise") >= SURPRISE).orderBy(F.desc("surprise"), "word").limit(FEATURES)
    )
    vocabulary = [r.word for r in common.collect()]
    if not vocabulary:
        return fit([], [], prior)
    sets = sample.groupBy("p", F.array_sort(F.array_intersect("words", F.lit(vocabulary))).alias("words")).agg(F.count(F.lit(1)).alias("n")).orderBy("p", "words").collect()
    return fit(*([(frozenset(r.words), r.n) for r in sets if r.p == p] for p in (1, 0)), prior)


def scored(docs: DataFrame, model: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text; null counts as empty and gets the score of one."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t if isinstance(t, str) else None) for t in batch], dtype="float64")

    return docs.withColumn(name, score(F.col(text).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of held-out rows, of null doc_ids and null labels are not read; with no positives at all every text gets
    the same low score. Repeated rows are each scored. Languages, sources and ids are never inputs. An empty table
    gives no rows; columns other than doc_id and the text are not read.
    """
    model = train(docs, labels, text)
    out = scored(docs.select(F.col("doc_id"), F.col(text).alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and no others."""
    name = unused("toxicity", docs)
    return scored(docs, train(docs, labels, text), text, name).filter(F.col(name) < threshold).drop(name)
