"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Features are the frequencies of hashed byte trigrams of the whole text (square roots, so that rare and frequent ones
count alike), and of words that repeat a word just before. One weight vector serves all grades; ordered thresholds t_1 < t_2 < ... turn the score s into
P(grade >= j) = sigmoid(s - t_j). The expected grade and the tail probability of ``accept_grade`` come from these, and
documents whose tail probability is under ``accept`` are rejected.

Fitted on at most ``sample_rows`` labelled rows, taken in order of hashed ids (a documented bound); of rows that repeat an
id, the text that is least in byte order stands for it. Scored on every row.

Defined cases: null and empty texts have no features and get the thresholds' prior; rows without a grade are not
learned from; with fewer than two grades among the labels everything is accepted at grade probability 1; a repeated
row scores alike; an empty table gives an empty result; other columns are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import lean, small_table
from quernstone.llm.shingles import text_slices, word_hashes

BINS = 4096
#: A word that equals the one 1, 2 or 3 words before it counts as one more kind of token.
LAGS = (1, 2, 3)
WIDTH = BINS + len(LAGS)
CHUNK = 1 << 20


def trigram_counts(data: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams."""
    out = np.zeros(BINS, np.int64)
    arr = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(arr) - 2), CHUNK):
        b = arr[at : at + CHUNK + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        out += np.bincount(h, minlength=BINS)
    return out


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8")
    n, out = trigram_counts(data), np.zeros(WIDTH, np.float32)
    if total := n.sum():
        out[:BINS] = np.sqrt(n / total)
    same, pairs = np.zeros(len(LAGS)), np.zeros(len(LAGS))
    for part in text_slices(data):
        h = word_hashes(part)[0]
        for j, lag in enumerate(LAGS):
            same[j] += np.count_nonzero(h[lag:] == h[:-lag])
            pairs[j] += max(0, len(h) - lag)
    out[BINS:] = np.sqrt(same / np.maximum(pairs, 1))
    return out


@dataclass
class Ordinal:
    """Weights and ordered thresholds of a cumulative-link model; ``thresholds`` empty: nothing could be learned."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return self.tails_at(x @ self.weights)

    def tails_at(self, s: np.ndarray) -> np.ndarray:
        """``tails`` of rows whose scores are known."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, x: np.ndarray) -> np.ndarray:
        return self.tails(x).sum(1)


def fit_ordinal(x: np.ndarray, grades: np.ndarray, steps: int = 400, rate: float = 0.3, ridge: float = 2e-5) -> Ordinal:
    """Likelihood of the grades by Adam over all rows; gaps between thresholds stay positive as exponentials."""
    top = int(grades.max()) if len(grades) else 0
    if len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(x.shape[1], np.float32), np.zeros(0))
    share = np.clip([(grades < j).mean() for j in range(1, top + 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 1e-2)
    params = np.concatenate([np.zeros(x.shape[1]), [start[0]], np.log(gaps)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    d = x.shape[1]
    for step in range(1, steps + 1):
        w, t = params[:d].astype(np.float32), np.concatenate([[params[d]], params[d] + np.cumsum(np.exp(params[d + 1 :]))])
        s = x @ w
        tails = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -40, 40)))
        full = np.hstack([np.ones((len(s), 1)), tails, np.zeros((len(s), 1))])
        rows = np.arange(len(s))
        p = np.maximum(full[rows, grades] - full[rows, grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(s), 1)), tails * (1 - tails), np.zeros((len(s), 1))])
        upper, lower = slope[rows, grades] / p, slope[rows, grades + 1] / p
        g_s = -(upper - lower) / len(s)
        g_t = np.zeros(top + 2)
        np.add.at(g_t, grades, upper / len(s))
        np.add.at(g_t, grades + 1, -lower / len(s))
        g_t = g_t[1:-1]
        back = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate([x.T @ g_s.astype(np.float32) + ridge * w, [back[0]], back[1:] * np.exp(params[d + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        params -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Ordinal(params[:d].astype(np.float32), np.concatenate([[params[d]], params[d] + np.cumsum(np.exp(params[d + 1 :]))]))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            rows = [features(t) for t in part.column(1).to_pylist()]
            at = [np.flatnonzero(x) for x in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for i, x in zip(at, rows, strict=True)], pa.binary())], names=["grade", "at", "value"])


def sampled_ids(labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """At most ``rows`` labelled ids in order of their hashes, with ``columns``."""
    return labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(3)), *columns).limit(rows).select("doc_id", *columns)


def sample_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of ``sample`` (``doc_id`` and a label) that has a document, with its ``text``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return sample.join(texts, "doc_id")


def quality_grade(quality: str = "quality", toxic: str = "toxic"):
    """Grades 0 (poor), 1 (good text, but toxic), 2 (good)."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when(F.col(quality) == 1, 2)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """``labels``: ``doc_id, grade`` (0, 1, ...; null is left out)."""
    spark = docs.sparkSession
    # at most sample_rows rows, whatever the table
    ids = sampled_ids(labels.where("grade is not null"), ["grade"], sample_rows).collect()
    if not ids:
        return Ordinal(np.zeros(WIDTH, np.float32), np.zeros(0))
    sample = small_table(spark, ids, [("doc_id", pa.int64()), ("grade", pa.int32())])
    texts = sample_texts(docs, sample, id_col, text_col)
    rows = texts.select("grade", "text").mapInArrow(lean(_sparse), "grade int, at binary, value binary").collect()
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    y = np.array([r.grade for r in rows], np.int64)
    order = np.lexsort((x @ np.random.Generator(np.random.PCG64(1)).random(WIDTH, np.float32), y))  # the same sums whatever order rows came in
    return fit_ordinal(x[order], y[order])


def _score(model: Ordinal, text_at: int, accept_grade: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.astype(np.float64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                if len(model.thresholds):
                    # a text at a time: the features of 500 together take 33 MB of a worker
                    tails = model.tails_at(np.array([features(t) @ weights for t in part.column(text_at).to_pylist()]))
                    grade, tail = tails.sum(1), tails[:, min(accept_grade, tails.shape[1]) - 1]
                else:
                    grade, tail = np.zeros(part.num_rows), np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(grade, pa.float64()), pa.array(tail, pa.float64())], names=[*part.schema.names, *names])

    return run


def score_quality(docs: DataFrame, model: Ordinal, accept_grade: int = 1, text_col: str = "text", names: tuple[str, str] = ("expected_grade", "accept_probability")) -> DataFrame:
    """``docs`` with the expected grade and P(grade >= ``accept_grade``) under ``names`` (replacing such columns)."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return docs.mapInArrow(lean(_score(model, docs.columns.index(text_col), accept_grade, names)), schema)
