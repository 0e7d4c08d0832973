"""Toxicity by a factorization machine over hashed terms.

``score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)`` over the distinct terms of a text: pairs that are toxic
only together (an insult and a group's name) get a weight of their own through their factor vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.text import ALNUM, byte_texts, fetch, id_text, word_hashes

#: labelled rows that a fit uses at most (those with the smallest hash of doc_id)
SAMPLE = 20_000
#: terms in fewer texts of the sample have no weight, nor have those whose share of toxic texts is within so many
#: standard deviations of the overall one: rare chance terms would let the fit memorise its sample
LEAST_TEXTS = 4
LEAST_LEAN = 3.0
VOCABULARY = 1 << 16
FACTORS = 8
EPOCHS = 12
BATCH = 128
RATE = 0.3
DECAY = 1e-4
#: squared gradient that every term starts from, so that a rare term moves little
INIT = 1.0
FOLDS = 5


@dataclass
class Machine:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid; a text without known terms has the bias."""
        out = np.full(len(texts), self.bias)
        for i, terms in enumerate(texts):
            at = np.searchsorted(self.terms, terms)
            at[at == len(self.terms)] = 0
            at = at[self.terms[at] == terms] if len(self.terms) else at[:0]
            v = self.vectors[at]
            total = v.sum(axis=0)
            out[i] += self.weights[at].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def distinct_terms(texts: list[bytes]) -> list[np.ndarray]:
    return [np.unique((h >> np.uint64(34)).astype(np.int32)) for h in word_hashes(texts, ALNUM)]


def fit(texts: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Log loss, AdaGrad on batches. Deterministic for the same rows in the same order."""
    none = Machine(np.zeros(0, np.int32), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(texts):
        none.bias = -1.0
        return none
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    none.bias = float(np.log(rate / (1 - rate)))
    terms, counts = np.unique(np.concatenate(texts), return_counts=True)
    toxic = np.concatenate([t for t, y in zip(texts, labels) if y] or [terms[:0]])
    hits = np.bincount(np.searchsorted(terms, toxic), minlength=len(terms))
    lean = np.abs(hits - counts * rate) / np.sqrt(counts * rate * (1 - rate))
    told = np.flatnonzero((counts >= LEAST_TEXTS) & (lean >= LEAST_LEAN))
    terms = terms[np.sort(told[np.argsort(-lean[told], kind="stable")[:VOCABULARY]])]
    if not len(terms) or labels.min() == labels.max():
        return none
    rng = np.random.default_rng(11)
    model = Machine(terms, none.bias, np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS)))
    coded = [np.searchsorted(terms, t[np.isin(t, terms, assume_unique=True)]) for t in texts]
    grad_w, grad_v, grad_b = np.full(len(terms), INIT), np.full((len(terms), FACTORS), INIT), INIT
    for _ in range(EPOCHS):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), BATCH):
            rows = [coded[i] for i in order[at:at + BATCH]]
            sizes = np.array([len(r) for r in rows])
            flat = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), sizes)
            v = model.vectors[flat]
            total = np.stack([np.bincount(owner, v[:, k], len(rows)) for k in range(FACTORS)], axis=1)
            square = np.bincount(owner, (v * v).sum(axis=1), len(rows))
            raw = model.bias + np.bincount(owner, model.weights[flat], len(rows)) + 0.5 * ((total * total).sum(axis=1) - square)
            error = sigmoid(raw) - labels[order[at:at + BATCH]]
            grad_b += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(grad_b)
            touched, where = np.unique(flat, return_inverse=True)
            each = error[owner]
            step = np.bincount(where, each, len(touched)) + DECAY * model.weights[touched]
            grad_w[touched] += step * step
            model.weights[touched] -= RATE * step / np.sqrt(grad_w[touched])
            pull = each[:, None] * (total[owner] - v)
            for k in range(FACTORS):
                step = np.bincount(where, pull[:, k], len(touched)) + DECAY * model.vectors[touched, k]
                grad_v[touched, k] += step * step
                model.vectors[touched, k] -= 0.25 * RATE * step / np.sqrt(grad_v[touched, k])
    return model


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = distinct_terms(byte_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([t.tobytes() for t in terms], pa.binary())], ["doc_id", "terms"])


def held_out(doc_id: str = "doc_id"):
    return F.expr(f"coalesce(crc32(CAST({doc_id} AS STRING)) % {FOLDS} = 0, true)")


def fit_labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; only their distinct hashed terms reach the
    driver. A doc_id with several labels counts as toxic if one of them is; several texts of it all take part."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    marks = {r.doc_id: r.toxic for r in chosen.collect()}
    ids = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": np.array(list(marks), np.int64)}), "doc_id long")
    rows = sorted((r.doc_id, bytes(r.terms)) for r in
                  fetch(docs, ids).mapInArrow(_term_rows, "doc_id long, terms binary").toLocalIterator())
    return fit([np.frombuffer(t, np.int32) for _, t in rows], np.array([float(marks[i] > 0) for i, _ in rows]))


def toxicity(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, text, score, predicted) for every row of ``docs`` (doc_id, text); one narrow pass. NULL, empty and
    wordless texts score the model's bias. Repeated rows are scored alike; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score = sigmoid(model.raw(distinct_terms(byte_texts(part.column("text")))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "text", "score", "predicted"])

    return id_text(docs).mapInArrow(run, "doc_id long, text string, score double, predicted int")


def without_toxic(docs: DataFrame, model: Machine) -> DataFrame:
    """The rows of ``docs`` (``text`` and any columns) that are not predicted toxic, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(model.raw(distinct_terms(byte_texts(batch.column(at)))) < 0, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
