"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its words. Training is on the noisy-or of the
sentences: one minus the product of their chances to be clean. Only document labels are needed for it, yet the sentences
that raise a document's score can be named afterwards.

A document's score is the noisy-or of its offending sentences (score of at least OFFENDING) or, without one, the largest
score of a sentence. So the small scores of clean sentences never add up, however many a document has.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices

PER_CLASS = 3000
SAMPLE_BYTES = 24 << 20
OFFENDING = 0.5
EPOCHS = 150
RATE = 0.08
DECAY = 2e-4
LEAST_DOCS = 3
KEPT = 0.02
STEM = 5
MARK = "^"
TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
BREAKS = frozenset(".!?\n")


class Model:
    """Weights of words and of their first letters (keys with a leading mark), and bias of the sentence score."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights = {w: x for w, x in weights.items() if w[0] != MARK}
        self.stems = {w[1:]: x for w, x in weights.items() if w[0] == MARK}
        self.bias = bias

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence that holds a word; an empty text has none."""
        out, at, z, words = [], 0, self.bias, 0
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in TOKENS.finditer(low + "."):
            if m[0] in BREAKS:
                if words:
                    out.append((at, min(m.end(), len(text)), float(1 / (1 + np.exp(-z)))))
                at, z, words = m.end(), self.bias, 0
            else:
                z += self.weights.get(m[0], 0.0) + self.stems.get(m[0][:STEM], 0.0)
                words += 1
        return out

    def score(self, text: str) -> float:
        """Noisy-or over the offending sentences, else the largest score; a text without words counts as one sentence
        without weighted words."""
        weights, stems, log_clean, top, z, weighted = self.weights, self.stems, 0.0, -np.inf, self.bias, False
        least = float(np.log(OFFENDING / (1 - OFFENDING)))
        tokens = TOKENS.findall(text.lower())
        tokens.append(".")
        for t in tokens:
            if t in BREAKS:
                if weighted:
                    if z >= least:
                        log_clean -= np.logaddexp(0, z)
                    top = max(top, z)
                z, weighted = self.bias, False
            else:
                w, s = weights.get(t), stems.get(t[:STEM])
                if w is not None:
                    z += w
                    weighted = True
                if s is not None:
                    z += s
                    weighted = True
        return float(-np.expm1(log_clean if log_clean else -np.logaddexp(0, max(top, self.bias))))


def train(texts: list[str], labels: list[int]) -> Model:
    """Gradient descent (Adam) on the noisy-or likelihood of document labels; the bias is raised at the end so that the
    highest sentences of the training documents part the classes at 0.5."""
    y = np.array(labels, bool)
    if not y.any() or y.all():
        return Model({}, 12.0 if len(y) and y.all() else -12.0)
    seen: dict[str, int] = {}
    for text in texts:
        own = set(TOKENS.findall(text.lower())) - BREAKS
        for w in own | {MARK + w[:STEM] for w in own}:
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCS))}
    word, sentence, owner = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        start = len(owner)
        fresh = True
        for t in TOKENS.findall(text.lower()):
            if t in BREAKS:
                fresh = True
                continue
            if fresh:
                owner.append(d)
                fresh = False
            for feature in (t, MARK + t[:STEM]):
                if feature in vocabulary:
                    word.append(vocabulary[feature])
                    sentence.append(len(owner) - 1)
        if len(owner) == start:
            owner.append(d)
    word, sentence, owner = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (word, sentence, owner))
    w, b = np.zeros(len(vocabulary)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * len(y)
    for step in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(sentence, w[word], len(owner)), -60, 60)))
        log_clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        toxic = np.maximum(-np.expm1(log_clean), 1e-12)
        slope = np.where(y, -(1 - toxic) / toxic, 1.0) * share
        dz = p * slope[owner] / len(y)
        g, gb = np.bincount(word, dz[sentence], len(w)) + DECAY * np.sign(w) * (w != 0), dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = RATE / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= scale * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, b + np.bincount(sentence, w[word], len(owner)))
    b -= min(0.0, max(b + 2, parting(top, y)))
    return Model({t: float(w[i]) for t, i in vocabulary.items() if abs(w[i]) > KEPT}, float(b))


def parting(values: np.ndarray, y: np.ndarray) -> float:
    """The cut with the least sum of error rates (the middle of equally good ones); a value at the cut counts as true."""
    cuts = np.unique(values)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1)
    missed = np.searchsorted(np.sort(values[y]), cuts) / y.sum()
    false = 1 - np.searchsorted(np.sort(values[~y]), cuts) / (~y).sum()
    best = cuts[missed + false <= (missed + false).min() + 1e-12]
    return float((best[0] + best[-1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample: of the ``per_class`` labelled documents of each class that come first by a hash of their
    id, none of them held out, those that still fit into half of ``sample_bytes`` (UTF-8), taken in that order and whole,
    whatever their length. So the driver holds at most ``sample_bytes`` of text."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # Of repeated ids the longest text bounds what is fetched.
    ids = texts.select("doc_id", F.octet_length("text").alias("n")).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
    picked = []
    for mark in (1, 0):
        room = sample_bytes // 2
        for r in ids.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "n").collect():
            if r["n"] <= room:
                room -= r["n"]
                picked.append((r["doc_id"], mark))
    # At most 2 * per_class ids, so the texts are picked where they are read.
    chosen = docs.sparkSession.createDataFrame(picked, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("toxic", "doc_id").select("text", "toxic").toArrow()
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default) with ``out``, the score of each whole text; null is empty."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in inner.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = [own.score(x or "") for x in batch.column("text").to_pylist()]
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, out])

    return inner.mapInArrow(run, f"{schema}, `{out}` double")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Offending sentences: doc_id, start and end in the text (code points), score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [(i, *s) for i, x in enumerate(batch.column("text").to_pylist()) for s in own.sentences(x or "") if s[2] >= least]
            row, start, end, p = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p, pa.float64())], ["doc_id", "start", "end", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, end long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Labels are learned only from rows not held out; labels that are null or neither 0 nor 1 are left aside, of repeated
    ones the largest counts. Without labels of both classes every score is near 0 (near 1 if all are toxic). Repeated
    rows stay; null ids are never learned from and not held out; an empty table gives no rows.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
