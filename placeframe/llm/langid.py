"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features of a text are the square roots of its hashed byte 2- and 3-gram counts, scaled to length 1. Families are found
from the learned languages' mean features by average linkage, so close languages share one. Every classifier is a linear
support vector machine (squared hinge) trained here in NumPy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.llm import tokens

UNKNOWN = "und"
#: Width of the features; labelled rows that training takes, over all languages, and for each one at least if it has them.
WIDTH, SAMPLE, LEAST = 2048, 4000, 20
#: Labels that can be learned, as the sample of each comes to the driver: more are an error, none is left out.
LANGUAGES = 500

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_LETTER = re.compile("[A-Za-z]")


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row for each text of a part; letters in lower case, any other ASCII character as a blank."""
    n = len(at) - 1
    total = np.zeros(n * WIDTH)
    if len(data) > 1:
        x = _FOLD[data].astype(np.uint32)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
        pair = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
        for gram in (pair, pair[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)):
            if not len(gram):
                continue
            inside = row[: len(gram)] == row[len(row) - len(gram) :]
            cell = ((gram * np.uint32(0x165667B1)) >> np.uint32(21)).astype(np.int64) + row[: len(gram)] * WIDTH
            total += np.bincount(cell[inside], minlength=n * WIDTH)
    out = np.sqrt(total.reshape(n, WIDTH))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM for y in {-1, 1}: squared hinge, both classes of equal weight, Nesterov steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, back = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    rate = 1 / (4 + penalty)
    for i in range(steps):
        ahead = w + (i / (i + 3)) * (w - back)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        back, w = w, ahead - rate * (penalty * ahead - 2 * (x.T @ (share * y * slack)))
    return w


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages: the closest groups are joined until their number is the root of the languages'.

    Of equally close ones those of the first names are joined.
    """
    groups = [[i] for i in range(len(means))]
    total = means @ means.T  # sums of the similarities between the members of two groups
    while len(groups) > max(1, round(len(means) ** 0.5)):
        size = np.array([len(g) for g in groups])
        near = np.where(np.triu(np.ones_like(total, bool), 1), total / np.outer(size, size), -np.inf)
        a, b = np.unravel_index(near.argmax(), near.shape)
        total[a] += total[b]
        total[:, a] += total[:, b]
        total = np.delete(np.delete(total, b, 0), b, 1)
        groups[a] += groups.pop(b)
    return groups


class Model:
    """One classifier for each family against the rest and one for each two languages of a family."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.names = sorted(set(labels.tolist()))
        own = [x[labels == name] for name in self.names]
        means = np.stack([m.mean(axis=0) for m in own]) if own else np.empty((0, WIDTH), np.float32)
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        self.groups = families(means) if own else []

        def between(a: list[int], b: list[int]) -> np.ndarray:
            left, right = np.vstack([own[i] for i in a]), np.vstack([own[i] for i in b])
            return svm(np.vstack([left, right]), np.r_[np.ones(len(left)), -np.ones(len(right))].astype(np.float32))

        several = len(self.groups) > 1
        self.family = [between(g, [i for h in self.groups if h is not g for i in h]) for g in self.groups] if several else []
        self.pair = {(a, b): between([a], [b]) for g in self.groups for k, a in enumerate(g) for b in g[k + 1 :]}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's language, and a score from 0 to 1: the share of the decisions' logistic margins."""

        def margin(w: np.ndarray) -> np.ndarray:
            return x @ w[:-1] + w[-1]

        logistic = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        score = np.ones(len(x))
        group = np.zeros(len(x), np.int64)
        if self.family:
            margins = np.stack([margin(w) for w in self.family], axis=1)
            group = margins.argmax(axis=1)
            score = logistic(margins.max(axis=1))
        best = np.zeros(len(x), np.int64)
        for k, g in enumerate(self.groups):
            votes, sure = np.zeros((len(x), len(g))), np.zeros((len(x), len(g)))
            for (a, b), w in self.pair.items():
                if a in g:
                    m = margin(w)
                    for i, s in ((g.index(a), m), (g.index(b), -m)):
                        votes[:, i] += s > 0
                        sure[:, i] += logistic(s)
            first = np.lexsort((-sure, -votes), axis=1)[:, 0] if len(g) > 1 else np.zeros(len(x), np.int64)
            rows = group == k
            best[rows] = np.array(g)[first[rows]]
            if len(g) > 1:
                score[rows] *= (sure[np.arange(len(x)), first] / (len(g) - 1))[rows]
        return best, score


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [f.tobytes() for _, _, data, at in tokens.parts(batch) for f in features(data, at)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["lang", "held"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled(doc_id, text, lang). A language with more than its even share of `sample` rows gives the
    rows whose hash falls below its rate, about that share; the others give all."""
    own = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: not a column of languages")
    if not counts:
        return Model(np.empty((0, WIDTH), np.float32), np.empty(0, object))
    rates = own.sparkSession.createDataFrame([(r["lang"], min(1.0, max(LEAST, sample / len(counts)) / r["n"])) for r in counts], "lang string, rate double")
    taken = own.join(F.broadcast(rates), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("rate"))
    rows = taken.select("lang", "text").mapInArrow(_sampled, "lang string, held binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["held"])))
    return Model(np.stack([np.frombuffer(r["held"], np.float32) for r in rows]) if rows else np.empty((0, WIDTH), np.float32), np.array([r["lang"] for r in rows], object))


def _has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _predicted(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = [], []
        texts = batch.column(2)
        for row, end, data, at in tokens.parts(batch):
            if model.names:
                best, score = model.predict(features(data, at))
            for i in range(end - row):
                known = bool(model.names) and _has_letter(texts[row + i].as_py())
                langs.append(model.names[best[i]] if known else UNKNOWN)
                scores.append(float(score[i]) if known else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, text, lang); learns from rows not held out.

    Null text, and text without a letter, is 'und' with score 0, as is all where nothing can be learned; null lang
    teaches nothing. Only the text is an input of a prediction. Of equally sure languages the first by name is taken.
    Repeated rows repeat; an empty table gives an empty result. A very long text is counted whole, some 60 bytes a byte
    in a worker. Other columns of docs, whatever their names, are ignored. More labels than LANGUAGES are an error.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), "lang")
    model = fit(own.where("NOT held_out"), sample)
    return own.drop("lang").mapInArrow(partial(_predicted, model=model), "doc_id long, held_out boolean, lang_pred string, score double")
