"""Log-bilinear language model with noise-contrastive estimation, trained and run in NumPy inside Spark tasks.

The vocabulary is cut into CLASSES classes: the end, the most frequent words, and tail buckets that hold all other words
by their first letters. The model predicts a class from the two before it; a tail word's probability is its bucket's
times its smoothed share of the bucket, with one unseen word in each bucket, so that probabilities sum to 1.

All counts are over all training documents. Training takes every place of each of them once: a round takes every
ROUNDS-th place of a text, the rounds together all. Each task trains a copy of the parameters; the copies are averaged by
their number of places after each round (Zinkevich and others, 2010).
Because the score is the sum of a term for either context word, all normalisers are one product of two matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.llm import tokens
from placeframe.llm.scratch import table

CLASSES, BUCKETS, DIMENSIONS = 2048, 255, 24
#: At most so many words whose counts every task holds (3 MB); the counts of the others meet the documents in a shuffle.
FREQUENT = 131_072
ROUNDS, NOISE, BATCH, RATE = 2, 256, 1024, 0.1
#: Copies of the parameters that one task adds up.
FAN_IN = 64

END = 0
_HEAD = CLASSES - BUCKETS - 1


def bucket_of(words: tokens.Words) -> np.ndarray:
    """Tail bucket of each word by its first two bytes."""
    first = words.data[words.starts].astype(np.uint64)
    second = np.where(words.ends - words.starts > 1, words.data[np.minimum(words.starts + 1, len(words.data) - 1)], 0).astype(np.uint64)
    return (tokens.mix(first * np.uint64(257) + second + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Vocabulary:
    """Frequent words by name (128 bits), with count and class (-1: by bucket); total and different training tokens."""

    hashes: np.ndarray
    seconds: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    total: int
    different: int
    end_count: int
    class_mass: np.ndarray

    def look_up(self, words: tokens.Words) -> tuple[np.ndarray, np.ndarray, tokens.Lanes]:
        """Count (-1: not among the frequent), class and name of each word."""
        h, g = words.names()
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64), _HEAD + 1 + bucket_of(words), (h, g)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = (self.hashes[at] == h) & (self.seconds[at] == g)
        named = np.where(found, self.classes[at], -1)
        return np.where(found, self.counts[at], -1), np.where(named >= 0, named, _HEAD + 1 + bucket_of(words)), (h, g)


def with_ends(words: tokens.Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values with each text's end behind them, and the row of each."""
    n = len(words.first) - 1
    out = np.full(len(values) + n, end, values.dtype)
    out[np.arange(len(values)) + words.row] = values
    return out, np.repeat(np.arange(n), np.diff(words.first) + 1)


def contexts(classes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before, the end where the text begins."""
    one, two = np.full(len(classes), END, classes.dtype), np.full(len(classes), END, classes.dtype)
    one[1:] = np.where(row[1:] == row[:-1], classes[:-1], END)
    two[2:] = np.where(row[2:] == row[:-2], classes[:-2], END)
    return one, two


class Model:
    """score(w | u, v) = (A[u] + B[v]) . Q[w] + b[w]; u is the class before w, v the one before that."""

    def __init__(self, mass: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.noise = mass / mass.sum()
        shape = (CLASSES, DIMENSIONS)
        self.parts = [rng.normal(0, 0.1, shape).astype(np.float32) for _ in range(3)]
        self.parts.append(np.log(self.noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rng: np.random.Generator, state: list[np.ndarray]) -> None:
        """Noise-contrastive steps with AdaGrad; a batch shares its noise, so that its scores are matrix products."""
        a, b, q, bias = self.parts
        offset = (np.log(self.noise) + math.log(NOISE)).astype(np.float32)
        for at in range(0, len(target), BATCH):
            u, v, w = one[at : at + BATCH], two[at : at + BATCH], target[at : at + BATCH]
            noise = np.searchsorted(self.steps, rng.random(NOISE)).clip(0, CLASSES - 1)
            r = a[u] + b[v]
            true = np.einsum("ij,ij->i", r, q[w]) + bias[w] - offset[w]
            false = r @ q[noise].T + (bias - offset)[noise]
            d_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))
            d_false = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
            d_r = d_true[:, None] * q[w] + d_false @ q[noise]
            seen = np.concatenate([w, noise])
            d_q = np.vstack([d_true[:, None] * r, d_false.T @ r])
            d_bias = np.concatenate([d_true, d_false.sum(axis=0)])
            for part, kept, rows, grad in ((0, state[0], u, d_r), (1, state[1], v, d_r), (2, state[2], seen, d_q), (3, state[3], seen, d_bias)):
                which, back = np.unique(rows, return_inverse=True)
                if grad.ndim == 1:
                    total = np.bincount(back, grad, len(which)).astype(np.float32)
                else:
                    order = np.argsort(back, kind="stable")
                    total = np.add.reduceat(grad[order], np.searchsorted(back[order], np.arange(len(which))), axis=0)
                kept[which] += total * total
                self.parts[part][which] += RATE * total / np.sqrt(kept[which])

    @property
    def steps(self) -> np.ndarray:
        if not hasattr(self, "_steps"):
            self._steps = np.cumsum(self.noise)
        return self._steps

    def normalisers(self) -> np.ndarray:
        """log Z of every two context classes, u * CLASSES + v: exp is taken of either term alone."""
        a, b, q, bias = (p.astype(np.float64) for p in self.parts)
        left, right = a @ q.T + bias, b @ q.T
        top, side = left.max(axis=1, keepdims=True), right.max(axis=1, keepdims=True)
        z = np.exp(left - top) @ np.exp(right - side).T
        return (np.log(np.maximum(z, 1e-300)) + top + side.T).astype(np.float32).ravel()

    def log_probability(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, log_z: np.ndarray) -> np.ndarray:
        """Natural logarithms, batch by batch."""
        a, b, q, bias = self.parts
        out = np.empty(len(target))
        for at in range(0, len(target), 1 << 16):
            s = slice(at, at + (1 << 16))
            u, v, w = one[s], two[s], target[s]
            out[s] = np.einsum("ij,ij->i", a[u] + b[v], q[w]) + bias[w] - log_z[u.astype(np.int64) * CLASSES + v]
        return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        for _, _, data, at in tokens.parts(batch, most=4 * tokens.PART_BYTES):
            words = tokens.Words(data, at, lower=True)
            h, g = words.names()
            order, starts = _groups(h, g)
            first = order[starts]
            yield from tokens.rows_of([{"h": h[first], "g": g[first], "bucket": bucket_of(words)[first], "n": np.diff(np.append(starts, len(h))).astype(np.int64)}], schema)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which equal keys are neighbours, and where each different one begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 2 else np.argsort(keys[0], kind="stable")
    if len(keys) == 2:  # the first key alone nearly always tells them apart
        x, y = (k[order] for k in keys)
        if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
            order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def count(training: DataFrame) -> DataFrame:
    """h, g, bucket, n: how often each word stands in training(text); added up by part before the shuffle. A written table."""
    rows = training.select("text").mapInArrow(_counted, "h long, g long, bucket int, n long")
    return table(rows.groupBy("h", "g", "bucket").agg(F.sum("n").alias("n")), "counts")


def frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of at most about `most` words of the highest counts.

    Counts are taken by levels of 64 to an octave, so that some thousand groups tell where to stop. Of the level in which
    `most` is reached, the words with the smallest hashes are taken, as many as are missing by their share.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    held = 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        if held + r["n"] > most:
            share = (most - held) / r["n"]
            return counts.where((level > r["level"]) | ((level == r["level"]) & (F.col("h") / F.lit(2.0**64) + 0.5 < share)))
        held += r["n"]
    return counts


def vocabulary(counts: DataFrame, documents: int, most: int = FREQUENT) -> Vocabulary:
    """documents: how many ends the training tokens hold.

    The _HEAD most frequent words are classes of their own, all others share the tail buckets: a word of a bucket has
    the model's probability of the bucket times its smoothed share of it.
    """
    words, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counts, most).toPandas().sort_values(["n", "h", "g"], ascending=[False, True, True])
    classes = np.full(len(top), -1, np.int64)
    classes[:_HEAD] = np.arange(1, min(_HEAD, len(top)) + 1)
    head = top[:_HEAD]
    mass = np.full(CLASSES, 0.5)
    mass[END] += documents
    mass[1 : 1 + len(head)] += head["n"].to_numpy()
    for r in counts.groupBy("bucket").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        mass[_HEAD + 1 + r["bucket"]] += r["m"]
    np.subtract.at(mass, _HEAD + 1 + head["bucket"].to_numpy(np.int64), head["n"].to_numpy() + 0.5)
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], top["g"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order], classes[order], int(words) + documents, int(different) + (documents > 0), documents, mass)


def _places(batch: pa.RecordBatch, known: Vocabulary, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts and targets of a round's places, told by the place in the text, so that the cut of batches does not matter."""
    for _, _, data, at in tokens.parts(batch):
        words = tokens.Words(data, at, lower=True)
        classes, row = with_ends(words, known.look_up(words)[1], END)
        one, two = contexts(classes, row)
        start = words.first[:-1] + np.arange(len(words.first) - 1)
        own = (np.arange(len(row)) - start[row]) % ROUNDS == turn
        yield one[own], two[own], classes[own]


def train(training: DataFrame, known: Vocabulary) -> Model:
    """Rounds of training on copies; a task's copy weighs as many places as it saw."""
    spark = training.sparkSession
    model = Model(known.class_mass)
    size = len(model.flat())
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((known, model.flat()))

        def local(batches: Iterable[pa.RecordBatch], turn: int = turn, held=held) -> Iterator[pa.RecordBatch]:
            words, flat = held.value
            own = Model(words.class_mass)
            own.load(flat)
            rng = np.random.default_rng(turn)
            state = [np.full(p.shape, 1.0, np.float32) for p in own.parts]
            n = 0
            for batch in batches:
                for one, two, target in _places(batch, words, turn):
                    order = rng.permutation(len(target))
                    own.train(one[order], two[order], target[order], rng, state)
                    n += len(target)
            if n:
                yield _copy(own.flat() * np.float32(n), n)

        copies = trained = training.select("text").mapInArrow(local, "sum binary, n long")
        left = max(1, training.rdd.getNumPartitions())
        while left > 1 or copies is trained:  # a tree: no task adds up more than about FAN_IN copies
            left = -(-left // FAN_IN)
            copies = copies.repartition(left).mapInArrow(_added, "sum binary, n long")
        for r in copies.collect():
            model.load(np.frombuffer(r["sum"], np.float32)[:size] / np.float32(r["n"]))
        held.unpersist()
    return model


def _copy(total: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()]), pa.array([n], pa.int64())], names=["sum", "n"])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for held, m in zip(batch.column(0), batch.column(1), strict=True):
            own = np.frombuffer(held.as_buffer(), np.float32)
            total = own.astype(np.float64) if total is None else total + own
            n += m.as_py()
    if n:
        yield _copy(total, n)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, counted double, model double, rest array<struct<h:long,g:long,tf:long>>"


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs(doc_id, text).

    Words are runs of other characters than white space with A-Z in lower case, and each text has one end; null text is
    empty. Learns from the rows that are not held out. base_score: log10 of the smoothed unigram counts; score: the
    model's log10 probability of the text. Repeated rows repeat. Without training rows the base is that of counts 0 and
    the model that of its start. An empty table gives an empty result. Words are told apart by keyed names of 128 bits.
    A very long text is worked on whole, some 60 bytes a byte in a worker. Other columns of docs, whatever their names,
    are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = own.where("NOT held_out")
    counts = count(training)
    known = vocabulary(counts, training.count())
    model = train(training, known)
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast((known, model, model.normalisers()))
    floor = math.log10(0.5)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, log_z = held.value
        within = np.log10(known.class_mass)  # taken off for a word of a tail bucket
        names = ["doc_id", "held_out", "n_tokens", "n_known", "counted", "model", "rest"]
        for batch in batches:
            for row, end, data, at in tokens.parts(batch):
                words = tokens.Words(data, at, lower=True)
                n_rows = end - row
                count_of, classes, (h, g) = known.look_up(words)
                tail = classes > _HEAD
                seen, rows = with_ends(words, classes, END)
                one, two = contexts(seen, rows)
                logs = model.log_probability(one, two, seen, log_z) / math.log(10)
                by_model = np.bincount(rows, logs, n_rows) - np.bincount(words.row[tail], within[classes[tail]], n_rows)
                here = count_of >= 0
                log_count = np.log10(np.where(here, count_of, 0) + 0.5)
                counted = np.bincount(words.row[here], log_count[here], n_rows) + math.log10(known.end_count + 0.5)
                # words of a tail bucket owe the model their counts' logarithm; those that are not here get it later
                by_model += np.bincount(words.row[here & tail], log_count[here & tail], n_rows)
                n_known = np.bincount(words.row[here], minlength=n_rows) + (known.end_count > 0)
                away = words.row[~here], h[~here], g[~here]
                order, starts = _groups(*away)
                tf = np.diff(np.append(starts, len(order))).astype(np.int64)
                row_of, *names_of = (x[order[starts]] for x in away)
                cuts = np.searchsorted(row_of, np.arange(n_rows + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([*(pa.array(x.view(np.int64)) for x in names_of), pa.array(tf)], ["h", "g", "tf"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n_rows),
                        batch.column(1).slice(row, n_rows),
                        pa.array(np.diff(words.first).astype(np.int64) + 1),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(counted),
                        pa.array(by_model),
                        rest,
                    ],
                    names=names,
                )

    # written once: the rare words go to meet their counts, the rest waits
    done = own.mapInArrow(scored, _SCORED).withColumn("row", F.monotonically_increasing_id())
    done = table(done, "scored")
    rare = done.select("row", F.explode("rest").alias("r")).select("row", "r.h", "r.g", "r.tf")
    logs = F.when(F.col("n").isNull(), F.lit(floor)).otherwise(F.log10(F.col("n") + 0.5))
    found = rare.join(counts.select("h", "g", "n"), ["h", "g"], "left").groupBy("row").agg(
        F.sum(F.col("tf") * logs).alias("later"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("known_later")
    )
    norm = math.log10(known.total + 0.5 * (known.different + 1))
    later = F.coalesce("later", F.lit(0.0))
    return done.drop("rest").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_later", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("counted") + later - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + later).alias("score"),
    )

