"""Fingerprints and whitening against plain versions."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeframe.llm import queries, simhash, whitening

R = np.random.default_rng(5)


# --- op12 ---

TEXTS = ["a b c d e f", None, "", "x", "one two three four " * 40, "é ü ß 漢字 " * 9, " \t\n", "word " * 70_000, "a b c d e f", "Rare words only here"] + [" ".join(f"w{i % (k + 3)}" for i in range(60)) for k in range(30)]


def fingerprinted(spark, ids, texts, n=3):
    docs = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, hi string").repartition(n)
    return docs, simhash.weights(docs)


def test_edits_and_successors_meet_plain_python(spark):
    ids = [int(i) for i in R.permutation(len(TEXTS)) * 3]
    docs, weight = fingerprinted(spark, ids, TEXTS)
    made = {r.id: r for r in simhash.against_edits(docs, weight).collect()}
    ranked = sorted(zip(ids, TEXTS, strict=True), reverse=True)
    prints = {}
    for (i, t), (j, s) in zip(ranked, ranked[1:] + ranked[:1], strict=True):
        t, s, r = t or "", s or "", made[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + s[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.next_hi, r.next_lo) == (made[j].hi, made[j].lo)
        hi, lo = simhash.fingerprints_of(pa.array([edited]), weight)
        assert (r.edited_hi, r.edited_lo) == (int(hi.view(np.int64)[0]), int(lo.view(np.int64)[0]))
        assert prints.setdefault(t, (r.hi, r.lo)) == (r.hi, r.lo)
        assert bool(t.split()) == ((r.hi, r.lo) != (0, 0))
    direct = {r.doc_id: (r.hi, r.lo) for r in simhash.fingerprint(docs, weight).collect()}
    assert direct == {i: (r.hi, r.lo) for i, r in made.items()}


def test_votes_are_those_of_single_words():
    """A bit is 1 where the weights of the words that have it, times 1 + ln(count), are more than half of all."""
    weight = np.ones(1 << simhash.SLOT_BITS, np.float32) * 10
    words = ["aa", "bb", "cc"]
    alone = {w: [int(x[0]) for x in simhash.fingerprints_of(pa.array([w]), weight)] for w in words}
    hi, _ = simhash.fingerprints_of(pa.array(["aa bb CC aa aa"]), weight)
    w = {"aa": round(10 * (1 + math.log(3))), "bb": 10, "cc": 10}
    want = sum(1 << b for b in range(64) if sum(w[x] * (1 if alone[x][0] >> b & 1 else -1) for x in words) > 0)
    assert int(hi[0]) == want


@pytest.mark.parametrize(("ids", "texts"), [([], []), ([7], ["only one here"]), ([None, None, 4, 4], ["x y", "x y", "p q", None])])
def test_few_documents(spark, ids, texts):
    docs, weight = fingerprinted(spark, ids, texts)
    rows = simhash.against_edits(docs, weight).collect()
    assert len(rows) == len(ids)
    if len(ids) == 1:
        assert (rows[0].next_hi, rows[0].next_lo) == (rows[0].hi, rows[0].lo)


@pytest.mark.parametrize("radius", [0, 3, 6])
@pytest.mark.parametrize("piece", [4096, 3])
def test_near_counts_meet_brute_force(spark, monkeypatch, radius, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    base = [int.from_bytes(R.bytes(16), "big") for _ in range(6)]
    prints = base + [b ^ sum(1 << int(k) for k in R.choice(128, n, replace=False)) for b in base for n in range(9)] + base[:2] * 20
    rows = [(i, (p >> 64) - (1 << 64 if p >> 127 else 0), (p & (1 << 64) - 1) - (1 << 64 if p >> 63 & 1 else 0)) for i, p in enumerate(prints)]
    made = simhash.near_counts(spark.createDataFrame(rows, "id long, hi long, lo long").repartition(4), F.col("id") % 5 == 0, radius)
    got = {((r.hi % (1 << 64)) << 64) + r.lo % (1 << 64): r.n_near for r in made.collect()}
    assert got == {p: sum((p ^ x).bit_count() <= radius for x in prints) for i, p in enumerate(prints) if i % 5 == 0}


def test_edited_texts_are_nearer_than_successors(spark, sf):
    got = queries.QUERIES["op12_document_fingerprints"](spark, sf)
    r = got.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("right"), F.min("near_next").alias("low"), F.max("near_edited").alias("high")).first()
    assert r.right > 0.95 and r.low >= 0 and r.high <= 1
    assert got.where("(n_near is not null) <> (doc_id % 20 = 0)").count() == 0


# --- op13 ---


def plain_whitening(vectors):
    """Exact sums by Fraction, covariance and eigenvectors by NumPy."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return deviations, e[::-1], u[:, ::-1], centred


def test_whitening_meets_plain_version(spark):
    vectors = (R.normal(size=(300, 12)) @ R.normal(size=(12, 12)) / 8).astype(np.float32)
    rows = [(i, [float(c) for c in v], i) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [], 0), (902, [None] + [0.5] * 11, 0), (903, [float("nan")] * 12, 0), (904, [float("inf")] + [0.1] * 11, 0), (905, [0.5] * 11, 0), (906, [1e30] + [0.0] * 11, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(5)
    got = {r.vec_id: r for r in whitening.whiten(df, components=5).collect()}
    deviations, e, u, centred = plain_whitening(vectors)
    assert sorted(got) == list(range(300))
    want = centred @ u[:, :5] / np.sqrt(e[:5])
    made = np.array([got[i].whitened for i in range(300)])
    made *= np.sign((made * want).sum(0))
    assert np.abs(made - want).max() < 1e-9
    assert [int(got[i].deviation) for i in range(300)] == deviations
    assert np.allclose(got[0].explained, e[:5] / e.sum(), rtol=1e-10)
    assert got[0].n == 300 and got[0].identity_error < 1e-9


def test_query_rows_of_components(spark, sf):
    got = queries.QUERIES["op13_embedding_whitening"](spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.count() == 8 * n
    r = got.agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("identity_error").alias("e"), F.countDistinct("identity_error").alias("k"), F.sum(F.col("deviation").cast("string").eqNullSafe(F.col("deviation_digits")).cast("int")).alias("same")).first()
    assert (r.a, r.b, r.k, r.same) == (1, 8, 1, 8 * n) and r.e < 1e-4
    vectors = [x.embedding for x in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    deviations, e, u, centred = plain_whitening(vectors)
    want = centred @ u[:, :8] / np.sqrt(e[:8])
    made = np.array([[x.whitened] for x in got.orderBy("vec_id", "component").collect()]).reshape(-1, 8)
    made *= np.sign((made * want).sum(0))
    assert np.abs(made - want).max() < 1e-6


def test_little_variance(spark):
    schema = "vec_id string, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", None), ("b", [])], schema)).collect() == []
    (one,) = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])], schema)).collect()
    assert (one.n, one.whitened, one.explained, one.identity_error, int(one.deviation)) == (1, [None, None], [0, 0], None, 0)
    rows = whitening.whiten(spark.createDataFrame([("a", [1.0, 5.0]), ("a", [1.0, 5.0]), ("b", [4.0, 5.0]), (None, [9.0, 5.0])], schema)).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None for r in rows) and rows[0].explained == [1.0, 0.0]


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(i % 7) * 1e8, 1.0]) for i in range(5000)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id").limit(3).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [int(r.deviation) for r in got] == [sum((5000 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x[:3]]
    assert int(got[0].deviation) > 1 << 63


@pytest.mark.parametrize("spread", [[5, 4, 3, 2, 1] * 8, [1.0] * 40, [1 + 1e-9 * i for i in range(40)], [10.0 ** (-i / 3) for i in range(40)], [3.0] * 4 + [0.0] * 36, [1 + 1e-12 * i for i in range(20)] + [2.0] * 20])
def test_refined_eigenvectors(spread):
    d = len(spread)
    q = np.linalg.qr(R.normal(size=(d, d)))[0]
    a = (q * np.array(spread)) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigen(a)
    assert np.all(np.diff(e) <= 0) and np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * max(spread)
    assert np.abs(x.T @ x - np.eye(d)).max() < 4e-15
    assert np.abs(a.astype(np.longdouble) @ x - x * e).max() < 4e-15 * max(spread)
