"""Jaccard join, substring dedup, packing, media, language id and LM scoring against brute force and round trips."""

from __future__ import annotations

import time
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeframe.llm import jaccard, langid, lm, media, packing, phrases, tokens

WORD = re.compile(r"[^\x20\x09-\x0d]+")
R = random.Random(7)
BASE = [f"b{R.randrange(10**6)}" for _ in range(120)]


def edited(k):
    w = list(BASE)
    for _ in range(k):
        w[R.randrange(len(w))] = f"e{R.randrange(10**6)}"
    return " ".join(w)


TEXTS = [edited(k % 6) for k in range(24)] + [" ".join(BASE)] * 3 + ["", None, "one", "One", "one two", "a b c d e f g h i j", "\x0b\n", " ".join(BASE[:60] + ["x"] * 40)]
TEXTS += [" ".join(f"u{i}x{k}" for k in range(40)) for i in range(4)] + ["é ü a\tb", " ".join(f"w{i % 900}" for i in range(5000))]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(3)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_meet_brute_force(spark, size, percent):
    sets = []
    for t in TEXTS:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    n = len(TEXTS)
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark), size, percent).collect()}
    assert made == {i: (len(sets[i]), root[i]) for i in range(n)}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_all_links_meet_brute_force(spark, size, percent):
    first = {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(lower(t))
        own = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset({tuple(w)} - {()})
        if own:
            first.setdefault(own, i)
    want = {(i, j) for x, i in first.items() for y, j in first.items() if i < j and 100 * len(x & y) >= percent * len(x | y)}
    made = [(r.a, r.b) for r in jaccard.near_links(docs(spark), size, percent).collect()]
    assert sorted(made) == sorted(want)
    assert len(want) > len({i for pair in want for i in pair}) - 1  # more links than a tree has


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (70, 80, 90):
        bands = jaccard.Bands(percent)
        for n in (10, 14, 40, 300):
            for _ in range(60):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                gone = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
                y = np.unique(np.concatenate([rng.choice(x, len(x) - gone, replace=False), rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)]))
                common = len(np.intersect1d(x, y))
                if np.array_equal(x, y) or 100 * common < percent * (len(x) + len(y) - common):
                    continue
                made = [set(np.concatenate([jaccard.signatures(s, bands.band(len(s)) + k, bands) for k in (0, 1)]).tolist()) for s in (x, y)]
                assert made[0] & made[1]
                bits = np.stack([jaccard.sketch(s) for s in (x, y)])
                pieces = sum(((int(a) ^ int(b)) >> (4 * k)) & 15 > 0 for a, b in bits.T for k in range(16))
                assert pieces <= len(x) + len(y) - 2 * common
                assert jaccard.pieces_differing(jaccard.fine_sketch(x), jaccard.fine_sketch(y)) <= len(x) + len(y) - 2 * common


def test_odd_tables_of_the_join(spark):
    d = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "A b c")], "doc_id long, text string")
    made = sorted(((r.doc_id, r.component_id) for r in jaccard.near_duplicates(d).collect()), key=str)
    assert made == [(5, 5), (5, 5), (7, 5), (None, None)]
    assert jaccard.near_duplicates(d.limit(0)).count() == 0
    assert jaccard.keep_one(d).count() == 2


def test_repeats_meet_brute_force(spark):
    width, owner = 13, {}
    words = [WORD.findall(t or "") for t in TEXTS]
    for i, w in enumerate(words):
        for k in range(len(w) - width + 1):
            owner.setdefault(tuple(w[k : k + width]), i)
    made = {r.doc_id: r for r in phrases.drop_repeats(docs(spark)).collect()}
    for i, w in enumerate(words):
        gone = {k + j for k in range(len(w) - width + 1) if owner[tuple(w[k : k + width])] < i for j in range(width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (made[i].n_words, made[i].n_removed, made[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert phrases.drop_repeats(docs(spark).limit(0)).count() == 0


def test_repeats_inside_one_document_stay(spark):
    t = " ".join(BASE[:20])
    d = spark.createDataFrame([(1, f"{t} x {t}"), (1, t), (None, t), (3, f"y {t}")], "doc_id long, text string")
    made = sorted((str(r.doc_id), r.n_removed) for r in phrases.drop_repeats(d).collect())
    assert made == [("1", 0), ("1", 0), ("3", 20), ("None", 0)]


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = [x or "" for x in TEXTS] + ["a<|endoftext|>. B.", "X.,. y!? Hello's. don't. İI. Å.", "​x. .y .", "12.5 <|ENDOFTEXT|> a."]
    for made, x in zip(packing.token_bytes(texts, TOKENIZER), texts, strict=True):
        assert np.frombuffer(made, "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_pieces_are_whole_and_gapless(spark):
    d = docs(spark).unionByName(docs(spark).where("doc_id < 3"))
    made = packing.pack(d, TOKENIZER, capacity=64).collect()
    of = Counter()
    bins: dict[int, list] = {}
    for r in made:
        of[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ids = dict(zip(range(len(TEXTS)), packing.token_bytes([x or "" for x in TEXTS], TOKENIZER), strict=True))
    assert all(of[i] == len(ids[i]) // 4 * (2 if i < 3 else 1) for i in ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) for r in made)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    halves = sum(2 * r.length > 64 for r in made)  # no two of them share a sequence
    assert len(bins) <= max(math.ceil(sum(of.values()) / 64), halves) + 2
    assert packing.pack(d.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("capacity", [10, 33, 4096])
def test_plan_is_near_the_bound(capacity):
    r = random.Random(capacity)
    lengths = [r.choice([r.randint(1, capacity), max(1, int(r.gammavariate(1, capacity / 6)) % capacity)]) for _ in range(3000)]
    placed: dict[int, int] = {}
    for length, _, pieces, per, first, offset in packing.plan(dict(Counter(lengths)), capacity):
        for k in range(pieces):
            placed[first + k // per] = max(placed.get(first + k // per, 0), offset + (k % per + 1) * length)
    assert max(placed.values()) <= capacity and sum(lengths) <= capacity * len(placed)
    assert len(placed) <= max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths)) * 1.01 + 2


def test_media_payload_is_padded_up_to_a_multiple(spark):
    texts = ["", "a" * 63, "a" * 64, "é" * 64, "a" * 65]
    made = {x.doc_id: x for x in media.round_trip(docs(spark, texts)).collect()}
    assert [made[i].payload_bytes for i in range(5)] == [64, 64, 64, 128, 128]
    assert made[2].payload_sha256 == hashlib.sha256(b"a" * 64).hexdigest() and made[2].tail_crc32 == zlib.crc32(b"a" * 64)
    assert made[3].payload_sha256 == hashlib.sha256(("é" * 64).encode()).hexdigest()


def test_media_round_trip_and_clips(spark):
    r = random.Random(2)
    for payload in (b"\x00" * 64, bytes(r.randrange(256) for _ in range(9000)), b"\xff" * 4000):
        back, counts, found = media.examine(media.write_avi(payload))
        assert back == payload and found[0][0] == 0 and found[-1][1] == len(counts)
    made = {x.doc_id: x for x in media.round_trip(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b"\x00" * (64 - len(raw) % 64)
        assert (made[i].n_bytes, made[i].payload_bytes, made[i].payload_sha256, made[i].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert made[24].media_sha256 == made[25].media_sha256 and made[24].feature == made[25].feature
    stored = media.store(docs(spark)).unionByName(spark.createDataFrame([(99, b"no"), (98, None)], "doc_id long, media binary"))
    rows = media.clips(stored).collect()
    assert {x.doc_id for x in rows if x.error} == {98, 99} and {x.doc_id for x in rows} == {*range(len(TEXTS)), 98, 99}
    assert media.round_trip(docs(spark).limit(0)).count() == 0


def test_a_cut_is_found():
    black, bright = b"\xff" * (10 * media.FRAME_BYTES), b"\x80\xff" * (5 * media.FRAME_BYTES)
    _, counts, found = media.examine(media.write_avi(black + bright))
    assert len(counts) == 20 and found == [(0, 10), (10, 20)]


def test_languages_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    made = langid.identify(d, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(d.select("doc_id", "lang"), "doc_id")
    right = made.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "the cat", None), (4, "", "de")], "doc_id long, text string, lang string")
    made = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, F.lit(False)).collect()}
    assert made[1] == made[2] == made[4] == ("und", 0.0) and made[3][0] in ("en", "de")
    assert langid.identify(odd.limit(0), F.lit(False)).count() == 0


def test_model_beats_its_base_and_sums_to_one(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = lm.score(d, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).toPandas()
    rows = {r.doc_id: WORD.findall(lower(r.text)) + [None] for r in d.collect()}
    train = Counter(w for i, ws in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, different = sum(train.values()), len(train)
    for r in made.itertuples():
        base = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (different + 1))) for w in rows[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_tokens == len(rows[r.doc_id]) and r.train_tokens == total
        assert r.n_known == sum(train[w] > 0 for w in rows[r.doc_id])
    held = made[made.held_out]
    assert held.score.sum() > held.base_score.sum()
    mass = np.random.default_rng(1).random(lm.CLASSES) + 0.1
    model = lm.Model(mass)
    u, v = np.full(lm.CLASSES, 5), np.full(lm.CLASSES, 9)
    assert np.exp(model.log_probability(u, v, np.arange(lm.CLASSES), model.normalisers())).sum() == pytest.approx(1, abs=1e-4)


def test_scores_of_odd_tables(spark):
    d = spark.createDataFrame([(0, None), (1, ""), (None, "a a"), (2, "a b")], "doc_id long, text string")
    made = {r.doc_id: r for r in lm.score(d, F.col("doc_id") == 1).collect()}
    assert made[0].n_tokens == 1 and made[1].held_out and made[None].n_tokens == 3 and not made[None].held_out
    assert all(math.isfinite(r.score) for r in made.values())
    assert lm.score(d.limit(0), F.lit(False)).count() == 0


def test_rounds_together_train_on_every_place():
    none = np.empty(0, np.int64)
    known = lm.Vocabulary(none.astype(np.uint64), none.astype(np.uint64), none, none, 0, 0, 0, np.ones(lm.CLASSES))
    texts = [t or "" for t in TEXTS]
    seen = Counter()
    for turn in range(lm.ROUNDS):
        for cut in (texts[: 5 + turn], texts[5 + turn :]):  # each round cuts its batches elsewhere
            for places in lm._places(pa.RecordBatch.from_arrays([pa.array(cut)], names=["text"]), known, turn):
                seen.update(zip(*(x.tolist() for x in places), strict=True))
    every = Counter()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        words = tokens.Words(data, np.array([0, len(data)]), lower=True)
        classes = [*known.look_up(words)[1].tolist(), lm.END]
        padded = [lm.END, lm.END, *classes]
        every.update((padded[i + 1], padded[i], c) for i, c in enumerate(classes))
    assert seen == every


def thue_morse():
    """Two different words that a polynomial hash modulo 2**64 can't tell apart."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_made_to_collide_are_told_apart(spark):
    a, b = thue_morse()
    lead = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in phrases.drop_repeats(d).collect()} == {1: 0, 2: 0}
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(d).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.n_known for r in lm.score(d, F.col("doc_id") == 2).collect()} == {1: 2, 2: 1}


def test_links_are_decided_by_words():
    texts = ["a b c d e f g h i j", "a b c d e f g h i J", "a b", "A b", "a b", "a c", "", "", "a b c", "a b", "x y z", "x y z w"]
    assert jaccard.similar(pa.array(texts), 3, 90).tolist() == [True, True, False, False, False, False]
    assert jaccard.similar(pa.array(texts), 3, 50).tolist() == [True, True, False, False, False, True]


def test_passages_go_where_the_automaton_finds_them():
    """The names only choose passages: a shard's result is what its automaton finds in whole texts."""
    held = " ".join(BASE[:30])
    texts = pa.table({"id": pa.array([5, 6, 7], pa.int64()), "doc": pa.array([50, 10, 70], pa.int64()), "text": [f"x {held} y", f"{held} z", " ".join(BASE[:12])]})
    told = pa.table({"first": pa.array([10], pa.int64()), "passage": pa.array([" ".join(BASE[:20]).encode()])})
    assert phrases._locate(texts, told, 13).column("n_removed").to_pylist() == [20, 0, 0]
    assert phrases._locate(texts, told.slice(0, 0), 13).column("n_removed").to_pylist() == [0, 0, 0]
    shard, read, _ = phrases.compile_shard([" ".join(BASE[:20]).encode()], [10], pa.array([f"x {held} y"]), 13)
    assert len(shard) == 8 and len(list(shard.iter(read[0]))) == 8


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Only the table of texts is made by a shuffle of text: what reads it later plans no exchange of its rows."""
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(phrases, "table", lambda df, name, made=phrases.table: plans.setdefault(name, plan(df)) and made(df, name))
    monkeypatch.setattr(phrases, "bucketed", lambda df, name, key, n, made=phrases.bucketed: plans.setdefault(name, plan(df)) and made(df, name, key, n))
    made = {r.doc_id: r.n_removed for r in phrases.drop_repeats(docs(spark)).collect()}
    assert made and sum(made.values())
    carried = {name: [line for line in p.splitlines() if re.search(r"Scan parquet.*\btext#", line)] for name, p in plans.items()}
    for name in ("found", "passages", "located"):
        lines = plans[name].splitlines()
        scan = next(k for k, line in enumerate(lines) if re.search(r"Scan parquet.*\btext#", line))
        depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
        above = []
        for line in reversed(lines[:scan]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                above.append(line)
                depth = at
            if "CoGroups" in line:
                break
        assert not any("Exchange" in line for line in above), (name, plans[name])
    assert len(carried["found"]) == 1


def test_clashing_columns_and_long_texts_are_ignored(spark):
    long = " ".join(f"v{i * i % 7919}" for i in range(60_000))
    own = docs(spark, [*TEXTS[:6], long, long + " end", None]).withColumn("lang", F.lit("en"))
    odd = own.select("doc_id", "text", "lang", *(F.lit("x").alias(c) for c in ("t1", "t2", "anchors", "id", "h", "g", "n", "row", "bucket", "rank", "shard", "key", "media", "held_out", "score")))
    for make in (
        jaccard.near_duplicates,
        phrases.drop_repeats,
        media.round_trip,
        lambda d: packing.pack(d, TOKENIZER).drop("sequence_id", "offset"),
        lambda d: langid.identify(d, F.lit(False)),
        lambda d: lm.score(d, F.lit(False)).drop("score"),
    ):
        assert sorted(map(str, make(odd).collect())) == sorted(map(str, make(own).collect()))
    assert {r.doc_id: r.n_removed for r in phrases.drop_repeats(own).collect()}[7] == 60_000


def test_first_of_repeated_ids_stays(spark):
    d = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (5, "q r s t"), (7, "A b c"), (8, ""), (8, None), (None, "a b c")], "doc_id long, text string")
    made = sorted((str(r.doc_id), r.text or "") for r in jaccard.keep_one(d).collect())
    assert made == [("5", "a b c"), ("5", "q r s t"), ("8", ""), ("None", "a b c")]


def test_many_languages_are_all_learned(spark):
    words = {k: [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{x}" for x in ("ga", "lo", "mi")] for k in range(130)}
    rows = [(100 * k + i, " ".join(words[k][(i + j) % 3] for j in range(12)), f"l{k:03}") for k in words for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    made = langid.identify(d, F.lit(False)).join(d, "doc_id").where("lang = lang_pred")
    assert made.select("lang").distinct().count() == 130


def slow_groups(means):
    groups = [[i] for i in range(len(means))]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        close = [np.mean([means[x] @ means[y] for x in groups[i] for y in groups[j]]) for i, j in pairs]
        i, j = pairs[int(np.argmax(close))]
        groups[i] += groups.pop(j)
    return groups


def test_families_and_decisions_meet_a_slow_version():
    rng = np.random.default_rng(5)
    x = rng.random((90, langid.WIDTH)).astype(np.float32)
    labels = np.array([f"l{i % 9}" for i in range(90)], object)
    for i in range(90):
        x[i, (i % 9) * 20 : (i % 9) * 20 + 20] += 2
        x[i, 500 + (i % 9) // 3 * 50 : 550 + (i % 9) // 3 * 50] += 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Model(x, labels)
    means = np.stack([x[labels == n].mean(axis=0) for n in model.names])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    assert model.groups == slow_groups(means) and sorted(map(len, model.groups)) == [3, 3, 3]
    best, score = model.predict(x)
    for i in range(90):
        margins = [float(x[i] @ w[:-1] + w[-1]) for w in model.family]
        group = model.groups[int(np.argmax(margins))]
        votes = {a: 0 for a in group}
        for (a, b), w in model.pair.items():
            if a in group:
                votes[a if x[i] @ w[:-1] + w[-1] > 0 else b] += 1
        assert votes[best[i]] == max(votes.values()) and 0 <= score[i] <= 1
    assert (np.array(model.names, object)[best] == labels).all()


def test_frequent_words_have_a_bound(spark):
    counts = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % 2**64 - 2**63, i, 0, 1 if i % 2 else 9) for i in range(1000)], "h long, g long, bucket int, n long")
    assert lm.frequent(counts, 10_000).count() == 1000
    made = [r.n for r in lm.frequent(counts, 600).collect()]
    assert made.count(9) == 500 and 0 < made.count(1) < 250
    one_level = lm.frequent(counts.where("n = 1"), 100).count()
    assert 0 < one_level < 250
    known = lm.vocabulary(counts, 3, 0)
    assert len(known.hashes) == 0 and known.total == 5003 and known.different == 1001


def test_any_baseline_jpeg_is_decoded():
    rng = np.random.default_rng(1)
    for payload in (b"\x00" * 64, rng.integers(0, 256, 3000, np.uint8).tobytes()):
        for frame in media.encode_frames(payload):
            held = media.decode_frame(frame)
            made = media.read_jpeg(frame)
            blocks = made[1].reshape(-1, 64)
            value = held.astype(int)
            assert (blocks[:, 1:] == np.where(value < 128, value - 255, value)).all() and not blocks[:, 0].any()
            own = media.pixels(held).reshape(4, 4, 8, 8).swapaxes(1, 2).reshape(32, 32).astype(int)
            assert np.abs(made[0].astype(int) - own).max() <= 4  # the array path rounds its waves to whole numbers


def bits(*pairs):
    line = "".join(f"{v:0{n}b}" for v, n in pairs)
    line += "1" * (-len(line) % 8)
    return int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_colour_with_standard_tables_and_restarts():
    """Flat 16 x 16 colour units, 2 x 2 sampled luma, standard tables left out: DC 1 of category 1 is code 010, end 1010."""
    luma, flat = [(0b010, 3), (1, 1), (0b1010, 4)], [(0b00, 2), (0b1010, 4)]
    chroma = [(0b00, 2), (0b00, 2)]
    unit = bits(*luma, *flat * 3, *chroma * 2)
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([16] * 64)) + media._segment(0xDB, bytes([1]) + bytes([16] * 64))
    head += media._segment(0xC0, bytes([8, 0, 16, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])) + media._segment(0xDD, b"\x00\x01")
    head += media._segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    frame = head + unit + b"\xff\xd0" + unit + b"\xff\xd9"
    made = media.read_jpeg(frame)
    assert made[0].shape == (16, 30) and (made[0] == 130).all() and made[2].shape == (1, 2, 64)
    with pytest.raises(ValueError):
        media.read_jpeg(frame[:-6])
    with pytest.raises(ValueError):
        media.read_jpeg(frame.replace(b"\xff\xc0", b"\xff\xc2"))


def test_bits_of_a_long_scan_are_read_in_a_time_that_grows_with_it():
    from placeframe.llm.media import Scan

    rng = random.Random(4)
    data = rng.randbytes(400_000)
    scan, whole, at = Scan(data), "".join(f"{b:08b}" for b in data), 0
    begun = time.process_time()
    while at + 16 <= len(whole):
        n = rng.randint(0, 16)
        assert scan.take(n) == int(whole[at : at + n] or "0", 2)
        at += n
    assert time.process_time() - begun < 20
    with pytest.raises(ValueError):
        scan.take(17)


def test_chunks_encoded_together_have_their_own_ids():
    import public_tokenizers

    from placeframe.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, _ = packing._tokenizer(path)
    chunks = [c.encode() for c in ("don't", "é", "́", "a", "'", "s", "<|endoftext|>", "x<|", "|>", "'s", "12", "你好", "​", "<", "|endoftext|>", "\x00")]
    chunks += [f"w{i}".encode() for i in range(2500)]
    calls = []

    class Counted:
        get_added_tokens_decoder = staticmethod(tokenizer.get_added_tokens_decoder)

        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    made = dict(packing._encoded(chunks, Counted()))
    assert list(map(made.get, chunks)) == [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(c.decode(), add_special_tokens=False).ids) for c in chunks]
    assert sum(calls) < 10  # not an encoding for each chunk
