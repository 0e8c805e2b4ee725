"""Document fingerprints: SimHash of weighted words, and search within a Hamming radius by permuted block tables.

Each word's 128-bit name votes on each of the fingerprint's bits, with the word's weight: the rarer among all documents,
the more. Fingerprints within the radius agree in some choice of blocks: one table for each choice finds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm import tokens
from placeframe.llm.scratch import release, stored_bytes, table

BITS, BLOCKS = 128, 8
RADIUS = 6
#: Words share 2**16 counters of documents: the weights have this size whatever the vocabulary.
SLOT_BITS = 16
#: Words that vote at a time, and their largest weight: such sums are exact in float32.
CHUNK, LARGEST = 1 << 12, (1 << 12) - 1
#: Fingerprints of one bucket that one task compares at a time; larger buckets are dealt in pieces.
PIECE = 4096
#: A table up to this size, as written, is broadcast.
BROADCAST_BYTES = 8 << 20


def _slots(names: tokens.Lanes) -> np.ndarray:
    return (names[0] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _documents_by_slot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for _, _, data, at in tokens.parts(batch):
            words = tokens.Words(data, at, lower=True)
            pairs = np.unique((words.row << SLOT_BITS) + _slots(words.names()))
            n += np.bincount(pairs & (1 << SLOT_BITS) - 1, minlength=len(n))
    slots = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"slot": slots, "n": n[slots]})


def weights(docs: DataFrame) -> np.ndarray:
    """A weight of 1 to 255 for each counter of words: 1 + 12 ln(documents / documents with the word), from all texts."""
    got = docs.select("text").mapInArrow(_documents_by_slot, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    of = docs.count()
    n = np.ones(1 << SLOT_BITS)
    for r in got:
        n[r.slot] = r.n
    return np.clip(np.rint(1 + 12 * np.log(max(of, 1) / n)), 1, 255).astype(np.float32)


def fingerprints_of(texts: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of 64 bits for each text. A bit is 1 where the words whose names have it outweigh the others.

    A word votes once for each text, its weight times 1 + ln(times it stands there).
    """
    votes = np.zeros((len(texts), BITS), np.int64)
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for row, _, data, at in tokens.parts(batch):
        words = tokens.Words(data, at, lower=True)
        a, b = words.names()
        if not len(a):
            continue
        order = np.lexsort((b, a, words.row))
        a, b, of = a[order], b[order], words.row[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])])
        times = np.diff(np.r_[starts, len(a)])
        a, b, of = a[starts], b[starts], of[starts]
        w = np.minimum(np.rint(weight[_slots((a, b))] * (1 + np.log(times))), LARGEST).astype(np.float32)
        names = np.stack((tokens.mix(a), tokens.mix(b)), 1).view(np.uint8)  # the slot's bits are spread over all
        for i in range(0, len(a), CHUNK):
            rows, own = of[i : i + CHUNK], w[i : i + CHUNK]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            signed = np.unpackbits(names[i : i + CHUNK], axis=1).astype(np.float32)
            signed *= own[:, None]
            votes[row + rows[first]] += 2 * np.add.reduceat(signed, first).astype(np.int64) - np.add.reduceat(own, first).astype(np.int64)[:, None]
    bits = np.packbits(votes > 0, axis=1)
    lanes = np.ascontiguousarray(bits).view(">u8").astype(np.uint64)
    return lanes[:, 0], lanes[:, 1]


def _fingerprint(batches: Iterable[pa.RecordBatch], weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo = fingerprints_of(batch.column(1), weight)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["id", "hi", "lo"])


def fingerprint(docs: DataFrame, weight: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """id_column, hi, lo (long): the fingerprint's two halves for each row of docs.

    Words are runs without white space, A-Z in lower case. A text without words, or null, has all bits 0. Equal texts have equal
    fingerprints; so have repeated rows, each of which counts. A very long text votes in parts. No other column is read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    made = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_fingerprint, weight=weight), f"id {kind}, hi long, lo long")
    return made.withColumnRenamed("id", id_column)


def hexadecimal(hi: Column | str, lo: Column | str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """The share of bits that agree, 0 to 1."""
    return 1 - (F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))) / F.lit(float(BITS))


# --- search within a radius ---


def _choices(radius: int) -> list[tuple[int, ...]]:
    """The choices of blocks that agree: `radius` differing bits touch at most that many blocks."""
    if not 0 <= radius < BLOCKS - 1:
        raise ValueError(f"radius must be 0 to {BLOCKS - 2}")
    return list(combinations(range(BLOCKS), BLOCKS - radius))


def _block(i: int) -> Column:
    lane = F.col("hi") if i < BLOCKS // 2 else F.col("lo")
    return F.shiftrightunsigned(lane, 48 - 16 * (i % (BLOCKS // 2))).bitwiseAND(F.lit(0xFFFF))


def _entries(rows: DataFrame, radius: int) -> DataFrame:
    """A row of each table (t) for each row: `key` is a hash of the chosen blocks, by which alone nothing is decided."""
    keys = F.array(*(F.struct(F.lit(t).cast("byte").alias("t"), F.xxhash64(*(_block(i) for i in choice)).alias("key")) for t, choice in enumerate(_choices(radius))))
    return rows.select(F.explode(keys).alias("e"), *rows.columns).select("e.t", "e.key", *rows.columns)


def _first_table(radius: int) -> np.ndarray:
    """For each set of agreeing blocks (as bits) the first table that finds the pair; 255 for none."""
    choices = [sum(1 << i for i in c) for c in _choices(radius)]
    return np.array([next((t for t, c in enumerate(choices) if s & c == c), 255) for s in range(1 << BLOCKS)], np.uint8)


def _agreeing(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which blocks of two fingerprints, given by their differences, agree: bit i for block i."""
    out = np.zeros(hi.shape, np.uint8)
    for i in range(BLOCKS):
        lane = hi if i < BLOCKS // 2 else lo
        out |= ((lane >> np.uint64(48 - 16 * (i % (BLOCKS // 2))) & np.uint64(0xFFFF)) == 0).astype(np.uint8) << np.uint8(i)
    return out


def _near(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, the asking ones first. Counts for each asking fingerprint the documents near it; a pair that
    several tables find is counted in the first of them. Only a bucket piece's asking rows are held."""
    first_table = _first_table(radius)
    bucket, ask = None, np.empty((0, 2), np.uint64)
    for batch in batches:
        t, key, p, q = (np.asarray(batch.column(i)) for i in range(4))
        hi, lo = (np.asarray(batch.column(i)).view(np.uint64) for i in (4, 5))
        m, asks = np.asarray(batch.column(6)), np.asarray(batch.column(7))
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
        starts = np.r_[np.flatnonzero(new), len(t)]
        n_asks = np.add.reduceat(asks.astype(np.int64), starts[:-1])
        out = []
        for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            here = (t[s], key[s], p[s], q[s])
            if k or bucket != here:
                bucket, ask = here, np.empty((0, 2), np.uint64)
            if n_asks[k]:
                own = s + np.flatnonzero(asks[s:e])
                ask = np.concatenate((ask, np.stack((hi[own], lo[own]), 1)))
            held = s + np.flatnonzero(~asks[s:e])
            if not len(ask) or not len(held):
                continue
            for i in range(0, len(held), 512):
                at = held[i : i + 512]
                x, y = ask[:, :1] ^ hi[at], ask[:, 1:] ^ lo[at]
                near = (np.bitwise_count(x) + np.bitwise_count(y) <= radius) & ((x | y) != 0)
                r, c = np.nonzero(near)
                mine = first_table[_agreeing(x[r, c], y[r, c])] == t[s]
                if mine.any():
                    n = np.bincount(r[mine], m[at][c[mine]], len(ask)).astype(np.int64)
                    got = np.flatnonzero(n)
                    out.append((ask[got], n[got]))
        if out:
            found, n = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64)), pa.array(n)], names=["hi", "lo", "n"])


def near_counts(prints: DataFrame, asking: Column, radius: int = RADIUS) -> DataFrame:
    """hi, lo, n_near (long): for each fingerprint with an asking row, how many rows have a fingerprint within `radius`
    differing bits, those with the same one included (itself too, so at least 1).

    prints: hi, lo for each document, and what `asking` reads; null counts as not asking. Equal fingerprints are one with
    a count. In each of the tables (28 for a radius of 6 in 8 blocks) askers meet the others of their bucket; a bucket
    of more than PIECE fingerprints is dealt in pieces, askers and others, and each piece meets each. Exact: no
    bucket is cut, and hashes of blocks choose buckets only. An empty table gives an empty result.
    """
    same = table(prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("m"), F.max(F.coalesce(asking, F.lit(False))).alias("asks")), "prints")
    entries = _entries(same, radius)
    # only buckets with an asker and someone else do any work
    sizes = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("k"))
    large = table(sizes.where((F.col("n") > PIECE) & (F.col("k") > 0)).select("t", "key", F.ceil(F.col("n") / PIECE).cast("int").alias("ps"), F.ceil(F.col("k") / PIECE).cast("int").alias("qs")), "large")
    sides = entries.withColumn("asks", F.explode(F.when(F.col("asks"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    hint = F.broadcast if stored_bytes(large) <= BROADCAST_BYTES else lambda x: x
    dealt = sides.join(hint(large), ["t", "key"], "left")
    ps, qs, place = F.coalesce("ps", F.lit(1)), F.coalesce("qs", F.lit(1)), F.xxhash64(F.lit(1), "hi", "lo")
    own = F.pmod(place, F.when(F.col("asks"), qs).otherwise(ps)).cast("int")
    dealt = dealt.select("t", "key", "hi", "lo", "m", "asks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), ps).otherwise(qs) - 1)).alias("other"))
    p, q = F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    dealt = dealt.select("t", "key", p.alias("p"), q.alias("q"), "hi", "lo", "m", "asks").repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", F.desc("asks"))
    found = dealt.mapInArrow(partial(_near, radius=radius), "hi long, lo long, n long")
    asked = same.where("asks").select("hi", "lo", F.col("m").alias("n"))
    out = table(asked.unionByName(found).groupBy("hi", "lo").agg(F.sum("n").alias("n_near")), "near")
    release(same, large)
    return out


# --- each document against its edited text and its successor ---

_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n_chars", T.LongType()),
    T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("edited_hi", T.LongType()), T.StructField("edited_lo", T.LongType()), T.StructField("next_hi", T.LongType()), T.StructField("next_lo", T.LongType()),
    T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
])


def half_replaced(text: str, successor: str) -> str:
    """text, its last half of code points (rounded down) replaced by the successor's first as many, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def _edits(texts: list[str], after: list[str], weight: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    edited = [half_replaced(t, s) for t, s in zip(texts, after, strict=True)]
    hi, lo = fingerprints_of(pa.array(edited, pa.large_string()), weight)
    return [hashlib.sha256(x.encode()).hexdigest() for x in edited], hi.view(np.int64), lo.view(np.int64)


def _in_order(batches: Iterable[pa.RecordBatch], weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in order; each is edited by the next. A part's last row waits for the next part: it carries its text as
    `tail`, and a part's first row as `head`. One text is held from batch to batch."""
    part = TaskContext.get().partitionId()
    held, begun = None, False

    def rows(ids, texts, hi, lo, after, after_hi, after_lo, last: bool) -> pa.RecordBatch:
        nonlocal begun
        n = len(ids)
        sha, ehi, elo = ([None] * n, [None] * n, [None] * n) if last else _edits(texts, after, weight)
        head = [None] * n
        if not begun:
            head[0], begun = texts[0], True
        arrays = [ids, [part] * n, [len(t) for t in texts], hi, lo, sha, ehi, elo, [None] * n if last else after_hi, [None] * n if last else after_lo, head, texts if last else [None] * n]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, kinds, strict=True)], names=_SCHEMA.names)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1).fill_null("")
        hi, lo = (x.view(np.int64) for x in fingerprints_of(texts, weight))
        ids, texts = batch.column(0).to_pylist(), texts.to_pylist()
        if held:
            ids, texts, hi, lo = [held[0], *ids], [held[1], *texts], np.r_[held[2], hi], np.r_[held[3], lo]
        if len(ids) > 1:
            yield rows(ids[:-1], texts[:-1], hi[:-1], lo[:-1], texts[1:], hi[1:], lo[1:], False)
        held = (ids[-1], texts[-1], hi[-1], lo[-1])
    if held:
        yield rows([held[0]], [held[1]], [held[2]], [held[3]], None, None, None, True)


def _across(batches: Iterable[pa.RecordBatch], weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _SCHEMA that carry both texts: the parts' last rows, each with the head of the next part."""
    for batch in batches:
        cols = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        sha, hi, lo = _edits(cols["tail"].to_pylist(), cols["head"].to_pylist(), weight)
        cols |= {"edited_sha256": pa.array(sha, pa.string()), "edited_hi": pa.array(hi), "edited_lo": pa.array(lo)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def against_edits(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """id, n_chars, hi, lo, edited_sha256, edited_hi, edited_lo, next_hi, next_lo for each document.

    A document's successor is the one of the next smaller doc_id, the last one's the first. Rows of one doc_id follow each
    other by a hash of their texts, rows without doc_id come last; null text is empty. A single document follows itself.

    One shuffle of the texts, by ranges of doc_id. The first and the last text of each range are kept beside the
    fingerprints, to be joined with each other; the driver gets the ranges' numbers only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = table(placed.mapInArrow(partial(_in_order, weight=weight), _SCHEMA), "edits")
    parts = sorted(r.part for r in made.where("tail IS NOT NULL").select("part").collect())
    plain = [c for c in _SCHEMA.names if c not in ("part", "head", "tail")]
    if not parts:
        return made.select(*plain)
    follows = made.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, follower int")
    heads = made.where("head IS NOT NULL").select(F.col("part").alias("follower"), F.col("hi").alias("follower_hi"), F.col("lo").alias("follower_lo"), F.col("head").alias("follower_head"))
    met = made.where("tail IS NOT NULL").join(follows, "part").join(heads, "follower").select(
        "id", "part", "n_chars", "hi", "lo", "edited_sha256", "edited_hi", "edited_lo",
        F.col("follower_hi").alias("next_hi"), F.col("follower_lo").alias("next_lo"), F.col("follower_head").alias("head"), "tail",
    )
    return made.where("tail IS NULL").select(*plain).unionByName(met.mapInArrow(partial(_across, weight=weight), _SCHEMA).select(*plain))
