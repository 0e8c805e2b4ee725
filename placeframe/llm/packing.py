"""Best-fit packing of token pieces into sequences, planned on counts of lengths.

Only a piece's length decides where it can go, and there are at most `capacity` lengths. So the plan is made from the
number of pieces of each length, for all that are alike at once: pieces above a third of the capacity are matched, the
longest first, each with the longest that still fits (two at most in a sequence); then smaller ones, the longest first,
go where the gap is tightest. Every piece finds its place by its rank among those of its length. Nothing that grows with
the documents is in one task.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.llm.scratch import table

CAPACITY, END = 4096, 1
#: Pieces of one length that one task ranks, about.
BUCKET_ROWS = 50_000
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 600_000

# a mark after an ASCII letter and before white space is a token of its own either way
_MARK = re.compile(rb"(?<=[a-z])([.,!?;:])(?=[ \n])")
_workers: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _workers[path] = Tokenizer.from_file(path), {}
    return _workers[path]


def _encoded(chunks: list[bytes], tokenizer) -> Iterator[tuple[bytes, bytes]]:
    """Each chunk and its ids. Chunks are encoded together, with a special token between them, which cuts a text before
    anything else; those that may hold a special token, or all where there is none, apart."""
    marks = [(i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
    marks = [(i, c) for i, c in marks if c.startswith("<|")]
    apart = [c for c in chunks if b"<|" in c or not marks]
    for at in range(0, len(apart), 4000):  # an encoding holds far more than its ids
        some = apart[at : at + 4000]
        for c, e in zip(some, tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False), strict=True):
            yield c, np.array(e.ids, "<u4").tobytes()
    if marks:
        mark, between = marks[0]
        chunks = [c for c in chunks if b"<|" not in c] if apart else chunks
        for at in range(0, len(chunks), 1000):
            some = chunks[at : at + 1000]
            ids = np.array(tokenizer.encode_batch_fast([between.encode().join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts, held = (4 * np.flatnonzero(ids == mark)).tolist(), ids.tobytes()
            for c, a, b in zip(some, [0, *(x + 4 for x in cuts)], [*cuts, len(held)], strict=True):
                yield c, held[a:b]


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text and the end id, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and lower-cases, so chunks between white space are encoded apart and each different
    chunk once; a text with a special token's opening keeps its case until the tokenizer has seen it.
    """
    tokenizer, known = _tokenizer(path)
    end = END.to_bytes(4, "little")
    for start in range(0, len(texts), 200):
        chunks = []
        for text in texts[start : start + 200]:
            raw = text.encode()
            chunks.append((raw if b"<|" in raw else _MARK.sub(rb" \1", raw.lower())).split())
        new = list(set().union(*chunks).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*chunks))
        known.update(_encoded(new, tokenizer))
        for cs in chunks:
            yield b"".join(map(known.__getitem__, cs)) + end


def _pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, ids in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).fill_null("").to_pylist(), path), strict=True):
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                held = ids[at : at + 4 * capacity]
                for x, v in zip(out, (doc, piece, at // 4, len(held) // 4, zlib.crc32(held)), strict=True):
                    x.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces in a sequence, first sequence, offset) rows that place all pieces.

    Rank r of a length, from the first rank on, goes to sequence first + (r - first rank) // per and stands
    ((r - first rank) % per) * length behind the offset.
    """
    left, ranks = dict(counts), dict.fromkeys(counts, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    sizes: list[int] = []  # the free sizes, sorted
    n = 0

    def put(length: int, pieces: int, per: int, first: int, offset: int) -> None:
        slots.append((length, ranks[length], pieces, per, first, offset))
        ranks[length] += pieces
        left[length] -= pieces

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, many))

    large = sorted(x for x in counts if 3 * x > capacity)
    for length in reversed(large):
        while left[length]:
            fits = bisect.bisect_right(large, capacity - length)
            mate = next((large[i] for i in range(fits - 1, -1, -1) if left[large[i]] > (large[i] == length)), None)
            if mate is None:
                many = left[length]
                put(length, many, 1, n, 0)
                free(capacity - length, n, many)
            elif mate == length:
                many = left[length] // 2
                put(length, 2 * many, 2, n, 0)
                free(capacity - 2 * length, n, many)
            else:
                many = min(left[length], left[mate])
                put(length, many, 1, n, 0)
                put(mate, many, 1, n, length)
                free(capacity - length - mate, n, many)
            n += many
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                per = capacity // length
                many = left[length] // per or 1
                free(capacity, n, many)
                n += many
                continue
            gap = sizes[i]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
            per = min(gap // length, left[length])
            used = min(many, left[length] // per)
            put(length, per * used, per, first, capacity - gap)
            free(gap - per * length, first, used)
            free(gap, first + used, many - used)
    return slots


def _place(batches: Iterable[pa.RecordBatch], slots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        length, rank = (t[x].to_numpy() for x in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            rows = np.flatnonzero(length == x)
            s = slots[int(x)]
            s = s[np.searchsorted(s[:, 0], rank[rows], "right") - 1]
            behind = rank[rows] - s[:, 0]
            sequence[rows], offset[rows] = s[:, 2] + behind // s[:, 1], s[:, 3] + behind % s[:, 1] * x
        t = t.drop(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from t.to_batches()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of docs(doc_id, text).

    A document is the ids of its text by the tokenizer file, without special tokens, and the end id 1; null text is
    empty, so its document is the end id alone. Only longer documents than `capacity` are cut; a very long one is held
    once as ids. Repeated rows and null doc_ids are packed as any other. Pieces of one length are alike: any of them
    may have any of their places. Other columns of docs, whatever their names, are ignored. An empty table gives an empty result.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_pieces, path=tokenizer, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    # numbered once, as written: equal rows are told apart, and those of a length fall in even buckets of BUCKET_ROWS
    pieces = table(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    most = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(-(-most // BUCKET_ROWS) or 1)))
    counts = table(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    # at most `capacity` rows
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list] = {}
    for length, *slot in plan(lengths, capacity):
        slots.setdefault(length, []).append([slot[0], slot[2], slot[3], slot[4]])
    inner = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = pieces.withColumn("inner", inner).join(counts.drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inner")).alias("rank"))
    held = {x: np.array(sorted(s), np.int64) for x, s in slots.items()}
    return ranked.mapInArrow(partial(_place, slots=held), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
