"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and located.

1. Equal texts are one text; its first document stands for it, the others are copies, wholly repeated.
2. Each window of `width` words has an anchor: the smallest hash of its ANCHOR-word runs. Equal windows have equal
   anchors, and neighbours mostly share one, so a fifth as many anchors as windows are counted. An anchor in one text only
   rules its windows out.
3. The other windows are confirmed by one shuffle of their 128-bit names, which finds for each later text an earlier
   owner of the window. The owner cuts the confirmed passages out of its text, as words.
4. Texts are dealt to shards of about SHARD_BYTES, by one shuffle, and kept in buckets of whole shards; each step reads
   its shards there and only what it is told about them is shuffled. A shard's passages, as far as some of its texts may hold them, are
   compiled into one automaton of words, and all its texts, whole, are streamed through it. A passage is found where
   its words stand, whatever the names say: no name decides that a word goes.

Keys that one batch holds several times are settled before the shuffle, so a hot passage sends one row a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.llm import tokens
from placeframe.llm.meeting import shared_keys
from placeframe.llm.scratch import bucketed, release, table

WIDTH, ANCHOR = 13, 5
#: Text of a shard, in bytes; a longer text is a shard's whole. Its automaton takes some ten times as much.
SHARD_BYTES = 1 << 20
#: Shards are so small that their texts have at most so many times SHARD_BYTES with all copies, on average.
COPIES = 16
#: Text of a bucket of shards, in bytes.
BUCKET_BYTES = 16 << 20

_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("anchor", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("owner", pa.int64())])
_FOUND = pa.schema([("id", pa.int64()), ("anchor", pa.int64()), ("owner", pa.int64()), ("w1", pa.int64())])
_PASSAGES = pa.schema([("anchor", pa.int64()), ("owner", pa.int64()), ("first", pa.int64()), ("passage", pa.binary())])
_TEXTS = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("t", pa.binary()), ("text", pa.string())])
_LOCATED = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class Windows:
    """Row, first word, names and anchor of each window of a part."""

    def __init__(self, words: tokens.Words, width: int):
        names = words.names()
        w1, w2 = tokens.sequences(names, width)
        inside = words.row[: len(w1)] == words.row[width - 1 :] if len(w1) else np.empty(0, bool)
        runs = tokens.sequences(names, ANCHOR)[0]
        anchors = runs[: len(w1)].copy()
        for i in range(1, width - ANCHOR + 1):
            np.minimum(anchors, runs[i : i + len(w1)], out=anchors)
        self.first = np.flatnonzero(inside)
        self.row, self.w1, self.w2, self.anchor = words.row[: len(w1)][inside], w1[inside], w2[inside], anchors[inside]


def _firsts(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A shard's texts, each from one row of its first document; an id is the shard's number and one in it."""
    own = set(zip(known.column("doc").to_pylist(), known.column("t").to_pylist(), strict=True))
    at = []
    for k, row in enumerate(zip(rows.column("doc").to_pylist(), rows.column("t").to_pylist(), strict=True)):
        if row in own:
            own.remove(row)
            at.append(k)
    met = rows.take(pa.array(at, pa.int64()))
    shard = met.column("shard").to_numpy()
    columns = pa.array(shard), pa.array((shard << 32) + np.arange(len(at))), *(met.column(c) for c in ("doc", "t", "text"))
    return pa.Table.from_arrays([*columns], names=_TEXTS.names).cast(_TEXTS)


def _told(texts: pa.Table, told: pa.Table, column: str) -> list[pa.RecordBatch]:
    """The shard's texts that something is told of (id, column), with it."""
    if not len(told):
        return []
    ids = texts.column("id").to_numpy()
    order = np.argsort(ids)
    at = order[np.searchsorted(ids[order], told.column("id").to_numpy())]
    return texts.take(pa.array(at)).append_column(column, told.column(column)).combine_chunks().to_batches()


def _anchors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
    for row, end, data, at in tokens.parts(batch):
        w = Windows(tokens.Words(data, at, lower=False), width)
        cuts = np.searchsorted(w.row, np.arange(end - row + 1))
        for i in range(end - row):
            x = np.sort(w.anchor[cuts[i] : cuts[i + 1]])
            if len(x):
                yield ids[row + i], x[np.r_[True, x[1:] != x[:-1]]]


def _candidates(texts: pa.Table, hits: pa.Table, width: int) -> pa.Table:
    """Windows of a shard whose anchor is shared, once for each text. Of those that several of its texts hold, the first
    document's goes on; the others have it for an owner by now."""
    return pa.Table.from_batches(_windows(_told(texts, hits, "anchors"), width), _WINDOWS)


def _windows(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        ids, docs = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "doc"))
        anchors = batch.column(batch.schema.get_field_index("anchors"))
        for row, end, data, at in tokens.parts(batch):
            w = Windows(tokens.Words(data, at, lower=False), width)
            cuts = np.searchsorted(w.row, np.arange(end - row + 1))
            keep = np.zeros(len(w.row), bool)
            for i in range(end - row):
                shared = np.asarray(anchors[row + i].values).view(np.uint64)
                keep[cuts[i] : cuts[i + 1]] = np.isin(w.anchor[cuts[i] : cuts[i + 1]], shared)
            held.append((w.w1[keep], w.w2[keep], w.anchor[keep], ids[row + w.row[keep]], docs[row + w.row[keep]]))
        w1, w2, anchor, text, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((text, doc, w2, w1))
        w1, w2, anchor, text, doc = (x[order] for x in (w1, w2, anchor, text, doc))
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(w1)), 0))
        later = doc > doc[lead]
        yield from tokens.rows_of([{"w1": w1[new], "w2": w2[new], "anchor": anchor[new], "id": text[new], "doc": doc[new], "owner": pa.nulls(int(new.sum()), pa.int64())}], _WINDOWS)
        if later.any():
            yield from tokens.rows_of([{"w1": w1[later], "w2": w2[later], "anchor": anchor[later], "id": text[later], "doc": doc[later], "owner": text[lead][later]}], _WINDOWS)


def _owned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of window and document: text, anchor, an earlier text with the window (owner), and w1."""
    last = None  # name, document and text of the first row of the window before
    for batch in batches:
        w1, w2, anchor, text, doc = (batch.column(i).to_numpy() for i in range(5))
        owner = batch.column(5)
        told = np.asarray(owner.is_valid())
        known = owner.fill_null(-1).to_numpy()
        out = [{"id": text[told], "anchor": anchor[told], "owner": known[told], "w1": w1[told]}]
        w1, w2, anchor, text, doc = (x[~told] for x in (w1, w2, anchor, text, doc))
        if len(w1):
            new = np.ones(len(w1), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(w1)), 0))
            first_doc, first_text = doc[lead], text[lead]
            if last is not None and (w1[0], w2[0]) == last[:2]:
                first_doc, first_text = np.where(lead == 0, last[2], first_doc), np.where(lead == 0, last[3], first_text)
            later = doc > first_doc
            out.append({"id": text[later], "anchor": anchor[later], "owner": first_text[later], "w1": w1[later]})
            last = (w1[-1], w2[-1], first_doc[-1], first_text[-1])
        yield from tokens.rows_of(out, _FOUND)


def _passages(texts: pa.Table, names: pa.Table, width: int) -> pa.Table:
    """The words of each run of an owner's confirmed windows (names) that have one anchor."""
    return pa.Table.from_batches(_cut(_told(texts, names, "names"), width), _PASSAGES)


def _cut(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, docs = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "doc"))
        names = batch.column(batch.schema.get_field_index("names"))
        anchor, owner, first, passage = [], [], [], []
        for row, end, data, at in tokens.parts(batch):
            words = tokens.Words(data, at, lower=False)
            w = Windows(words, width)
            cuts = np.searchsorted(w.row, np.arange(end - row + 1))
            for i in range(end - row):
                span = slice(cuts[i], cuts[i + 1])
                k = np.flatnonzero(np.isin(w.w1[span], np.asarray(names[row + i].values).view(np.uint64))) + cuts[i]
                if not len(k):
                    continue
                new = np.r_[True, (np.diff(k) > 1) | (w.anchor[k[1:]] != w.anchor[k[:-1]])]
                begins, ends = k[new], k[np.r_[new[1:], True]]
                for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                    passage.append(data[words.starts[w.first[b]] : words.ends[w.first[e] + width - 1]].tobytes())
                anchor.append(w.anchor[begins].view(np.int64))
                owner.append(np.full(len(begins), ids[row + i]))
                first.append(np.full(len(begins), docs[row + i]))
        if passage:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (anchor, owner, first)), pa.array(passage, pa.binary())], schema=_PASSAGES)


def _spelled(codes: np.ndarray, most: int) -> tuple[str, int]:
    """Two letters for each word's number, the first ones and the second ones of different alphabets: an automaton's
    node then has few branches, and no match begins inside a word. Number 0 stands for all words of no passage."""
    root = int(most**0.5) + 1
    letters = np.empty(2 * len(codes), "<u4")
    letters[::2], letters[1::2] = 0x1000 + codes // root, 0x1000 + root + codes % root
    return letters.tobytes().decode("utf-32-le"), root


def compile_shard(passages: list[bytes], documents: list[int], texts: pa.Array, width: int) -> tuple[ahocorasick.Automaton | None, list[str], list[list[bytes]]]:
    """The automaton of all windows of the passages, each with the smallest document that is told for it, and the texts
    as it reads them, and their words."""
    held = [p.split() for p in passages]
    number: dict[bytes, int] = {}
    for words in held:
        for x in words:
            number.setdefault(x, len(number) + 1)
    split = [t.encode().split() for t in texts.to_pylist()]
    read = [_spelled(np.fromiter((number.get(x, 0) for x in words), np.int64, len(words)), len(number) + 1)[0] for words in split]
    if not held:
        return None, read, split
    shard = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k in sorted(range(len(held)), key=lambda k: -documents[k]):  # the smallest document is told last and stays
        line = _spelled(np.array([number[x] for x in held[k]], np.int64), len(number) + 1)[0]
        for i in range(0, len(line) - 2 * width + 2, 2):
            shard.add_word(line[i : i + 2 * width], documents[k])
    shard.make_automaton()
    return shard, read, split


def _locate(texts: pa.Table, passages: pa.Table, width: int) -> pa.Table:
    """Words of a shard's texts covered by a passage's window that an earlier document has, as its automaton finds them."""
    docs = texts.column("doc").to_pylist()
    told = passages.column("first").to_pylist()
    shard, read, split = compile_shard(passages.column("passage").to_pylist(), told, texts.column("text").combine_chunks(), width)
    removed, sha = [], []
    for doc, line, words in zip(docs, read, split, strict=True):
        ends = [e for e, owner in shard.iter(line) if owner < doc] if shard else []
        if ends:
            last = np.array(ends) // 2
            edges = np.bincount(last - width + 1, minlength=len(words) + 1) - np.bincount(last + 1, minlength=len(words) + 1)
            kept = np.cumsum(edges[:-1]) == 0
            removed.append(len(words) - int(kept.sum()))
            words = compress(words, kept.tolist())
        else:
            removed.append(0)
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.Table.from_arrays([texts.column("id").combine_chunks(), pa.array([len(w) for w in split], pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], schema=_LOCATED)


def _judged(texts: pa.Table, passages: pa.Table, width: int) -> pa.Table:
    """_locate() by the texts' digests and first documents."""
    located = _locate(texts, passages, width)
    return pa.Table.from_arrays([texts.column("t"), texts.column("doc"), *located.columns[1:]], names=["t", "least", *located.column_names[1:]])


def _unowned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without doc_id: nothing goes."""
    for batch in batches:
        held = [t.encode().split() for t in batch.column(1).to_pylist()]
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in held]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in held], pa.int64()), pa.array([0] * len(held), pa.int64()), pa.array(sha)], names=["doc_id", *_LOCATED.names[1:]])


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs(doc_id, text); other columns are ignored.

    A word is removed when a window of `width` consecutive words that covers it starts in a document with a smaller
    doc_id as well. Words are runs of other characters than white space, unchanged; windows are judged on the input.
    kept_sha256: hex digest of the kept words joined by one blank. Null text has no words. Rows that repeat a doc_id are
    one document and don't make each other's words repeated; a row without doc_id keeps all and owns nothing. Of equal
    windows in several earlier documents any is the owner: the result is the same. A very long text is a shard of its
    own. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.unhex(F.sha2(text, 256)).alias("t"), text.alias("text"))
    rows = table(own.where("doc IS NOT NULL").select("doc", "t", F.octet_length("text").alias("bytes")), "rows")
    first = table(rows.groupBy("t").agg(F.min("doc").alias("doc"), F.max("bytes").alias("bytes")), "first")
    held, whole = (int(d.agg(F.sum("bytes")).first()[0] or 0) for d in (first, rows))
    shards = max(1, -(-held // SHARD_BYTES), -(-whole // (COPIES * SHARD_BYTES)))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    dealt = F.pmod(F.xxhash64("doc", "t"), F.lit(shards)).alias("shard")
    known, all_rows = first.select(dealt, "doc", "t"), own.where("doc IS NOT NULL").select(dealt, "doc", "t", "text")
    texts = all_rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_firsts, "shard long, id long, doc long, t binary, text string")
    texts = bucketed(texts, "texts", "shard", buckets)
    release(first)
    sharded = texts.groupBy("shard")

    def shard(c: str) -> Column:
        return F.shiftright(c, 32).alias("shard")

    hits = shared_keys(texts.select("id", "text"), partial(_anchors, width=width)).groupBy("id").agg(F.collect_list("key").alias("anchors"))
    hits = table(hits.select(shard("id"), "id", "anchors"), "hits")
    windows = sharded.cogroup(hits.groupBy("shard")).applyInArrow(partial(_candidates, width=width), "w1 long, w2 long, anchor long, id long, doc long, owner long")
    place = F.when(F.col("owner").isNotNull(), F.xxhash64("w1", "id")).otherwise(F.xxhash64("w1"))
    windows = windows.repartition(place).sortWithinPartitions("w1", "w2", "doc", "id")
    found = table(windows.mapInArrow(_owned, "id long, anchor long, owner long, w1 long"), "found")
    release(hits)
    names = table(found.groupBy(F.col("owner").alias("id")).agg(F.collect_set("w1").alias("names")).select(shard("id"), "id", "names"), "names")
    passages = sharded.cogroup(names.groupBy("shard")).applyInArrow(partial(_passages, width=width), "anchor long, owner long, first long, passage binary")
    passages = table(passages, "passages")
    release(names)
    needs = found.select(shard("id"), "anchor", "owner").distinct()
    told = needs.join(passages, ["anchor", "owner"]).select("shard", "first", "passage")
    located = sharded.cogroup(told.groupBy("shard")).applyInArrow(partial(_judged, width=width), "t binary, least long, n_words long, n_removed long, kept_sha256 string")
    judged = table(located, "located")
    release(found, passages, texts)

    copy = (F.col("doc") > F.col("least")) & (F.col("n_words") >= width)
    out = rows.join(judged, "t").select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    null = own.where("doc IS NULL").select(F.col("doc").alias("doc_id"), "text")
    return out.unionByName(null.mapInArrow(_unowned, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
