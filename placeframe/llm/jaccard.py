"""Exact Jaccard join of word-shingle sets by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

Sizes fall in bands [l, r] with r = l / similarity, so similar sets lie in one band or in neighbours. A set makes
signatures for its own band and for the next one up. For a band, sets that are similar enough differ in at most
k = 2 r (1 - s) / (1 + s) elements. The feature domain is cut into n1 first-level parts of n2 pieces by hash range: some
part holds at most one difference, and so some subset of n2 - 1 of its pieces none, whose content is the signature.

One part more than needed is cut. At least two parts then agree for a similar pair, so a set with at most one part
that has a nearly empty subset leaves that part's signatures out: they would meet those of unrelated sets. A pair stays
covered: one part that agrees is left out by neither side, as what agrees is equally full on both.

Steps: 1. A row for each text with the size and 128-bit name of its set; equal sets are one. 2. A screen: a set whose
smallest hashes hardly stand in other sets has no similar one. 3. Signatures of the sets that are left; those that two
sets share make candidates. 4. Pairs whose sketches allow a link are verified on the words themselves.
Names and hashes only choose what is compared; a link is decided by words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.llm import tokens
from placeframe.llm.columns import hashes
from placeframe.llm.graph import components
from placeframe.llm.meeting import shared_counts, shared_keys
from placeframe.llm.scratch import release, stored_bytes, table

#: A written table of at most so many bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
PIECES, SMALL = 3, 2
#: Sets of a bucket that meet all others of it in the first round.
PIVOTS = 1


class Bands:
    """Size bands and the cut of the domain for each; similarity is percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.edges, self.cuts = percent, [1], {}

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def differences(self, band: int) -> int:
        top = self.edges[band] * 100 // self.percent
        return 2 * top * (100 - self.percent) // (100 + self.percent)

    def cut(self, band: int) -> tuple[np.ndarray, int]:
        """Upper edges of the pieces in the hash domain, and the number of first-level parts; none if nothing may differ."""
        if band not in self.cuts:
            self.band(self.edges[band])
            k = self.differences(band)
            n1 = 0 if k == 0 else -(-(k + 1) // 2) + 1
            n = n1 * PIECES
            self.cuts[band] = np.array([(i << 64) // n for i in range(1, n)], np.uint64) if n else np.empty(0, np.uint64), n1
        return self.cuts[band]


def _sorted_different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, size, sorted different shingle hashes in each lane) of each text.

    A text with fewer words has its whole sequence as its one shingle. The set's size counts names of 128 bits.
    """
    none = np.empty(0, np.uint64)
    for row, end, data, at in tokens.parts(batch):
        w = tokens.Words(data, at, lower=True)
        names = w.names()
        grams = tokens.sequences(names, size)
        for i in range(end - row):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= size:
                x, y = (g[a : b - size + 1] for g in grams)
            elif b > a:
                x, y = tokens.sequences((names[0][a:b], names[1][a:b]), int(b - a))
            else:
                x, y = none, none
            p, q = _sorted_different(x), _sorted_different(y)
            n = len(p) if len(p) == len(q) else len(np.unique(np.stack([x, y]), axis=1).T)
            yield row + i, n, p, q


def name_of(p: np.ndarray, q: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits for a set: sums over the elements of either lane."""
    return tokens.mix(p).sum(dtype=np.uint64), tokens.mix(q ^ np.uint64(len(p))).sum(dtype=np.uint64)


def signatures(s: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    edges, n1 = bands.cut(band)
    if not n1:
        return np.empty(0, np.uint64)
    at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens.mix(s), dtype=np.uint64)))
    held = (sums[at[1:]] - sums[at[:-1]]).reshape(n1, PIECES)
    count = np.diff(at).reshape(n1, PIECES)
    subsets = [list(x) for x in combinations(range(PIECES), PIECES - 1)]
    content = np.stack([held[:, x].sum(axis=1, dtype=np.uint64) for x in subsets], axis=1)
    thin = np.stack([count[:, x].sum(axis=1) for x in subsets], axis=1).min(axis=1) <= SMALL
    name = (np.arange(n1 * len(subsets), dtype=np.uint64) + np.uint64(band << 32)).reshape(n1, len(subsets))
    sig = tokens.mix(content + tokens.mix(name + np.uint64(1)))
    return sig[~thin].ravel() if thin.sum() <= 1 else sig.ravel()


def sketch(s: np.ndarray) -> np.ndarray:
    """Four bits for each of 128 pieces of the domain: pieces that differ are no more than the elements that do."""
    at = np.searchsorted(s, _PIECE_EDGES)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens.mix(s + np.uint64(7)), dtype=np.uint64)))
    bits = (tokens.mix(sums[np.append(at, len(s))] - sums[np.concatenate(([0], at))]) & np.uint64(15)).reshape(8, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def fine_sketch(s: np.ndarray) -> bytes:
    """A byte for each of about as many pieces of the domain as the set has elements: the sum of what the piece holds."""
    wide = max(4, int(len(s) - 1).bit_length())
    return np.bincount((s >> np.uint64(64 - wide)).astype(np.int64), (tokens.mix(s + np.uint64(7)) & np.uint64(255)).astype(np.float64), 1 << wide).astype(np.int64).astype(np.uint8).tobytes()


def pieces_differing(x: bytes, y: bytes) -> int:
    """How many pieces of two fine sketches differ, at the coarser's pieces; no more than the elements that do."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) != len(q):
        n = min(len(p), len(q))
        p, q = (z.reshape(n, -1).sum(axis=1, dtype=np.uint8) for z in (p, q))
    return int(np.count_nonzero(p != q))


_PIECE_EDGES = np.array([i << 57 for i in range(1, 128)], np.uint64)
SKETCH = [f"s{i}" for i in range(8)]

_SETS = "doc_id long, t1 long, t2 long, n long, v1 long, v2 long"
_SKETCHES = "id long, text string, fine binary, n long, " + ", ".join(f"{s} long" for s in SKETCH)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(n, *name_of(p, q)) for _, n, p, q in shingle_sets(batch, size)]
        n, v1, v2 = (np.array(x) for x in zip(*made, strict=True)) if made else (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2)
        yield from tokens.rows_of([{"doc_id": batch.column(0), "t1": batch.column(1), "t2": batch.column(2), "n": n.astype(np.int64), "v1": v1, "v2": v2}], _schema(_SETS))


def _own(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, elements) of the rows whose text has the set of that id; columns id, v1, v2 and text."""
    ids, v1, v2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "v1", "v2"))
    for row, n, p, q in shingle_sets(batch, size):
        if tuple(np.array(name_of(p, q)).view(np.int64)) == (v1[row], v2[row]):
            yield ids[row], p


def _smallest(batch: pa.RecordBatch, size: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """The smallest |s| - o + l hashes of each set s, o = ceil(similarity |s|), l = ceil(|s| / 10).

    Similar sets have o elements in common at least; the l smallest of these are among the first |s| - o + l of either.
    """
    for i, p in _own(batch, size):
        yield i, p[: len(p) + (-percent * len(p)) // 100 - (-len(p) // 10)]


def _signed(batch: pa.RecordBatch, size: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's signatures."""
    bands = Bands(percent)
    for i, p in _own(batch, size):
        if len(p):
            own = bands.band(len(p))
            yield i, _sorted_different(np.concatenate([signatures(p, own, bands), signatures(p, own + 1, bands)]))


def _sketched(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = _schema(_SKETCHES)
    for batch in batches:
        ids, v1, v2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "v1", "v2"))
        took, n, drawn, fine = [], [], [], []
        for row, k, p, q in shingle_sets(batch, size):
            if tuple(np.array(name_of(p, q)).view(np.int64)) == (v1[row], v2[row]):
                took.append(row)
                n.append(k)
                drawn.append(sketch(p))
                fine.append(fine_sketch(p))
        if took:
            at = np.array(took)
            lanes = np.stack(drawn)
            text = batch.column(batch.schema.get_field_index("text")).take(pa.array(at))
            yield from tokens.rows_of([{"id": ids[at], "text": text, "fine": fine, "n": np.array(n, np.int64)} | {s: lanes[:, i] for i, s in enumerate(SKETCH)}], schema)


def _differing(a: str, b: str) -> Column:
    """How many pieces of two sketches differ."""
    total = F.lit(0)
    for c in SKETCH:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total += F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def similar(texts: pa.Array, size: int, percent: int) -> np.ndarray:
    """Whether texts 2i and 2i + 1 are similar, for each i: by their words, whatever the hashes say.

    Words and, word by word, their sequences get numbers that are equal if and only if they are equal.
    """
    out = [np.empty(0, bool)]
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for row, end, data, at in tokens.parts(batch, most=tokens.PART_BYTES, step=2):
        w = tokens.Words(data, at, lower=True)
        rows = end - row
        words = w.array().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text with fewer words is one shingle of that length: its missing words are of a kind of their own
        n = np.diff(w.first)
        short = np.where((n > 0) & (n < size), size - n, 0)
        place = np.repeat(np.cumsum(short) - short, n) + np.arange(len(words))
        code = np.full(len(words) + short.sum(), -1, np.int64)
        code[place] = words
        own = np.repeat(np.arange(rows), n + short)
        codes = code + 1
        gram = codes
        for k in range(1, size):
            pairs = gram[: len(codes) - k] * (int(codes.max(initial=0)) + 1) + codes[k:]
            gram = np.unique(pairs, return_inverse=True)[1] if len(pairs) else pairs
        if len(codes) < size:
            gram = np.empty(0, np.int64)
        inside = own[: len(gram)] == own[size - 1 :][: len(gram)]
        wide = int(gram.max(initial=0)) + 1
        held = _sorted_different(own[: len(gram)][inside] * wide + gram[inside])
        count = np.bincount(held // wide, minlength=rows)
        shared = np.sort((held // wide // 2) * wide + held % wide)
        both = shared[1:][shared[1:] == shared[:-1]] // wide
        common = np.bincount(both, minlength=rows // 2)
        x, y = count[::2], count[1::2]
        out.append((common > 0) & (100 * common >= percent * (x + y - common)))
    return np.concatenate(out)


def _verified(batches: Iterable[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            n = batch.num_rows
            both = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
            yield batch.select(["a", "b"]).filter(pa.array(similar(both, size, percent)))


def _possible(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose fine sketches (x of m elements, y of n) allow a link."""
    for batch in batches:
        sizes = (batch.column(4).to_numpy() + batch.column(5).to_numpy()).tolist()
        keep = [pieces_differing(x, y) * (100 + percent) <= n * (100 - percent) for x, y, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), sizes, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: fine sketches go first, so that few pairs carry their texts."""
    x, y = (held.select(F.col("id").alias(e), F.col("fine").alias(f), F.col("n").alias(m)) for e, f, m in (("a", "x", "m"), ("b", "y", "n")))
    possible = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(partial(_possible, percent=percent), "a long, b long")
    x, y = (held.select(F.col("id").alias(e), F.col("text").alias(f)) for e, f in (("a", "x"), ("b", "y")))
    return possible.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(partial(_verified, size=size, percent=percent), "a long, b long")


def _near(percent: int) -> Column:
    """Whether the sketches of p and q allow a link."""
    return _differing("p", "q") * (100 + percent) <= (F.col("p.n") + F.col("q.n")) * (100 - percent)


def _linked_sets(live: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(id, c) for the sets that have a link: c is one id for all that links connect; none without a link.

    A bucket is the sets that share a signature. In a round its pivots, those that share most signatures, meet its other
    members, unless they are connected by now or their sketches, which the rows hold, rule a link out: the join makes no
    row for these. The pairs left are verified. Then buckets that are one component by now are let go, and in the others the pivots, which have
    met all. So every pair that shares a signature is verified, excluded by its sketches, or connected otherwise.
    Pivots grow eightfold, so that the rounds are few.
    """
    shared = live.groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    kept = ["sig", "id", "deg", "n", *SKETCH]
    rows = table(live.join(shared, "id").join(held.drop("text", "fine"), "id").select(*kept, F.col("id").alias("c")), "buckets")
    labels, pivots = None, PIVOTS
    while not rows.isEmpty():
        order = W.partitionBy("sig").orderBy(F.desc("deg"), "id")
        chosen = table(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots).drop("r"), "pivots")
        both = chosen.alias("p").join(rows.alias("q"), (F.col("p.sig") == F.col("q.sig")) & (F.col("p.c") != F.col("q.c")) & _near(percent))
        pairs = table(both.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct(), "pairs")
        new = table(_links(pairs, held, size, percent), "links")
        release(pairs)
        if not new.isEmpty():
            known = [] if labels is None else [labels.select(F.col("id").alias("a"), F.col("c").alias("b"))]
            found = components(reduce(DataFrame.unionByName, known, new)).select(F.col("v").alias("id"), "c")
            old, labels = labels, table(found, "labels")
            release(old)
        rest = rows.drop("c").join(chosen.select("sig", "id"), ["sig", "id"], "left_anti")
        rest = rest.withColumn("c", F.col("id")) if labels is None else rest.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))
        rest = table(rest.select(*kept, "c"), "rest")
        mixed = rest.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig")
        left = table(rest.join(mixed, "sig"), "buckets")
        release(rows, chosen, new, rest)
        rows, pivots = left, pivots * 8
    release(rows)
    return labels


def _texts(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """id, v1, v2, text: the rows of docs with the doc_id of one of the sets, a written table; the set is told by its name."""
    keyed = sets.select("doc_id", "id", "v1", "v2")
    few = stored_bytes(sets) <= BROADCAST_BYTES
    return docs.join(F.broadcast(keyed) if few else keyed, "doc_id").select("id", "v1", "v2", "text")


def _different(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: a row for each of docs, and the different sets, each with an id and its first document."""
    t1, t2 = hashes(F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col("text").cast("string").alias("text"))
    rows = table(docs.mapInArrow(partial(_sets, size=size), _SETS), "sets")
    first = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("v1", "v2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    return rows, table(first.withColumn("id", F.monotonically_increasing_id()), "different")


def _candidates(docs: DataFrame, first: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: signatures (sig, id) that sets share; texts, sizes and sketches of those sets."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    # a set links only if a tenth of the smaller partner's size, of its own smallest hashes, stand elsewhere too
    told = shared_counts(_texts(given, first), partial(_smallest, size=size, percent=percent))
    often = told.groupBy("id").agg(F.sum("m").alias("m")).join(first, "id").where(F.col("m") * 1000 >= F.col("n") * percent)
    partnered = table(often.select("doc_id", "id", "v1", "v2"), "partnered")
    texts = table(_texts(given, partnered), "texts")
    live = table(shared_keys(texts, partial(_signed, size=size, percent=percent)).withColumnRenamed("key", "sig"), "live")
    ids = live.select("id").distinct()
    held = table(texts.join(ids, "id", "left_semi").mapInArrow(partial(_sketched, size=size), _SKETCHES).dropDuplicates(["id"]), "held")
    release(partnered, texts)
    return live, held


def near_links(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """a, b: every link between different sets, each named by the smallest doc_id that has it; a < b.

    All pairs that share a signature and whose sketches allow a link are verified, so the rows grow with the square of a
    group of near copies, as the links do.
    """
    rows, first = _different(docs, size)
    live, held = _candidates(docs, first, size, percent)
    sides = live.join(held.drop("text", "fine"), "id")
    both = sides.alias("p").join(sides.alias("q"), (F.col("p.sig") == F.col("q.sig")) & (F.col("p.id") < F.col("q.id")) & _near(percent))
    pairs = both.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    links = table(_links(pairs, held, size, percent), "links")
    release(rows, live, held)
    names = [first.select(F.col("id").alias(e), F.col("doc_id").alias(f"d{e}")) for e in "ab"]
    named = links.join(names[0], "a").join(names[1], "b")
    return named.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).where("a < b").distinct()


def _labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' table of _different(), and (v1, v2, c, component_id) of the sets: their component and its least doc_id."""
    rows, first = _different(docs, size)
    live, held = _candidates(docs, first, size, percent)
    labels = _linked_sets(live, held, size, percent)
    release(live, held)
    if labels is None:
        named = first.select("v1", "v2", F.col("id").alias("c"), F.col("doc_id").alias("component_id"))
    else:
        labelled = first.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))
        least = labelled.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        named = labelled.select("v1", "v2", "c").join(least, "c")
    named = table(named.select("v1", "v2", "c", "component_id"), "named")
    release(first, labels)
    return rows, named


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text); other columns are ignored.

    Two texts link when the Jaccard similarity of their sets of `size`-word shingles (A-Z in lower case) is at least
    percent / 100; component_id is the smallest doc_id reachable by links. Equal sets are one vertex, so copies are
    never expanded into pairs. A text without words, or null, has no shingles and links with nothing. A row without
    doc_id has component_id null and links with nothing. Repeated rows stay repeated; rows of one doc_id with different
    texts are texts of their own. Ties have no part in the result. A very long text is held once in a worker's memory,
    some 60 bytes a byte. An empty table gives an empty result. Links are decided by the words themselves. It finds what links connect
    and not all links, as sets that are connected by now are not compared; all links are those of near_links().
    """
    rows, named = _labelled(docs, size, percent)
    out = rows.join(named.select("v1", "v2", "component_id"), ["v1", "v2"], "left")
    linked = F.when(F.col("n") > 0, F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(linked, "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row of docs for each component of near_duplicates(): the one with the smallest doc_id.

    If several of its texts have that doc_id, the one with the smallest hash stays; rows that repeat doc_id and text
    count once. Texts without words stay, once for each doc_id. Rows without doc_id all stay. docs may have columns of
    any names; null texts, very long texts and an empty table are as in near_duplicates().
    """
    rows, named = _labelled(docs, size, percent)
    given = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "t1", "t2", "v1", "v2").agg(F.count(F.lit(1)).alias("many"), F.max("n").alias("n"))
    row = F.struct("doc_id", "t1", "t2", "many")
    led = given.where("n > 0").join(named, ["v1", "v2"]).groupBy("c").agg(F.min(row).alias("row")).select("row.*")
    bare = given.where("n = 0").groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    kept = table(led.unionByName(bare), "kept")
    release(rows, named)
    # the row goes along whole, so that no column of docs can clash with a name made here
    t1, t2 = hashes(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"))
    few = stored_bytes(kept) <= BROADCAST_BYTES
    joined = whole.join(F.broadcast(kept) if few else kept, ["doc_id", "t1", "t2"])
    out = joined if kept.where("many > 1").isEmpty() else joined.where("many = 1").unionByName(joined.where("many > 1").dropDuplicates(["doc_id", "t1", "t2"]))
    return out.select("row.*").unionByName(docs.where("doc_id IS NULL"))
