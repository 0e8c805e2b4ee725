"""Graphs as tables of links: components, clusters, gaps, shortest paths and greedy thinning. No graph is collected."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.operators import spatial
from placeframe.storage import release, stored_bytes, table

#: Rounds of shortest_paths() whose changes are kept apart.
MERGE = 8
#: Links that one task contracts at once, and links of a block of shortest_paths().
CHUNK, BLOCK = 1 << 18, 1 << 22
#: Sources that are walked from in one task (fewer, but not below the least, while there is a task for every core), and the
#: most distances that they may give.
SOURCES, LEAST, DISTANCES = 256, 64, 1 << 22
#: Where lengths are whole steps of a unit: a level that is not reached, links of a pack, parts with fewer of which share one,
#: sources and distances of a task, and nodes whose levels are one row.
UNREACHED, PACK, MANY, LEVELS, SPAN = 255, 1 << 17, 1024, 1 << 27, 1 << 13
#: A written table of at most so many bytes is broadcast.
BROADCAST_BYTES = 8 << 20


def _roots(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of some links, without the smallest of each part, and the smallest of their parts."""
    v, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(v))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    child = np.flatnonzero(root != np.arange(len(v)))
    return v[child], v[root[child]]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, w) as stars: in every CHUNK of links, each vertex and the smallest it reaches by them."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(x.num_rows for x in held) >= CHUNK):
            u, w = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(u, w)], names=["u", "w"])
            held = []


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u, w) lead from each u to one w that is no u."""
    ends = edges.select(F.col("u").alias("v"), F.lit(1).alias("k")).unionByName(edges.select(F.col("w").alias("v"), F.lit(0).alias("k")))
    return ends.groupBy("v").agg(F.sum("k").alias("n"), F.min("k").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(v, c): each end of a link (a, b), and the smallest id reachable from it.

    Tasks contract what they hold, first as the links come and then in ranges of ids, as neighbours often have close
    ones. That leaves each vertex with a root; only roots that are still linked to others take rounds (_rounds).
    """
    ends = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("w")).where("u <> w")
    first = table(ends.mapInArrow(_contracted, "u long, w long"), "edges")
    edges = table(first.repartitionByRange("u").sortWithinPartitions("u").mapInArrow(_contracted, "u long, w long"), "edges")
    release(first)
    best = table(edges.groupBy("u").agg(F.min("w").alias("m"), F.max("w").alias("last")), "best")
    roots = table(edges.select("w").distinct(), "roots")
    several = edges.join(best.where("m < last").select("u", "m"), "u").where("w > m").select(F.col("w").alias("u"), F.col("m").alias("w"))
    linked = table(several.unionByName(best.join(roots.withColumnRenamed("w", "u"), "u", "left_semi").select("u", F.col("m").alias("w"))).distinct(), "linked")
    release(edges)
    own = roots.select(F.col("w").alias("v"))
    if linked.isEmpty():
        return best.select(F.col("u").alias("v"), F.col("m").alias("c")).unionByName(own.withColumn("c", F.col("v")))
    own = own.join(best.select(F.col("u").alias("v")), "v", "left_anti").withColumn("c", F.col("v"))
    made = best.select(F.col("u").alias("v"), F.col("m").alias("c")).unionByName(own)
    labels = _rounds(linked).select(F.col("v").alias("c"), F.col("c").alias("label"))
    return made.join(labels, "c", "left").select("v", F.coalesce("label", "c").alias("c"))


def _rounds(edges: DataFrame) -> DataFrame:
    """components() of a written table of links (u, w), u > w, by alternating large-star and small-star rounds (Kiveris
    and others, 2014): every step is a minimum that is pre-aggregated before its shuffle and an equi-join, so that a
    vertex with very many links is no group in memory. Each round is written to the shared folder."""
    while not _stars(edges):
        last = edges
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("w") == F.col("m"), F.col("u")).otherwise(F.col("w")).alias("u"), F.col("m").alias("w"))
        edges = table(small.unionByName(least.withColumnRenamed("m", "w")).where("u <> w").distinct(), "edges")
        release(last)
    roots = edges.select("w").distinct()
    return edges.select(F.col("u").alias("v"), F.col("w").alias("c")).unionByName(roots.select(F.col("w").alias("v"), F.col("w").alias("c")))


def component_summary(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """component, nodes, length, lon, lat of links(a, b, length) over nodes(node_id, lon, lat)."""
    labels = components(links)
    size = labels.join(nodes, F.col("v") == F.col("node_id")).groupBy("c").agg(F.count(F.lit(1)).alias("nodes"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    length = links.join(labels, F.col("a") == F.col("v")).groupBy("c").agg(F.sum("length").alias("length"))
    return size.join(length, "c").withColumnRenamed("c", "component")


def edges_of(way_nodes: DataFrame) -> DataFrame:
    """a, b, way_id, pos: consecutive different nodes of each way (way_id, pos, node_id)."""
    following = F.lead("node_id").over(W.partitionBy("way_id").orderBy("pos"))
    return way_nodes.select("way_id", "pos", F.col("node_id").alias("a"), following.alias("b")).where("b IS NOT NULL AND a <> b")


def _ends(links: DataFrame) -> DataFrame:
    """id and only neighbour of the nodes that have one."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("only"), F.max("b").alias("last")).where("only = last").select("id", "only")


def dead_ends(links: DataFrame) -> DataFrame:
    """node_id of the nodes with one neighbour only."""
    return _ends(links).select(F.col("id").alias("node_id"))


def gaps(links: DataFrame, nodes: DataFrame, distance: float) -> DataFrame:
    """node_id, other, dist: each dead end's nearest of nodes(node_id, lon, lat) at most `distance` away that it has no link to.

    Of the nodes at one place three are enough: a dead end can't take itself and its only neighbour. One that finds
    another at its own place is done; the others meet places, not nodes.
    """
    at = nodes.select(F.col("node_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y")).where(spatial._placed("x", "y"))
    at = table(at, "nodes")
    nth = F.dense_rank().over(W.partitionBy("x", "y").orderBy("id"))
    spots = table(at.withColumn("n", nth).where("n <= 3").groupBy("x", "y").agg(F.collect_set("id").alias("ids")), "spots")
    other = F.array_min(F.filter("ids", lambda i: (i != F.col("id")) & (i != F.col("only")))).alias("other")
    ends = table(at.join(_ends(links), "id").join(spots, ["x", "y"]).select("id", "only", "x", "y", other), "ends")
    release(at)
    width = 2 * distance * (1 + 1e-9) or 1.0
    sides = [F.explode(F.sequence(F.floor((F.col(v) - distance) / width), F.floor((F.col(v) + distance) / width))).alias(f"b{v}") for v in "xy"]
    far = ends.where("other IS NULL").select("id", "only", "x", "y", sides[0]).select("id", "only", "x", "y", "bx", sides[1])
    there = spots.select("ids", F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / width).alias("bx"), F.floor(F.col("y") / width).alias("by"))
    near = far.join(there, ["bx", "by"]).withColumn("dist", spatial._apart("ox", "oy")).where(F.col("dist") <= distance).select("id", "dist", other).where("other IS NOT NULL")
    found = near.unionByName(ends.where("other IS NOT NULL").select("id", F.lit(0.0).alias("dist"), "other"))
    return found.groupBy(F.col("id").alias("node_id")).agg(F.min(F.struct("dist", "other")).alias("b")).select("node_id", "b.other", "b.dist")


def _walk(asked: pa.Table, links: pa.Table, limit: float) -> pa.Table:
    """Shorter ways inside a block: rows (blk, source, node, dist, beyond) of what fell below what was known (`old` rows).

    links (a, b, length, inside): those that leave the block are no way back, their b is beyond it. A source walks along
    its links in the order in which they end, so that long links of far nodes, which no way needs, are never met. Rows
    `wanted` ask for the way to one node: such a source gives no others, and ends with the last of them.
    """
    a, b, length = (links.column(c).to_numpy() for c in ("a", "b", "length"))
    inside = links.column("inside").to_numpy().astype(bool)
    nodes, at = np.unique(np.concatenate([a, b, asked.column("node").to_numpy()]), return_inverse=True)
    ia, ib, given = at[: len(a)], at[len(a) : 2 * len(a)], at[2 * len(a) :]
    beyond = np.zeros(len(nodes), bool)
    beyond[ib[~inside]] = True
    start, to, length = np.concatenate([ia, ib[inside]]), np.concatenate([ib, ia[inside]]), np.concatenate([length, length[inside]])
    order = np.lexsort((length, start))
    to, length = to[order], length[order]
    lengths, rank = np.unique(length, return_inverse=True)
    of = len(lengths) + 1
    small = np.int32 if len(nodes) * of < 1 << 31 else np.int64  # half as much to search
    place = (start[order] * of + rank).astype(small)  # in the order of node and length
    first = np.searchsorted(start[order], np.arange(len(nodes) + 1))
    stride = max(length.mean() / 4, limit / 256) if len(length) else 0.0
    upon = np.full(len(nodes), np.inf)  # the length of each node's first link
    linked = np.flatnonzero(first[1:] > first[:-1])
    upon[linked] = length[first[linked]]
    source, dist = asked.column("source").to_numpy(), asked.column("dist").to_numpy()
    old, wanted = (asked.column(c).to_numpy().astype(bool) for c in ("old", "wanted"))
    out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
    by = np.argsort(source, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(source[by])) + 1):
        d, fell, ends = np.full(len(nodes), np.inf), np.zeros(len(nodes), bool), np.full(len(nodes), np.inf)
        d[given[rows[old[rows]]]] = dist[rows[old[rows]]]
        ask = np.unique(given[rows[wanted[rows]]])
        new = rows[~old[rows] & ~wanted[rows]]
        new = new[dist[new] < d[given[new]]]
        d[given[new]] = dist[new]
        fell[given[new]] = True
        ends[given[new]] = dist[new] + upon[given[new]]  # where each node's next link ends
        following = first[:-1].copy()
        while (least := ends.min(initial=np.inf)) <= limit and least < (d[ask] if len(ask) else d).max():  # else nothing can fall any more
            front = np.flatnonzero(ends <= least + stride)
            upto = np.searchsorted(lengths, least + stride - d[front], "right")
            begin, end = following[front], np.searchsorted(place, (front * of + upto).astype(small))
            end = np.maximum(end, begin + 1)
            following[front] = end
            left = end < first[front + 1]
            ends[front] = np.inf
            ends[front[left]] = d[front[left]] + length[end[left]]
            many = end - begin
            k = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            far, reached = np.repeat(d[front], many) + length[k], to[k]
            better = (far < d[reached]) & (far <= limit)
            far, reached = far[better], reached[better]
            np.minimum.at(d, reached, far)
            fell[reached] = True
            following[reached], ends[reached] = first[reached], d[reached] + upon[reached]
        hit = ask[fell[ask]] if len(ask) else np.flatnonzero(fell)
        out.append((np.full(len(hit), source[rows[0]]), nodes[hit], d[hit], beyond[hit]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    blk = np.full(len(cols[0]), asked.column("blk")[0].as_py(), np.int32)
    return pa.table([pa.array(x) for x in (blk, *cols)], names=["blk", "source", "node", "dist", "beyond"])


def _unit(steps: DataFrame, limit: float) -> float | None:
    """The largest power of two of which all lengths are multiples, if a way up to the limit is of fewer than UNREACHED."""
    units = [2.0**k for k in range(10, -9, -1) if limit / 2.0**k < UNREACHED]
    odd = [F.count_if(F.coalesce(F.col("length") % F.lit(u) != 0, F.lit(True))) for u in units]
    least, *odd = steps.agg(F.min("length"), *odd).first()
    return next((u for u, n in zip(units, odd, strict=True) if not n), None) if least is not None and least > 0 else None


def _zipped(values: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(values.tobytes(), asbytes=True)


def _unzipped(data: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, size * np.dtype(kind).itemsize, asbytes=True), kind)


_PACKED = (("a", np.int64), ("b", np.int64), ("step", np.uint8))


def _packs(links: pa.Table) -> pa.Table:
    """Links of a part as one row of packed columns."""
    one = {c: [links.column(c)[0].as_py()] for c in ("part", "own")} | {"n": [links.num_rows]}
    return pa.table(one | {c: pa.array([_zipped(links.column(c).to_numpy().astype(kind))], pa.binary()) for c, kind in _PACKED})


def _indexed(*ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different ids in order, and the place of each of some."""
    low, high = min(x.min() for x in ids if len(x)), max(x.max() for x in ids if len(x))
    if high - low > 16 * sum(map(len, ids)):  # too many numbers between them
        nodes, at = np.unique(np.concatenate(ids), return_inverse=True)
        return nodes, np.split(at, np.cumsum([len(x) for x in ids])[:-1])
    there = np.zeros(high - low + 1, bool)
    for x in ids:
        there[x - low] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, [place[x - low] for x in ids]


class _Net:
    """Links of some parts by their steps: for each, the ends, in the order of the other end, and where these change."""

    def __init__(self, packs: pa.Table, sources: np.ndarray, wanted: np.ndarray, top: int):
        n = packs.column("n").to_pylist()
        a, b, step = (np.concatenate([_unzipped(x, k, kind) for x, k in zip(packs.column(c).to_pylist(), n, strict=True)]) for c, kind in _PACKED)
        near = step <= top  # no way takes a longer one
        a, b, step = a[near], b[near], step[near].astype(np.int64)
        self.nodes, (ia, ib, self.sources, self.wanted) = _indexed(a, b, sources, wanted)
        code = np.concatenate([step << 54 | ia << 27 | ib, step << 54 | ib << 27 | ia])
        code.sort()
        ends, other, step = code & ((1 << 27) - 1), code >> 27 & ((1 << 27) - 1), code >> 54
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        self.by: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                heads = np.flatnonzero(np.diff(other[i:j], prepend=-1))
                self.by.append((int(step[i]), ends[i:j], np.append(heads, j - i), other[i:j][heads]))

    def walk(self, sources: np.ndarray, top: int, pending: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """level, nodes, bits: what up to 64 sources, a bit for each, reach first at each level, all of them at once.

        A level is made of those that lie a link's steps before it. pending: places and bits that alone are asked for.
        """
        bits = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
        seen = np.zeros(len(self.nodes), np.uint64)
        np.bitwise_or.at(seen, sources, bits)
        at = np.flatnonzero(seen)
        held = {0: (seen.copy(), at)}
        whole = np.bitwise_or.reduce(bits)
        for level in range(top + 1):
            if level:
                came = np.zeros(len(seen), np.uint64)
                for step, ends, heads, other in self.by:
                    if level - step not in held:
                        continue
                    last, at = held[level - step]
                    if 8 * len(at) < len(other):  # few: their own links alone
                        k = np.minimum(np.searchsorted(other, at), len(other) - 1)
                        at, k = at[other[k] == at], k[other[k] == at]
                        many = heads[k + 1] - heads[k]
                        link = np.repeat(heads[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
                        np.bitwise_or.at(came, ends[link], np.repeat(last[at], many))
                    else:
                        came[other] |= np.bitwise_or.reduceat(last[ends], heads[:-1])
                came &= ~seen
                at = np.flatnonzero(came)
                held.pop(level - (self.by[-1][0] if self.by else 1), None)
                if len(at):
                    held[level] = (came, at)
                    seen |= came
            if len(at):
                yield level, at, held[level][0][at]
            if pending is not None and not (pending[1] & ~seen[pending[0]]).any():
                return
            if not held or (seen == whole).all():
                return


def _levels(asked: pa.Table, packs: pa.Table, top: int, unit: float, paired: bool) -> pa.Table:
    """The ways from the sources of a task, a word of 64 at a time: rows (source, node, dist) of asked pairs, or the levels
    of the nodes reached as packed rows."""
    source, node = (asked.column(c).to_numpy() for c in ("source", "node"))
    sources = np.unique(source)
    net = _Net(packs, sources, node if paired else sources[:0], top)
    rows: list[tuple] = []
    slot = np.searchsorted(sources, source)
    for i in range(0, len(sources), 64):
        own = net.sources[i : i + 64]
        if paired:
            mine = np.flatnonzero(slot // 64 == i // 64)
            places, bit = net.wanted[mine], np.uint64(1) << (slot[mine] % 64).astype(np.uint64)
            for level, at, bits in net.walk(own, top, (places, bit)):
                k = np.minimum(np.searchsorted(at, places), len(at) - 1)
                hit = mine[(at[k] == places) & (bits[k] & bit > 0)]
                rows.append((source[hit], node[hit], np.full(len(hit), level * unit)))
            continue
        found = list(net.walk(own, top, None))
        there = np.unique(np.concatenate([at for _, at, _ in found]))
        reached = np.full((len(there), 64), UNREACHED, np.uint8)
        for level, at, bits in found:
            set_ = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            reached[np.searchsorted(there, at)] -= set_ * np.uint8(UNREACHED - level)
        for j in range(0, len(there), SPAN):
            part = reached[j : j + SPAN, : len(own)].T
            rows.append((len(own), part.shape[1], _zipped(sources[i : i + 64]), _zipped(net.nodes[there[j : j + SPAN]]), _zipped(part)))
    names = ["source", "node", "dist"] if paired else ["ns", "nn", "sources", "nodes", "levels"]
    kinds = [pa.int64(), pa.int64(), pa.float64()] if paired else [pa.int32(), pa.int32(), *[pa.binary()] * 3]
    cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if paired and rows else list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], names=names)


def _unpacked(batches: Iterable[pa.RecordBatch], unit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ns, nn, sources, nodes, levels = (batch.column(i)[r].as_py() for i in range(5))
            level = _unzipped(levels, ns * nn, np.uint8).reshape(ns, nn)
            s, n = np.nonzero(level != UNREACHED)
            cols = _unzipped(sources, ns, np.int64)[s], _unzipped(nodes, nn, np.int64)[n], level[s, n] * unit
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["source", "node", "dist"])


def _level_paths(steps: DataFrame, labels: DataFrame, asked: DataFrame, size: DataFrame, top: int, unit: float, wanted: DataFrame | None) -> DataFrame:
    """shortest_paths() of the parts in size(c, asked, links, nodes), where lengths are multiples of a unit.

    Links go to their tasks in packs; small parts share one. A task walks from 64 sources at a time, a bit for each, level
    by level; without `wanted` it writes a byte for each node reached, which is unpacked when read.
    """
    cores = steps.sparkSession.sparkContext.defaultParallelism
    small, every = F.col("links") * 2 < PACK, size.agg(F.sum(F.when(F.col("links") * 2 < PACK, F.col("links"))), F.sum("asked")).first()
    bins = max(-(-int(every[0] or 0) // PACK), 2 * cores)
    per = F.least(F.lit(max(LEAST, int(every[1] or 0) // (2 * cores), 1)), F.lit(MANY), F.greatest(F.lit(LEAST), F.floor(LEVELS / F.col("nodes"))))
    part = F.when(small, F.pmod(F.xxhash64("c"), F.lit(bins))).otherwise(F.col("c"))
    many = lambda n: F.when(small, 1).otherwise(F.ceil(n)).cast("int")
    parts = table(size.select("c", part.alias("part"), (~small).alias("own"), many(F.col("links") / PACK).alias("packs"), many(F.col("asked") / per).alias("groups")), "parts")
    deal = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    links = steps.join(labels, F.col("a") == F.col("v")).join(parts, "c").select("part", "own", deal("a", "packs").alias("pack"), "a", "b", F.least(F.col("length") / unit, F.lit(UNREACHED)).cast("int").alias("step"))
    packs = links.groupBy("part", "own", "pack").applyInArrow(_packs, "part long, own boolean, n long, a binary, b binary, step binary")
    groups = table(asked.join(parts, "c").select("part", "own", deal("source", "groups").alias("grp"), "source"), "groups")
    if wanted is not None:
        asks = table(groups.join(wanted, "source").join(labels.select(F.col("v").alias("node"), "c"), "node").join(parts.select("c", F.col("part").alias("p"), F.col("own").alias("o")), "c").where("part = p AND own = o").select("part", "own", "grp", "source", "node"), "asks")
    else:
        asks = groups.withColumn("node", F.col("source"))
    key = ["part", "own", "grp"]
    active = table(asks.select(*key).distinct(), "active")
    n = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * cores, min(4 * active.count(), 2048))
    ways = packs.join(F.broadcast(active) if stored_bytes(active) <= BROADCAST_BYTES else active, ["part", "own"])
    schema = "source long, node long, dist double" if wanted is not None else "ns int, nn int, sources binary, nodes binary, levels binary"
    made = asks.repartition(n, *key).groupBy(*key).cogroup(ways.repartition(n, *key).groupBy(*key)).applyInArrow(partial(_levels, top=top, unit=unit, paired=wanted is not None), schema)
    found = table(made, "paths")
    release(parts, groups, active, asks if wanted is not None else None)
    return found if wanted is not None else found.mapInArrow(partial(_unpacked, unit=unit), "source long, node long, dist double")


def shortest_paths(links: DataFrame, sources: DataFrame, limit: float, wanted: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """source, node, dist: the shortest way from each source along links(a, b, length), both ways, up to the limit.

    Parallel links keep the shortest. A block is a component, or a range of the nodes of one that has more than BLOCK
    links. Where lengths are multiples of a unit, a component that is one block is walked level by level (_level_paths),
    else from one source at a time in the order of the distances (_block_paths).

    wanted: pairs (source, node), to which the result is held; where no part is cut into blocks, only they are written, and
    a walk ends with the last of its source's. labels: the written components() of the links, if there are.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length")
    steps = table(ends.groupBy("a", "b").agg(F.min("length").cast("double").alias("length")), "steps")
    told = labels
    labels = table(components(steps), "labels") if told is None else told
    asked = sources.select(F.col("node_id").alias("source")).distinct()
    asked = table(asked.join(labels, F.col("source") == F.col("v"), "left").select("source", "c"), "sources")
    alone = asked.where("c IS NULL").select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"))
    alone = alone if wanted is None else alone.join(wanted, ["source", "node"], "left_semi")
    met = asked.groupBy("c").agg(F.count(F.lit(1)).alias("asked"))  # parts without a source are left out
    size = steps.join(labels, F.col("a") == F.col("v")).groupBy("c").agg(F.count(F.lit(1)).alias("links"))
    size = table(size.join(met, "c").join(labels.groupBy("c").agg(F.count(F.lit(1)).alias("nodes")), "c"), "size")
    unit = _unit(steps, limit)
    if unit is None:
        found = _block_paths(steps, labels, asked, size, limit, wanted)
    else:
        found = _level_paths(steps, labels, asked, size.where(F.col("links") <= BLOCK), int(limit // unit), unit, wanted)
        large = size.where(F.col("links") > BLOCK)
        if not large.isEmpty():
            found = found.unionByName(_block_paths(steps, labels, asked, large, limit, wanted))
    release(steps, None if told is not None else labels, size)
    return found.unionByName(alone)


def _block_paths(steps: DataFrame, labels: DataFrame, asked: DataFrame, size: DataFrame, limit: float, wanted: DataFrame | None) -> DataFrame:
    """shortest_paths() of the parts in size(c, asked, links, nodes).

    A task walks from some sources, in the order of their distances, through the links of a block alone, which are
    dealt to it once: no row is made for each source and link. What leaves a block goes on in the next round. Only what
    fell is written; these tables are the state, and are merged into one after every MERGE rounds.
    """
    wide = int(size.where(F.col("links") > BLOCK).agg(F.sum("links")).first()[0] or 0)
    home = labels.join(size.where(F.col("links") <= BLOCK).select("c"), "c").select("v", "c", F.lit(0).alias("blk"))
    if wide:
        large = labels.join(size.where(F.col("links") > BLOCK).select("c"), "c").repartitionByRange(-(-wide // BLOCK), "c", "v")
        home = home.unionByName(large.select("v", "c", (F.spark_partition_id() + 1).alias("blk")))
    home = table(home, "home")
    shared = F.floor(F.col("asked") / (2 * steps.sparkSession.sparkContext.defaultParallelism))
    per = F.greatest(F.lit(1), F.least(F.greatest(F.lit(LEAST), shared), F.lit(SOURCES), F.floor(DISTANCES / F.least("nodes", F.lit(BLOCK)))))
    groups = table(asked.join(size, "c").select("source", "c", F.pmod(F.xxhash64("source"), F.ceil(F.col("asked") / per)).cast("int").alias("grp")), "groups")
    one, other = (home.select(F.col("v").alias(e), F.col("blk").alias(f"{e}blk"), *([F.col("c")] if e == "a" else [])) for e in "ab")
    placed = steps.join(one, "a").join(other, "b")
    inside = placed.where("ablk = bblk").select("c", F.col("ablk").alias("blk"), "a", "b", "length", F.lit(True).alias("inside"))
    if wide:
        leave = [placed.where("ablk <> bblk").select("c", F.col(f"{x}blk").alias("blk"), F.col(x).alias("a"), F.col(y).alias("b"), "length", F.lit(False).alias("inside")) for x, y in ("ab", "ba")]
        inside = inside.unionByName(leave[0]).unionByName(leave[1])
    inside = table(inside, "links")
    key = ["c", "blk", "grp"]
    came = groups.select("c", "grp", "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"))
    written: list[DataFrame] = []
    while True:
        inbox = table(came.join(home.select(F.col("v").alias("node"), "blk"), "node").select(*key, "source", "node", "dist", F.lit(False).alias("old")), "inbox")
        if written and inbox.isEmpty():
            break
        active = inbox.select(*[F.col(k).alias(k) for k in key]).distinct()
        rows = inbox.withColumn("wanted", F.lit(False))
        if wanted is not None and not wide:
            asks = wanted.join(groups, "source").select("c", F.lit(0).alias("blk"), "grp", "source", "node", F.lit(0.0).alias("dist"), F.lit(False).alias("old"), F.lit(True).alias("wanted"))
            rows = rows.join(wanted.select("source").distinct(), "source", "left_semi").select(*asks.columns).unionByName(asks)
        for known in written:
            rows = rows.unionByName(known.join(groups, "source").join(active, key, "left_semi").select(*key, "source", "node", "dist", F.lit(True).alias("old"), F.lit(False).alias("wanted")))
        rows = rows.groupBy(*key, "source", "node", "old", "wanted").agg(F.min("dist").alias("dist")) if written else rows
        n = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * steps.sparkSession.sparkContext.defaultParallelism)
        rows, ways = rows.repartition(n, *key), inside.join(active, ["c", "blk"]).repartition(n, *key)
        made = rows.groupBy(*key).cogroup(ways.groupBy(*key)).applyInArrow(partial(_walk, limit=limit), "blk int, source long, node long, dist double, beyond boolean")
        front = table(made, "paths")
        release(inbox)
        written.append(front)
        if not wide:
            break
        came = front.where("beyond").join(groups, "source").groupBy("c", "grp", "source", "node").agg(F.min("dist").alias("dist"))
        if len(written) > MERGE:  # rows that a shorter way has replaced are few until then
            whole = table(reduce(DataFrame.unionByName, written[:-1]).groupBy("blk", "source", "node", "beyond").agg(F.min("dist").alias("dist")), "paths")
            release(*written[:-1])
            written = [whole, front]
    found = reduce(DataFrame.unionByName, written).where("NOT beyond").select("source", "node", "dist")
    if wide:
        found = table(found.groupBy("source", "node").agg(F.min("dist").alias("dist")), "paths")
        release(*written)
        found = found if wanted is None else found.join(wanted, ["source", "node"], "left_semi")
    release(home, groups, inside)
    return found


def thinned(rows: DataFrame, near: DataFrame) -> DataFrame:
    """The rows (id, priority) that a walk from the best priority on keeps when it drops the neighbours of what it keeps.

    near(a, b) holds either direction. A round keeps the rows that are best among their undecided neighbours and drops
    those rows' neighbours, which gives exactly the walk's result. Ties of priority go to the smaller id.
    """
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = table(both, "near")
    undecided, kept = table(rows.select("id", "priority"), "undecided"), None
    while not undecided.isEmpty():
        ends = [undecided.select(F.col("id").alias(e), F.col("priority").alias(f"p{e}")) for e in "ab"]
        beaten = both.join(ends[0], "a").join(ends[1], "b").where("pb > pa OR (pb = pa AND b < a)").select(F.col("a").alias("id")).distinct()
        best = table(undecided.join(beaten, "id", "left_anti"), "best")
        kept = best if kept is None else kept.unionByName(best)
        gone = both.join(best.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).unionByName(best.select("id")).distinct()
        last, undecided = undecided, table(undecided.join(gone, "id", "left_anti"), "undecided")
        release(last)
    return rows.limit(0) if kept is None else rows.join(kept.select("id"), "id", "left_semi")


def thinned_points(rows: DataFrame, distance: float, per: tuple[str, ...] = ()) -> DataFrame:
    """The rows (id, x, y, priority) that a walk from the best priority on keeps when it drops all within `distance` of
    what it keeps: thinned(), without a table of pairs.

    Of rows at one place the best alone can be kept. Any two rows of a cell are within the distance, so a round asks only
    the best undecided row of each cell whether a better one is near, and each row meets the bests of 25 cells, however
    dense the rows are. Ties of priority go to the smaller id; a row without a place has no neighbours. per: columns in
    which neighbours are equal.
    """
    width = distance * 0.7
    placed = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    for c in per:
        placed &= F.col(c).isNotNull()
    cell = [*per, "bx", "by"]
    order = F.struct((-F.col("priority")).alias("p"), "id")
    own = rows.where(placed).groupBy(*per, "x", "y").agg(F.min(order).alias("o")).select("o", *per, "x", "y", F.floor(F.col("x") / width).alias("bx"), F.floor(F.col("y") / width).alias("by"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    near = F.sqrt(dx * dx + dy * dy) <= distance

    def around(some: DataFrame) -> DataFrame:
        spread = some.select(F.col("o").alias("co"), F.col("x").alias("cx"), F.col("y").alias("cy"), *cell, F.explode(steps).alias("s"))
        return spread.select("co", "cx", "cy", *per, (F.col("bx") + F.col("s.i")).alias("bx"), (F.col("by") + F.col("s.j")).alias("by"))

    undecided, kept = table(own, "undecided"), rows.where(~placed).select("id")
    while not undecided.isEmpty():
        bests = table(undecided.groupBy(*cell).agg(F.min(F.struct("o", "x", "y")).alias("c")).select("c.*", *cell), "bests")
        beaten = undecided.join(around(bests), cell).where(near & (F.col("o") < F.col("co"))).select(F.col("co").alias("o")).distinct()
        best = table(bests.join(beaten, "o", "left_anti"), "best")
        kept = kept.unionByName(best.select("o.id"))
        gone = undecided.join(around(best), cell).where(near).select("o").distinct()
        last, undecided = undecided, table(undecided.join(gone, "o", "left_anti"), "undecided")
        release(last, bests)
    return rows.join(kept, "id", "left_semi")


def cell_of(component: Column) -> tuple[Column, Column]:
    """Row and column of the cell that names a component of contiguous()."""
    return F.shiftright(component, 32), component.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)


def contiguous(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """row, col, component for cells(row, col): neighbours by edge, or corner too, share a component (its smallest id)."""
    # rows and columns are whole numbers of 32 bits
    ids = cells.select("row", "col", (F.col("row").cast("long") * (1 << 32) + F.col("col") + (1 << 31)).alias("id"))
    offsets = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    shifted = ids.withColumn("s", F.explode(steps)).select(F.col("id").alias("a"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    links = shifted.join(ids.withColumnRenamed("id", "b"), ["row", "col"]).select("a", "b")
    labels = components(links)
    return ids.join(labels, F.col("id") == F.col("v"), "left").select("row", "col", F.coalesce("c", "id").alias("component"))


def circuity(links: DataFrame, nodes: DataFrame, cities: DataFrame, snap: float, span: tuple[float, float], width: float, flag: float = 1.5) -> DataFrame:
    """a, b, straight, network, circuity, flagged for the pairs of cities(id, x, y) whose straight distance is in the span.

    A city joins the network at the nearest node of its largest component, at most `snap` away; others are left out. The
    way is both snaps and the shortest path, null beyond three times the span. nodes: node_id, x, y.
    """
    labels = table(components(links), "labels")
    main = labels.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(1)
    own = table(labels.join(F.broadcast(main.select("c")), "c").select("v", "c"), "labels")
    release(labels)
    there = nodes.join(own.select(F.col("v").alias("node_id")), "node_id", "left_semi")
    snapped = spatial.nearest(cities, there.select(F.col("node_id").alias("id"), "x", "y"), width, snap).where("target IS NOT NULL")
    snapped = table(snapped.select("id", F.col("target").alias("node"), F.col("dist").alias("off")), "snapped")
    joined = cities.join(snapped.select("id"), "id", "left_semi")
    pairs = spatial.pairs(joined, span[1], span[0]).withColumnsRenamed({"a": "id", "b": "other"})
    ends = [snapped.select(F.col("id").alias(i), F.col("node").alias(n), F.col("off").alias(o)) for i, n, o in (("id", "source", "oa"), ("other", "node", "ob"))]
    pairs = table(pairs.withColumnRenamed("dist", "straight").join(ends[0], "id").join(ends[1], "other"), "pairs")
    wanted, ways = pairs.select("source", "node"), links.join(own.select(F.col("v").alias("a")), "a", "left_semi")
    paths = shortest_paths(ways, wanted.select(F.col("source").alias("node_id")), 3 * span[1], wanted, own)
    ways = pairs.join(paths, ["source", "node"], "left")
    network = F.col("oa") + F.col("dist") + F.col("ob")
    ratio = network / F.col("straight")
    return ways.select(F.col("id").alias("a"), F.col("other").alias("b"), "straight", network.alias("network"), ratio.alias("circuity"), (ratio > flag).alias("flagged"))
