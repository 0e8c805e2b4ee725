"""Which keys do several owners hold? Told by one shuffle by key that a hot key can't fill.

Owners (sets, documents) give their different keys. Keys that several owners of one batch hold are known to be shared
at once: one row a batch goes to the shuffle to tell the others. So a key gives one row a batch at most, and the
reading side needs no group: rows in the order of their key are read as a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeframe.llm import tokens

#: Gives (owner, its different keys) for the rows of a batch.
Keys = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]

_TESTS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("m", pa.int32())])


def _tests(batches: Iterable[pa.RecordBatch], keys_of: Keys, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, m). m = 0: a key that one owner of the batch has; m = -1: one that several have, once.

    m > 0 are answers by now: the owner's number of shared keys or, with `whole`, each owner and key.
    """
    for batch in batches:
        made = [(i, x) for i, x in keys_of(batch) if len(x)]
        if not made:
            continue
        keys = np.concatenate([x for _, x in made])
        ids = np.repeat(np.array([i for i, _ in made], np.int64), [len(x) for _, x in made])
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        alone = first & np.r_[first[1:], True]
        lead = first & ~alone
        rows = [{"key": keys[alone], "id": ids[alone], "m": np.zeros(alone.sum(), np.int32)}, {"key": keys[lead], "id": ids[lead], "m": np.full(lead.sum(), -1, np.int32)}]
        if whole:
            rows.append({"key": keys[~alone], "id": ids[~alone], "m": np.ones((~alone).sum(), np.int32)})
        else:
            who, m = np.unique(ids[~alone], return_counts=True)
            rows.append({"key": tokens.mix(who.view(np.uint64)), "id": who, "m": m.astype(np.int32)})
        yield from tokens.rows_of(rows, _TESTS)


def _answers(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key and m: (key, id) of shared keys, or (id, m) of owners and their number of them."""
    last_key, open_row = None, None  # the key of the test before, and that row if nobody else has its key by now
    for batch in batches:
        key, ids, m = (batch.column(i).to_numpy() for i in range(3))
        sure = m > 0
        out = [(key[sure], ids[sure], m[sure].astype(np.int64))]
        k, i, told = key[~sure], ids[~sure], m[~sure] < 0
        if len(k):
            same = np.r_[k[0] == last_key if last_key is not None else False, k[1:] == k[:-1]]
            run = np.cumsum(~same)
            shared = (np.bincount(run) > 1) | (np.bincount(run, told) > 0)
            if same[0]:
                shared[0] = True
                if open_row is not None:
                    out.append(tuple(np.array([x], np.int64) for x in open_row))
            take = shared[run] & ~told
            out.append((k[take], i[take], np.ones(take.sum(), np.int64)))
            last_key = k[-1]
            open_row = None if shared[run[-1]] else (k[-1], i[-1], 1)
        key, ids, m = (np.concatenate(x) for x in zip(*out, strict=True))
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "id"])
        else:
            ids, back = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(back, m, len(ids)).astype(np.int64))], names=["id", "m"])


def shared_keys(rows: DataFrame, keys_of: Keys) -> DataFrame:
    """key, id: the keys of rows' owners that another owner has as well."""
    return _met(rows, keys_of, True).mapInArrow(partial(_answers, whole=True), "key long, id long")


def shared_counts(rows: DataFrame, keys_of: Keys) -> DataFrame:
    """id, m: how many of an owner's keys another owner has as well; m is to be summed by id."""
    return _met(rows, keys_of, False).mapInArrow(partial(_answers, whole=False), "id long, m long")


def _met(rows: DataFrame, keys_of: Keys, whole: bool) -> DataFrame:
    tests = rows.mapInArrow(partial(_tests, keys_of=keys_of, whole=whole), "key long, id long, m int")
    # answers go anywhere, so that no task gets all of a hot key
    place = F.when(F.col("m") > 0, F.xxhash64("key", "id")).otherwise(F.xxhash64("key"))
    return tests.repartition(place).sortWithinPartitions("key", "m")
