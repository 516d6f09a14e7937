"""Entries whose hash some other entry of the table has too, gathered by the row they come from.

An entry is a 64-bit hash with the key of its row and a value. Entries travel packed: a task sorts a chunk of them by
hash and sends one row for each range of hashes, as byte planes, which compress well. The range's task finds what is
there twice and sends it on, again packed, to where the entries of a row meet. A hash that is met twice within a
chunk is known to be repeated, so its entries go straight on and the range only gets a witness of it: a hash that a
third of all rows have reaches its range once for each chunk, not once for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 19  # entries that are sorted at a time
RANGE = 1 << 18  # entries of a range, about, and of the rows that are gathered together
GIVEN = np.uint32(1 << 31)  # set in the value of an entry that is passed on whether repeated or not
COMMON = np.uint32(1 << 30)  # the count of a hash that some chunk has more than OFTEN times
OFTEN = 16
_WITNESS = np.uint32(0xFFFFFFFF)
_COLUMNS = ("hashes", "keys", "values")
_KINDS = (np.dtype(np.uint64), np.dtype(np.int64), np.dtype(np.uint32))

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pack(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpack(parts: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    whole = [np.ascontiguousarray(np.frombuffer(p.as_py(), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel() for p in parts]
    return np.concatenate(whole) if whole else np.empty(0, kind)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in order: which are the first of equal ones, and how many equal ones each has, itself included."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    n = np.diff(np.append(np.flatnonzero(new), len(h)))
    return new, np.repeat(n, n)


def _dealt(entries: Entries, to: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """``to`` is in order: for each of its values the entries' three columns, packed."""
    if not len(to):
        return [], [[], [], []]
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(starts[1:], len(to))
    return to[starts].tolist(), [[_pack(x[a:b]) for a, b in zip(starts, ends, strict=True)] for x in entries]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _by_bucket(entries: Entries, n: int) -> tuple[list[int], list[list[bytes]]]:
    to = _bucket(entries[1], n)
    order = np.argsort(to, kind="stable")
    return _dealt(tuple(x[order] for x in entries), to[order])


def repeated(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterable[Entries]], finish: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, expected: int, counted: bool = False) -> DataFrame:
    """What ``finish`` makes of the repeated entries of ``rows``, whose first column is ``key bigint``.

    ``entries`` yields, for a batch of rows, arrays of place in the batch, hash and value (below 2^31, or with ``GIVEN``); a row
    may give a hash several times. ``finish`` gets keys, hashes and values of all repeated and given entries of
    some rows, all those of a row at once, in order of key and value. ``expected`` is the number of entries, about; it
    sets how many ranges there are.

    With ``counted``, the value of a repeated entry becomes the number of entries with its hash, the same for all of them: the
    exact one, or ``COMMON`` for a hash that any chunk has more than ``OFTEN`` times. Only such hashes then go straight on.
    """
    least = OFTEN if counted else 1
    bits = max(5, ceil(log2(max(1.0, expected / RANGE))))
    ranges = 1 << bits

    def send(held: list[Entries]) -> pa.RecordBatch:
        h, k, v = (np.concatenate(x) for x in zip(*held, strict=True))
        given = v >= GIVEN
        passed = [(x[given]) for x in (h, k, v)]
        h, k, v = (x[~given] for x in (h, k, v))
        order = np.argsort(h, kind="stable")
        h, k, v = h[order], k[order], v[order]
        new, n = _runs(h)
        known = n > least
        once, witness = ~known, np.flatnonzero(known & new)
        if counted:
            v = np.where(known, COMMON, v)
        k, v, passed = k.copy(), v.copy(), [np.concatenate([p, x[known]]) for p, x in zip(passed, (h, k, v), strict=True)]
        k[witness], v[witness], once[witness] = 0, _WITNESS, True
        to, packed = _dealt((h[once], k[once], v[once]), (h[once] >> np.uint64(64 - bits)).astype(np.int64))
        straight, more = _by_bucket(tuple(passed), ranges)
        return pa.RecordBatch.from_arrays([pa.array([*to, *(-1 - b for b in straight)], pa.int32()), *(pa.array(a + b, pa.binary()) for a, b in zip(packed, more, strict=True))], ["part", *_COLUMNS])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for doc, h, value in entries(batch):
                held.append((h, keys[doc], value.astype(np.uint32)))
                n += len(h)
                if n >= CHUNK:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def match(group: pa.Table) -> pa.Table:
        h, k, v = (_unpack(group.column(c), kind) for c, kind in zip(_COLUMNS, _KINDS, strict=True))
        part = group.column("part")[0].as_py()
        if part >= 0:
            order = np.argsort(h, kind="stable")
            h, k, v = h[order], k[order], v[order]
            new, n = _runs(h)
            if counted and len(h):
                common = np.repeat(np.logical_or.reduceat(v == _WITNESS, np.flatnonzero(new)), n[new])
                counts = np.where(common, COMMON, np.minimum(n, COMMON - 1)).astype(np.uint32)
                v = np.where(v == _WITNESS, v, counts)
            found = (n > 1) & (v != _WITNESS)
            h, k, v = h[found], k[found], v[found]
        to, packed = _by_bucket((h, k, v), ranges)
        return pa.table([pa.array(to, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", *_COLUMNS])

    def gather(group: pa.Table) -> pa.Table:
        h, k, v = (_unpack(group.column(c), kind) for c, kind in zip(_COLUMNS, _KINDS, strict=True))
        order = np.lexsort([v, k])
        return finish(k[order], h[order], v[order])

    packed = "hashes binary, keys binary, values binary"
    found = rows.mapInArrow(spread, f"part int, {packed}").groupBy("part").applyInArrow(match, f"bucket int, {packed}")
    return found.groupBy("bucket").applyInArrow(gather, schema)
