"""SimHash near-dedup with vantage-point trees.

Two fingerprints of 64 bits that differ in at most r bits differ in at most r // 2 bits in one of their halves.
So each half has a vantage-point tree of that smaller radius, under which far fewer searches cross a boundary.
The top of a tree, fitted to a bounded sample, deals all distinct fingerprints to shards: each is at home in one
leaf and visits every leaf that the triangle inequality cannot rule out. A shard goes on splitting by vantage
points of its own and compares what remains exactly, on all 64 bits. It yields a spanning forest of its links,
not all pairs; the forests are joined by connected components. Copies meet as one fingerprint beforehand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import components
from .grams import portions, word_grams
from .repeats import GIVEN, repeated

SEED = 42
HALVES = (0, 32)
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text's shingles of ``width`` words; 0 if there are none."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fp`` and ``_c0...`` (the ``carry`` columns) of each row."""
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"), F.col(id_col).alias("doc_id"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    schema = ", ".join(["fp bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((fingerprint(t.as_py() or b"", width) for t in batch.column(0)), pa.int64())
            yield pa.RecordBatch.from_arrays([found, *batch.columns[1:]], ["fp", *batch.schema.names[1:]])

    return rows.mapInArrow(apply, schema)


def half(fps: np.ndarray, shift: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def distances(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ values.dtype.type(vantage)).astype(np.int16)


def split_point(home: np.ndarray) -> tuple[int, int] | None:
    """A vantage point of ``home`` and the median distance from it; None if none of a few points splits it."""
    best = None
    for at in {0, len(home) // 3, 2 * len(home) // 3, len(home) - 1}:
        d = distances(home, int(home[at]))
        mu = int(np.median(d))
        inside = int((d <= mu).sum())
        if inside == len(home):
            mu -= 1
            inside = int((d <= mu).sum())
        smaller = min(inside, len(home) - inside)
        if smaller and (best is None or smaller > best[0]):
            best = (smaller, int(home[at]), mu)
    return best and best[1:]


def build(sample: np.ndarray, depth: int) -> list:
    """The tree of a sample of halves: ``[vantage, mu, inside, outside]``, or ``[]`` for a leaf."""
    found = split_point(sample) if depth and len(sample) >= 8 else None
    if not found:
        return []
    d = distances(sample, found[0])
    return [*found, build(sample[d <= found[1]], depth - 1), build(sample[d > found[1]], depth - 1)]


def descend(tree: list, values: np.ndarray, radius: int, rows: np.ndarray, home: np.ndarray, first: int = 0) -> tuple[list, int]:
    """``(leaf, rows, home)`` for each leaf that rows visit, and the number after the last leaf."""
    if not tree:
        return [(first, rows, home)], first + 1
    vantage, mu, inside, outside = tree
    d = distances(values[rows], vantage)
    near, far = d <= mu + radius, d > mu - radius
    a, after = descend(inside, values, radius, rows[near], home[near] & (d[near] <= mu), first)
    b, end = descend(outside, values, radius, rows[far], home[far] & (d[far] > mu), after)
    return a + b, end


def n_leaves(tree: list) -> int:
    return n_leaves(tree[2]) + n_leaves(tree[3]) if tree else 1


class Forest:
    """Disjoint sets over 0..n-1, with roots found for whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            above = self.parent[up]
            if np.array_equal(above, up):
                self.parent[at] = up
                return up
            up = above

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.roots(members))
        self.parent[roots] = roots[0]


def link(fps: np.ndarray, home: np.ndarray, shift: int, radius: int, small: int = 512) -> Forest:
    """Joins every two of ``fps``, one of them at home, that differ in at most ``radius`` bits and in at most ``radius // 2`` bits of the half at ``shift``."""
    values, reach, forest = half(fps, shift), radius // 2, Forest(len(fps))
    fps = fps.view(np.uint64)  # of a signed number, the bits of its absolute value would be counted
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        own, rows = stack.pop()
        if not len(own) or len(rows) < 2:
            continue
        found = split_point(values[own]) if len(own) > small else None
        if found:
            d_own, d_rows = distances(values[own], found[0]), distances(values[rows], found[0])
            stack.append((own[d_own <= found[1]], rows[d_rows <= found[1] + reach]))
            stack.append((own[d_own > found[1]], rows[d_rows > found[1] - reach]))
            continue
        theirs = fps[rows]
        for at in range(0, len(own), 64):
            block = own[at : at + 64]
            near = np.bitwise_count(fps[block][:, None] ^ theirs[None, :]) <= radius
            for k in np.flatnonzero(near.sum(axis=1) > 1):
                forest.join(rows[near[k]])
    return forest


def vantage_by_rule(leaf: int, path: int) -> int:
    return xxhash.xxh32_intdigest(path.to_bytes(8, "little") + leaf.to_bytes(4, "little"))


def deeper(leaf: int, levels: int, values: np.ndarray, radius: int, rows: np.ndarray, home: np.ndarray, path: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(path, rows, home)`` for each node that rows visit ``levels`` below a leaf, where vantage points follow from the path.

    Bits of fingerprints are nearly random, so about half of whatever is there lies within 16 bits of any point.
    """
    if not levels or not len(rows):
        yield path, rows, home
        return
    d = distances(values[rows], vantage_by_rule(leaf, path))
    near, far = d <= 16 + radius, d > 16 - radius
    yield from deeper(leaf, levels - 1, values, radius, rows[near], home[near] & (d[near] <= 16), 2 * path)
    yield from deeper(leaf, levels - 1, values, radius, rows[far], home[far] & (d[far] > 16), 2 * path + 1)


def deal(distinct: DataFrame, n: int, radius: int, shard: int, sample: int) -> tuple[DataFrame, int]:
    """``leaf, path, part, fp, home``: every fingerprint in the shards where it is at home and those it visits; and the first leaf of the second tree.

    The tops of the trees are fitted to ``sample`` fingerprints at most, spread by hash; every fingerprint is
    dealt. A leaf with more homes than a shard should have goes on by rule, as deep as its number of homes asks for, so what
    the driver knows of the tree doesn't grow with the data. A shard that is still crowded, as its halves are alike, is
    dealt to several parts, all of which get its visitors.
    """
    some = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64)
    depth = max(0, ceil(np.log2(max(1, n / shard))))
    trees = [build(half(some, s), depth) for s in HALVES]
    firsts = [0, n_leaves(trees[0])]
    levels: dict[int, int] = {}
    parts: dict[tuple[int, int], int] = {}

    def shards(fps: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for tree, s, first in zip(trees, HALVES, firsts, strict=True):
            values = half(fps, s)
            for leaf, rows, home in descend(tree, values, reach, np.arange(len(fps)), np.ones(len(fps), bool), first)[0]:
                for path, rows_, home_ in deeper(leaf, levels.get(leaf, 0), values, reach, rows, home):
                    if len(rows_):
                        yield leaf, path, rows_, home_

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(leaf, path, int(home.sum())) for leaf, path, _, home in shards(batch.column(0).to_numpy(), 0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["leaf", "path", "n"])

    counted = lambda: distinct.mapInArrow(homes, "leaf int, path bigint, n bigint").groupBy("leaf", "path").agg(F.sum("n").alias("n"))
    # a row for each leaf of the fitted tops at most
    levels |= {r["leaf"]: ceil(np.log2(r["n"] / shard)) for r in counted().filter(F.col("n") > 2 * shard).collect()}
    # none, unless very many different fingerprints have one half in common
    parts |= {(r["leaf"], r["path"]): ceil(r["n"] / (4 * shard)) for r in counted().filter(F.col("n") > 4 * shard).collect()} if levels else {}

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for leaf, path, rows, home in shards(fps, radius // 2):
                k = parts.get((leaf, path), 1)
                for p in range(k):
                    own = home & ((fps[rows].view(np.uint64) % np.uint64(k)) == p) if k > 1 else home
                    same = [pa.array(np.full(len(rows), x), kind) for x, kind in ((leaf, pa.int32()), (path, pa.int64()), (p, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(fps[rows]), pa.array(own)], ["leaf", "path", "part", "fp", "home"])

    return distinct.mapInArrow(dealt, "leaf int, path bigint, part int, fp bigint, home boolean"), firsts[1]


def near_links(distinct: DataFrame, n: int, radius: int, shard: int = 16384, sample: int = 16384) -> DataFrame:
    """Links ``u, v`` that connect whatever fingerprints in ``distinct`` (column ``fp``, ``n`` rows) are within ``radius`` bits.

    ``shard`` is about how many are at home in a shard, ``sample`` how many at most the tops of the trees are fitted to.
    """
    shards, second = deal(distinct, n, radius, shard, sample)

    def links(group: pa.Table) -> pa.Table:
        fps, home = group.column("fp").to_numpy(), group.column("home").to_numpy()
        shift = HALVES[int(group.column("leaf")[0].as_py() >= second)]
        roots = (forest := link(fps, home, shift, radius)).roots(np.arange(len(forest.parent)))
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"u": fps[linked], "v": fps[roots[linked]]})

    return shards.groupBy("leaf", "path", "part").applyInArrow(links, "u bigint, v bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id`` and the ``carry`` columns.

    A fingerprint has the majority bits of the XXH64 of the text's shingles, repeats included; a text of fewer
    than ``width`` words is one shingle, one without words (null, empty) has fingerprint zero, linked like any
    other. Fingerprints link at ``radius`` or fewer bits (below 4 the trees prune well; any radius is exact), and
    ``component_id`` is the smallest id reachable by links. Null ids are never smallest; a component of null ids
    only has a null one. Repeated rows are rows. An empty table gives none. Other columns are not read.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    rows = cut(fingerprints(docs, id_col, text_col, width, carry))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tree = components(near_links(distinct.select("fp"), distinct.count(), radius))
    linked = tree.unionByName(tree.select(F.col("v").alias("u"), "v").distinct())
    least = linked.join(distinct, F.col("u") == F.col("fp")).groupBy("v").agg(F.min("least").alias("reached"))
    reached = linked.join(least, "v").select(F.col("u").alias("fp"), "reached", F.lit(True).alias("linked"))
    # written once, so that the last join stands alone and Spark may split the partition of a fingerprint that many rows have
    label = cut(distinct.join(reached, "fp", "left").select(F.col("fp").alias("k"), F.when(F.col("linked"), F.col("reached")).otherwise(F.col("least")).alias("component_id")))
    return rows.join(label, F.col("fp") == F.col("k")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True))
    )


TOGETHER = 1 << 19  # shingles of a component's texts in a part, two of which may meet in a task


def distinct_shingles(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct shingles of texts as entries of value 0, and the number of each text's as a given entry.

    A text without words has the one shingle 0.
    """
    for first, some in portions(texts):
        doc, _, h = word_grams(some, width)
        blank = np.setdiff1d(np.arange(len(some)), doc)
        doc, h = np.append(doc, blank), np.append(h, np.zeros(len(blank), np.uint64))
        order = np.lexsort([h, doc])
        doc, h = doc[order], h[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
        doc, h = doc[new], h[new]
        yield first + doc, h, np.zeros(len(h), np.uint32)
        yield first + np.arange(len(some)), np.zeros(len(some), np.uint64), GIVEN | np.bincount(doc, minlength=len(some)).astype(np.uint32)


def prefixes(keys: np.ndarray, hashes: np.ndarray, values: np.ndarray, similarity: float) -> pa.Table:
    """The texts that may have a near copy, with their shared shingles, and what links them to others.

    Shingles are put in order by the number of texts that have them (``values``), then by hash: rare ones link few texts, while what many
    unrelated texts quote would link nearly all of a large table to one another. Two texts that are alike have a shingle in common among the first n - ceil(similarity n) + 1 of each. So a text with that many
    shingles of its own has no near copy; of the others, those with a shared shingle in these places are linked.
    ``key, n, hashes`` are rows of texts, ``key, other`` links between texts that have met here, ``hash, key`` one text for each hash.
    """
    given = values >= GIVEN
    order = np.lexsort([hashes, values, keys])  # what is given, of high value, comes last
    keys, hashes, values, given = keys[order], hashes[order], values[order], given[order]
    sizes = (values[given] & ~GIVEN).astype(np.int64)
    ends = np.flatnonzero(given)
    starts = np.append(0, ends[:-1] + 1)
    own = sizes - (ends - starts)
    need = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1 - own
    some = np.flatnonzero(need > 0)
    texts = [keys[ends[some]], sizes[some], [hashes[starts[i] : ends[i]].tobytes() for i in some]]
    owner = np.repeat(some, need[some])
    at = np.arange(len(owner)) - np.repeat(np.cumsum(need[some]) - need[some], need[some]) + starts[owner]
    order = np.lexsort([owner, hashes[at]])
    owner, h = owner[order], hashes[at][order]
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    forest = Forest(len(sizes))
    for a, b in np.unique(np.column_stack([owner[same - 1], owner[same]]), axis=0):
        forest.join(np.array([a, b]))
    roots = forest.roots(np.arange(len(sizes)))
    linked = np.flatnonzero(roots != np.arange(len(sizes)))
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    nulls = lambda n, kind: pa.nulls(n, kind)
    a, b, c = len(some), len(linked), len(heads)
    columns = [
        [pa.array(texts[0]), pa.array(keys[ends[linked]]), pa.array(keys[ends[owner[heads]]])],
        [pa.array(texts[1]), nulls(b + c, pa.int64())],
        [pa.array(texts[2], pa.binary()), nulls(b + c, pa.binary())],
        [nulls(a + b, pa.int64()), pa.array(h[heads].view(np.int64))],
        [nulls(a, pa.int64()), pa.array(keys[ends[roots[linked]]]), nulls(c, pa.int64())],
    ]
    return pa.table([pa.chunked_array(x) for x in columns], ["key", "n", "hashes", "hash", "other"]).combine_chunks()


def link_alike(sets: list[np.ndarray], sizes: np.ndarray, similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """For each set, the least of those that it is linked to by chains of sets that are alike, counted exactly.

    ``sets`` has the members that a set may share with others, ``sizes`` how many it has in all. Sets with the same number in
    ``known`` are linked already and are not compared with one another.
    """
    order = np.argsort(sizes, kind="stable")
    by_size = sizes[order]
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    of = np.split(numbers, np.cumsum([len(s) for s in sets])[:-1])
    mark, root, left = np.zeros(len(numbers) + 1, bool), np.arange(len(sets)), np.ones(len(sets), bool)
    tokens, starts = _laid_out([of[i] for i in order])
    group = np.arange(len(order)) if known is None else np.unique(known[order], return_inverse=True)[1]
    by_group = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by_group], np.arange(len(order) + 1))

    def also(at: np.ndarray) -> list[int]:
        """Places of the sets in the groups of those at ``at``, which are left no more."""
        found = np.concatenate([by_group[bounds[g] : bounds[g + 1]] for g in np.unique(group[at])])
        left[found] = False
        return found.tolist()

    for first in range(len(order)):
        if not left[first]:
            continue
        tree = also(np.array([first]))  # places in order; grows
        for me in tree:
            lo, hi = np.searchsorted(by_size, [by_size[me] * similarity - 1e-6, by_size[me] / similarity + 1e-6])
            at = lo + np.flatnonzero(left[lo:hi])
            if not len(at):
                continue
            mark[of[order[me]]] = True
            if 2 * len(at) > hi - lo:
                both = np.add.reduceat(np.append(mark[tokens[starts[lo] : starts[hi]]], False), starts[lo:hi] - starts[lo], dtype=np.int64)[at - lo]
            else:
                both = np.array([np.count_nonzero(mark[of[order[i]]]) for i in at])
            mark[of[order[me]]] = False
            alike = at[both >= similarity * (by_size[me] + by_size[at] - both) - 1e-9]
            if len(alike):
                tree += also(alike)
        root[order[tree]] = order[tree].min()
    return root


def _laid_out(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets' members one after another, and where each starts and the last ends."""
    return np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets)])


def near_copies(docs: DataFrame, key_col: str, text_col: str = "text", width: int = 5, similarity: float = 0.8, together: int = TOGETHER) -> DataFrame:
    """``u, v``: for each text that is a near copy but its group's first by key, its key and that first one.

    Near copies have ``similarity`` or more of their distinct shingles of ``width`` words in common; groups are
    closed under links. All texts go through ``simhash_groups``: those whose fingerprints its vantage-point trees link are compared
    first, by their shingles. A fingerprint of 64 bits can't tell all: at 0.8 it differs in ten bits or so, as many as
    vantage points can't prune. So there is an exact way for the rest, and no link is lost but by an equal 64-bit hash
    of different shingles: what is shared is found by ``repeated``; ``prefixes`` leaves the texts that can have a near copy
    and links them to components (trees) that have all members of a group; within them texts are compared by their shared
    shingles; a tree of more than ``together`` shingles is dealt to tasks in parts. Keys must be unique and
    not null. A null text counts as empty; empty texts are copies of one another.
    """
    rows = docs.select(F.col(key_col).cast("bigint").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    entries, finish = (lambda batch: distinct_shingles(batch.column("text"), width)), (lambda k, h, v: prefixes(k, h, v, similarity))
    with small_batches(docs.sparkSession):
        near = cut(simhash_groups(rows, "key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("near")), free=True)
        found = cut(repeated(rows, entries, finish, "key bigint, n bigint, hashes binary, hash bigint, other bigint", size // 6, counted=True), free=True)
    heads = found.filter("hash is not null").select("hash", "key")
    least = heads.groupBy("hash").agg(F.min("key").alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("hash").alias("h"), "v")
    links = heads.join(least, F.col("hash") == F.col("h")).select(F.col("key").alias("u"), "v")
    tree = components(links.unionByName(found.filter("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v"))))

    members = tree.select(F.col("u").alias("key"), F.col("v").alias("tree")).unionByName(tree.select(F.col("v").alias("key"), F.col("v").alias("tree")).distinct())
    sets = found.filter("hashes is not null").select("key", "n", "hashes")
    return linked_members(members.join(near, "key"), sets, similarity, together)


def linked_members(members: DataFrame, sets: DataFrame, similarity: float, together: int) -> DataFrame:
    """``u, v``: for each text but the first of its group, its key and the first one's, of ``members`` (``key, tree, near``) with ``sets`` (``key, n, hashes``).

    Texts of a tree are compared in parts of about ``together`` shingles: first those that fingerprints link (of one ``near``), which are
    dealt to one part unless they are too many, then all of the part. That is all for a tree of one part. In a larger one
    the first texts of the groups found so far are compared with one another, by pairs of parts; mostly that leaves one group.
    Where it doesn't, all texts outside a tree's largest group are compared with all its parts: what a tree of copies costs
    grows with its texts, not with their pairs.
    """

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys, near = group.column("key").to_numpy(), group.column("near").to_numpy()
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in group.column("hashes")]
        sizes, roots = group.column("n").to_numpy(), np.arange(len(keys))
        order = np.argsort(near, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            if len(some) > 1:
                roots[some] = some[link_alike([sets[i] for i in some], sizes[some], similarity)]
        roots = link_alike(sets, sizes, similarity, roots)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"u": keys[linked], "v": keys[roots[linked]]})

    def compared(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select("key", "near", "n", "hashes", "tree", *by).groupBy("tree", *by).applyInArrow(verify, "u bigint, v bigint")

    def parted(rows: DataFrame, part: str) -> DataFrame:
        """``rows`` (with ``bytes`` of their hashes) with a part for each, and how many parts its tree has."""
        n = lambda: F.ceil(F.sum("bytes") / (8 * together)).cast("int")
        number = rows.groupBy("tree").agg(n().alias(f"{part}s"))
        pieces = rows.groupBy("tree", "near").agg(n().alias("_pieces"))
        dealt = F.pmod(F.xxhash64("near", F.pmod(F.xxhash64("key"), F.col("_pieces"))), F.col(f"{part}s")).cast("int")
        return rows.join(number, "tree").join(pieces, ["tree", "near"]).withColumn(part, dealt).drop("_pieces")

    def grouped(links: DataFrame) -> DataFrame:
        return links.select(F.col("u").alias("key"), F.col("v").alias("first"))

    # parts are dealt without the hashes, which are shuffled to the keys and on to the parts only
    members = cut(parted(members.join(sets.select("key", "n", F.octet_length("hashes").alias("bytes")), "key"), "part"))
    whole = members.drop("n").join(sets, "key")
    links = cut(compared(whole, "part"), free=True)
    if members.filter("parts > 1").isEmpty():
        return links
    large = cut(whole.filter("parts > 1"), free=True)
    firsts = parted(large.drop("part", "parts").join(links.select(F.col("u").alias("key")), "key", "left_anti"), "i")
    # each part meets every other one, or itself if it is all
    pairs = firsts.withColumn("j", F.explode(F.expr("filter(sequence(0, `is` - 1), j -> `is` = 1 or j != i)")))
    pairs = pairs.withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j"))
    links = components(links.unionByName(compared(pairs, "a", "b")))
    of_group = cut(large.join(grouped(links), "key", "left").withColumn("first", F.coalesce("first", "key")))
    sizes = of_group.groupBy("tree", "first").agg(F.sum("n").alias("size"))
    largest = sizes.groupBy("tree").agg(F.max_by("first", F.struct("size", "first")).alias("largest"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("tree", "largest")
    outside = of_group.join(largest, "tree").filter("first != largest").select("key", "near", "tree", "n", "hashes", "bytes", "parts")
    if outside.isEmpty():
        return links
    outside = parted(outside, "piece").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = outside.select("tree", "pieces").distinct()
    inside = of_group.join(pieces, "tree").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    columns = ["key", "near", "n", "hashes", "tree", "part", "piece"]
    across = compared(inside.select(columns).unionByName(outside.select(columns)), "part", "piece")
    return components(links.unionByName(across))
