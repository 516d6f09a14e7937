"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, by external induced sorting.

Sorting all suffixes of a corpus is not needed to find its repeats of N bytes: each such string holds an anchor
(``anchors``), a K-byte string that is marked wherever the string stands. Suffixes that start at anchors are the
seeds. Anchors that occur once drop out (``repeats``). Of the others, the seeds are sorted by Spark's external sort,
anchor first, then what follows. All longer suffixes are induced from them: the suffixes that start l bytes before
an anchor have the order of the byte at which they start and, among equal bytes, of the suffix one byte
shorter, which is already sorted. So each level of the recursion takes its suffixes in order from a priority queue and puts them,
one byte longer, in the next one, up to all N - K bytes before the anchors. With each suffix goes its common prefix
with its predecessor: one more than the least value between their shorter suffixes. Neighbours with N bytes or
more in common are repeats. Queues, and the seeds of an anchor that has very many, are on disk above a bound of
memory; equal surroundings meet as one seed with a count.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NONE, anchors, least_in_windows
from .common import row_ids
from .grams import portions, word_grams
from .repeats import repeated

LENGTH = 400
WINDOW = 96  # windows of consecutive K-byte strings in which one is an anchor; K = length - WINDOW + 1
SMALL = 20_000  # seeds that are induced together
MET = 50_000  # different surroundings that a task counts before it passes them on
HELD = 1_000_000  # entries of a queue, and seeds, that are held in memory
PASSAGE = 51  # words of a passage that is reported where it repeats in another text
MARKS = 17  # windows of word grams in which one is a mark, which has PASSAGE - MARKS + 1 words
CHAINED = 120  # words of a chain of repeated marks in which one window a mark is compared, not all
WORD = np.uint32(1 << 30)  # set in the place of a word mark

SUFFIX = np.dtype([("bucket", np.int64), ("seed", np.int64), ("common", np.int32)])


class SuffixQueue:
    """A priority queue of suffixes by bucket and then entry, on disk above ``limit`` of them.

    Suffixes come in arrays. What is over the limit is sorted and written as a run; runs are merged when the queue is emptied.
    """

    def __init__(self, limit: int):
        self.limit, self.held, self.memory = limit, 0, []
        self.runs: list[tuple[int, object]] = []

    def push(self, suffixes: np.ndarray) -> None:
        self.memory.append(suffixes)
        self.held += len(suffixes)
        if self.held > self.limit:
            run = tempfile.TemporaryFile()
            self._sorted().tofile(run)
            self.runs.append((self.held, run))
            self.held, self.memory = 0, []

    def _sorted(self) -> np.ndarray:
        whole = np.concatenate(self.memory) if self.memory else np.empty(0, SUFFIX)
        return whole[np.argsort(whole["bucket"], kind="stable")]

    def pop(self, chunk: int) -> Iterator[np.ndarray]:
        """All suffixes in order, in arrays."""
        last = self._sorted()
        if not self.runs:
            yield from (last[i : i + chunk] for i in range(0, len(last), chunk))
            return
        readers = [_Reader(n, run, chunk) for n, run in self.runs] + [_Reader(0, None, chunk, last)]
        while some := [r for r in readers if len(r.block)]:
            bucket = min(int(r.block["bucket"][0]) for r in some)
            for r in some:
                yield from r.take(bucket)


class _Reader:
    """A sorted run, read by blocks."""

    def __init__(self, n: int, run, chunk: int, block: np.ndarray | None = None):
        self.run, self.chunk, self.block = run, chunk, block
        if block is None:
            run.seek(0)
            self.block = np.fromfile(run, SUFFIX, chunk)

    def take(self, bucket: int) -> Iterator[np.ndarray]:
        while len(self.block) and self.block["bucket"][0] == bucket:
            n = int(np.searchsorted(self.block["bucket"], bucket, "right"))
            yield self.block[:n]
            self.block = self.block[n:]
            if not len(self.block) and self.run:
                self.block = np.fromfile(self.run, SUFFIX, self.chunk)


def seed_type(width: int) -> np.dtype:
    """What stands before (last byte first) and after an anchor, how long both are, how often they occur, and their name."""
    side = (np.uint8, (width,))
    return np.dtype([("group", np.int64), ("n", np.int64), ("id1", np.int64), ("id2", np.int64), ("before", *side), ("n_before", np.int16), ("after", *side), ("n_after", np.int16)])


class Seeds:
    """Seeds in the order they come, on disk above ``limit`` of them."""

    def __init__(self, width: int, limit: int):
        self.kind, self.limit, self.n, self.memory, self.file = seed_type(width), limit, 0, [], None

    def add(self, seeds: np.ndarray) -> None:
        self.memory.append(seeds)
        self.n += len(seeds)
        if self.file or self.n > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.memory:
                part.tofile(self.file)
            self.memory = []

    def all(self) -> np.ndarray:
        if not self.file:
            return np.concatenate(self.memory)
        self.file.flush()
        return np.memmap(self.file, self.kind, "r")


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of at most ``width`` bytes as rows, and their lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), width), np.uint8)
    out[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, lengths


def make_seeds(group: np.ndarray, left: list[bytes], right: list[bytes], n: np.ndarray, width: int, id1=0, id2=0) -> np.ndarray:
    out = np.empty(len(group), seed_type(width))
    out["group"], out["n"], out["id1"], out["id2"] = group, n, id1, id2
    out["before"], out["n_before"] = _matrix([x[::-1] for x in left], width)
    out["after"], out["n_after"] = _matrix(right, width)
    return out


def seed_level(seeds: np.ndarray, k: int, chunk: int) -> Iterator[np.ndarray]:
    """The suffixes that start at the anchors, which come sorted by group and what follows, with their common prefixes."""
    for a in range(0, len(seeds), chunk):
        some = seeds[max(0, a - 1) : a + chunk]
        out = np.empty(len(some), SUFFIX)
        out["bucket"], out["seed"], out["common"] = some["group"], np.arange(max(0, a - 1), max(0, a - 1) + len(some)), 0
        if len(some) > 1:
            width = some["after"].shape[1]
            shorter = np.minimum(some["n_after"][1:], some["n_after"][:-1])
            equal = (some["after"][1:] == some["after"][:-1]) & (np.arange(width) < shorter[:, None])
            run = np.where(equal.all(axis=1), width, (~equal).argmax(axis=1))
            out["common"][1:] = np.where(some["group"][1:] == some["group"][:-1], k + run, 0)
        yield out[1:] if a else out


def longer(level: Iterable[np.ndarray], seeds: np.ndarray, at: int) -> Iterator[np.ndarray]:
    """The suffixes one byte longer, in the order of the shorter ones: bucket of group and new byte, and common prefix.

    That is with the one before in the same bucket: one more than the least of the shorter suffixes' from there on. ``least`` keeps
    it for each byte where an array of suffixes ends within a group.
    """
    none = 1 << 30
    least, open_group = np.full(256, -1, np.int64), None
    for part in level:
        own = seeds[part["seed"]]
        group, common = own["group"], part["common"].astype(np.int64)
        there = np.flatnonzero(own["n_before"] > at)
        byte = own["before"][:, at].astype(np.int64)
        bucket = group << 8 | byte
        moved = there[np.argsort(bucket[there], kind="stable")]
        reach = np.full(len(part), -1, np.int64)
        first = np.ones(len(moved), bool)
        first[1:] = bucket[moved[1:]] != bucket[moved[:-1]]
        again = np.flatnonzero(~first)
        if len(again):
            ends = np.column_stack([moved[again - 1] + 1, moved[again] + 1]).ravel()
            reach[moved[again]] = np.minimum.reduceat(np.append(common, 0), ends)[::2]
        for i in moved[first & (group[moved] == open_group) & (least[byte[moved]] >= 0)] if open_group is not None else ():
            reach[i] = min(least[byte[i]], int(common[: i + 1].min()))
        if group[-1] == open_group:
            least = np.where(least >= 0, np.minimum(least, common.min()), -1)
        else:
            least, open_group = np.full(256, -1, np.int64), int(group[-1])
        ahead = np.append(np.minimum.accumulate(common[::-1])[::-1], none)  # the least from each place on
        of_last = there[group[there] == open_group]
        least[byte[of_last]] = -1
        np.maximum.at(least, byte[of_last], of_last)  # the last place of each byte, for now
        seen = np.unique(byte[of_last])
        least[seen] = ahead[least[seen] + 1]
        out = np.empty(len(there), SUFFIX)
        out["bucket"], out["seed"], out["common"] = bucket[there], part["seed"][there], reach[there] + 1
        yield out


def induce(seeds: np.ndarray, k: int, length: int, limit: int = HELD, chunk: int = 1 << 16) -> np.ndarray:
    """For each seed, which suffixes l = 0.. bytes before it start a string of ``length`` bytes that occurs twice.

    Seeds come sorted by group and what follows the anchor. Level by level suffixes pass through a queue.
    """
    width = length - k
    found = np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(len(seeds), width + 1)) if len(seeds) > limit else np.zeros((len(seeds), width + 1), bool)
    level = seed_level(seeds, k, chunk)
    for at in range(width + 1):
        queue, last = SuffixQueue(limit), np.full(1, -1, np.int64)

        def noted(level: Iterable[np.ndarray], at: int) -> Iterator[np.ndarray]:
            nonlocal last
            for part in level:
                alike = np.flatnonzero(part["common"] >= length)
                before = np.append(last, part["seed"][:-1])
                found[part["seed"][alike], at] = True
                found[before[alike], at] = True
                last = part["seed"][-1:]
                yield part

        if at < width:
            for part in longer(noted(level, at), seeds, at):
                if len(part):
                    queue.push(part)
            level = queue.pop(chunk)
        else:
            for _ in noted(level, at):
                pass
    for a in range(0, len(seeds), chunk):
        some = seeds[a : a + chunk]
        spans = np.arange(width + 1)
        found[a : a + chunk] |= (some["n"] > 1)[:, None] & (some["n_before"][:, None] >= spans) & (some["n_after"][:, None] >= width - spans)
    return found


def marked(texts: pa.Array, k: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, and the marks of passages, of texts: place of the text, hash, and place in bytes, or in words with ``WORD`` set."""
    for first, some in portions(texts):
        long = [t if len(t) >= length else b"" for t in some]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in long])])
        at, h = anchors(np.frombuffer(b"".join(long), np.uint8), starts[:-1], k, WINDOW)
        doc = np.searchsorted(starts, at, "right") - 1
        yield first + doc, h & ~np.uint64(1), (at - starts[doc]).astype(np.uint32)
        doc, word, h = word_grams(some, PASSAGE - MARKS + 1, lower=False)
        enough = np.bincount(doc, minlength=len(some))[doc] >= MARKS  # texts of PASSAGE words
        doc, word, h = doc[enough], word[enough], h[enough]
        new = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        at = least_in_windows(np.insert(h, new, NONE), MARKS)  # windows over the gap between two texts only add marks
        at -= np.searchsorted(new + np.arange(len(new)), at)
        at = at[np.lexsort([word[at], h[at], doc[at]])]
        once = np.ones(len(at), bool)  # for each text
        once[1:] = (doc[at][1:] != doc[at][:-1]) | (h[at][1:] != h[at][:-1])
        at = at[once]
        yield first + doc[at], h[at] | np.uint64(1), word[at].astype(np.uint32) | WORD


def _lists(keys: np.ndarray, which: np.ndarray, values: list[np.ndarray], of: np.ndarray) -> list[pa.Array]:
    """For each key in ``of``, the list of its values where ``which``; keys are in order."""
    keys = keys[which]
    offsets = pa.array(np.append(np.searchsorted(keys, of, "left"), len(keys)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v[which])) for v in values]


def places_of(keys: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> pa.Table:
    """``row, at, anchor, words``: the places and hashes of a text's repeated anchors, and the words at its repeated marks."""
    word = (values & WORD) > 0
    rows = np.unique(keys)
    at, anchor = _lists(keys, ~word, [values.astype(np.int32), hashes.view(np.int64)], rows)
    (words,) = _lists(keys, word, [(values & ~WORD).astype(np.int32)], rows)
    return pa.table([pa.array(rows), at, anchor, words], ["row", "at", "anchor", "words"])


def windows_to_compare(words: np.ndarray) -> np.ndarray:
    """Starts of the windows of ``PASSAGE`` words that are compared to know whether repeated marks (in order) belong to a repeated passage.

    A passage of that length holds a mark. Of a mark that stands alone, or in a chain of few, all windows that hold it are
    taken; in a longer chain of marks, which lies in a long passage, the one around each.
    """
    gram = PASSAGE - MARKS + 1
    chain = np.cumsum(np.append(0, np.diff(words) > MARKS))
    first, last = np.searchsorted(chain, chain, "left"), np.searchsorted(chain, chain, "right") - 1
    long = words[last] - words[first] + gram >= CHAINED
    every = (words[~long][:, None] - np.arange(MARKS)).ravel()
    return np.unique(np.concatenate([every, words[long] - MARKS // 2]))


def compared(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows that are compared of each text in a batch (``text, words``): place in the batch, and hash."""
    for i, (text, words) in enumerate(zip(batch.column("text"), batch.column("words"), strict=True)):
        if len(words.values):
            _, _, h = word_grams([text.as_py()], PASSAGE, lower=False)
            at = windows_to_compare(words.values.to_numpy())
            h = np.unique(h[at[(at >= 0) & (at < len(h))]])
            yield np.full(len(h), i), h, np.zeros(len(h), np.uint32)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, text`` (bytes), ``spans`` (array of start and end), ``kept`` (bytes) and ``repeats_passage``.

    ``spans`` are the maximal runs of bytes covered by a string of ``length`` bytes that also starts anywhere else,
    in the same text (overlaps count) or another; ``kept`` is the rest. ``repeats_passage`` says whether a passage of ``PASSAGE``
    or more words between white space, however many bytes that are, stands in another row too. Matches never cross texts and are judged on
    the input. A null text counts as empty; repeated rows repeat each other; null ids are kept; an empty table
    gives none. Other columns are not read. ``length`` must be above 96. ``docs`` must be a file scan, or what
    else numbers its rows alike when computed again.
    """
    k = length - WINDOW + 1
    width = length - k
    rows = row_ids(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text")), "row")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    places = repeated(
        rows.select(F.col("row").alias("key"), "text"), lambda batch: marked(batch.column("text"), k, length), places_of, "row bigint, at array<int>, anchor array<bigint>, words array<int>", size // 25
    )

    def contexts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """Row, place, anchor and what stands before and after it, of each anchor in a batch of joined rows.

        From here on an anchor goes by another hash of its bytes.
        """
        for row, text, ats in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("at"), strict=True):
            text = text.as_py()
            for at in ats.values.to_pylist():
                yield row, at, xxhash.xxh3_64_intdigest(text[at : at + k]) - (1 << 63), text[max(0, at - width) : at], text[at + k : at + length]

    def surround(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = contexts(batch)
            while some := list(islice(found, 20_000)):
                rows_, at, anchor, left, right = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.int64()), pa.array(at, pa.int32()), pa.array(anchor, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["row", "at", "anchor", "left", "right"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Surroundings and how often they were met, so that frequent ones leave a task as few rows."""
        met: Counter = Counter()

        def rows_of() -> pa.RecordBatch:
            anchor, left, right = zip(*met, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(list(met.values()), pa.int64())], ["anchor", "left", "right", "n"])

        for batch in batches:
            for _, _, anchor, left, right in contexts(batch):
                met[anchor, left, right] += 1
                if len(met) >= MET:
                    yield rows_of()
                    met.clear()
        if met:
            yield rows_of()

    # with the same columns in all, one shuffle of the texts serves all uses of this join and the last one
    joined = rows.join(places.drop("anchor"), "row").select("row", "doc_id", "text", "at", "words")
    seen = joined.mapInArrow(surround, "row bigint, at int, anchor bigint, left binary, right binary")
    identity = [F.xxhash64("anchor", "left", F.lit(0), "right").alias("id1"), F.xxhash64("right", F.lit(1), "left", "anchor").alias("id2")]
    # one shuffle by anchor serves the sum over equal surroundings and the sort
    counted = joined.mapInArrow(count, "anchor bigint, left binary, right binary, n bigint").repartition("anchor")
    seeds = counted.groupBy("anchor", "left", "right").agg(F.sum("n").alias("n")).sortWithinPartitions("anchor", "right").select("anchor", "left", "right", "n", *identity)

    def induced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = Seeds(width, HELD), (0, 0)  # the last anchor and its number

        def flush() -> Iterator[pa.RecordBatch]:
            every = held.all()
            found = induce(every, k, length)
            for a in range(0, len(every), SMALL):
                some = a + np.flatnonzero(found[a : a + SMALL].any(axis=1))
                masks = np.packbits(found[some], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(every["id1"][some]), pa.array(every["id2"][some]), pa.array([m.tobytes() for m in masks], pa.binary())], ["id1", "id2", "mask"])

        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            if not len(anchor):
                continue
            number = last[1] + np.cumsum(np.append(anchor[0] != last[0], anchor[1:] != anchor[:-1]))
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            new = make_seeds(number, left, right, batch.column("n").to_numpy(), width, batch.column("id1").to_numpy(), batch.column("id2").to_numpy())
            cut = int(np.searchsorted(number, number[-1]))  # the last anchor may go on
            if held.n + cut >= SMALL and (cut or number[0] != last[1]):
                held.add(new[:cut])
                yield from flush()
                held, new = Seeds(width, HELD), new[cut:]
            held.add(new)
            last = (int(anchor[-1]), int(number[-1]))
        if held.n:
            yield from flush()

    masks = seeds.mapInArrow(induced, "id1 bigint, id2 bigint, mask binary")
    covered = seen.select("row", "at", *identity).join(masks, ["id1", "id2"]).groupBy("row").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    passages = repeated(joined.withColumnRenamed("row", "key"), compared, lambda keys, _, __: pa.table({"passage": np.unique(keys)}), "passage bigint", size // 60)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for i in range(batch.num_rows):
                text, marks = batch.column("text")[i].as_py(), batch.column("marks")[i]
                found = []
                if marks.is_valid and len(marks.values):
                    at = marks.values.field("at").to_numpy(zero_copy_only=False)
                    bits = np.unpackbits(np.frombuffer(b"".join(marks.values.field("mask").to_pylist()), np.uint8).reshape(len(at), -1), axis=1)
                    which, before = np.nonzero(bits)
                    starts = np.unique(at[which] - before)
                    cuts = np.flatnonzero(np.diff(starts) > length)
                    found = list(zip(starts[np.append(0, cuts + 1)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + length).tolist(), strict=True))
                spans.append([{"start": a, "end": b} for a, b in found])
                ends = [0, *(b for _, b in found)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in found), len(text)], strict=True)))
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), spans, pa.array(kept, pa.binary()), batch.column("repeats_passage")], ["doc_id", "text", "spans", "kept", "repeats_passage"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked_rows = rows.join(covered, "row", "left").join(passages, F.col("row") == F.col("passage"), "left").select("doc_id", "text", "marks", F.col("passage").isNotNull().alias("repeats_passage"))
    return marked_rows.mapInArrow(remove, f"doc_id {kind}, text binary, spans array<struct<start:bigint,end:bigint>>, kept binary, repeats_passage boolean")
