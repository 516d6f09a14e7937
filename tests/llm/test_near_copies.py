import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from runmerge.llm import grams, repeats, simhash


def plain(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b, similarity=0.8):
    return len(a & b) >= similarity * len(a | b) - 1e-9


def corpus(seed=5):
    """Texts with copies that have a repeated passage, some words changed, or are short; similarities on both sides of 0.8."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = words(rng.choice([8, 30, 120, 304, 700]))
        texts.append(base)
        texts.append(base + base[:24] * rng.choice([5, 10, 30]) if len(base) > 200 else base + words(1))
        changed = list(base)
        for i in rng.sample(range(len(base)), max(1, len(base) // rng.choice([25, 40, 45, 50, 60]))):
            changed[i] = "x" + changed[i]
        texts.append(changed)
    return [" ".join(t) for t in texts] + ["", "one", "One", "a b c d e f g h", "a b c d e f g h i"]


def test_word_grams_are_those_of_the_words():
    texts = [t.encode() for t in [*corpus(3), " a\t\x0bB  c\r\n", "\x1c a é", "\n", "x " * 9]]
    for width, lower in ((5, True), (3, False)):
        doc, word, h = grams.word_grams(texts, width, lower)
        of = {}
        for d, w, x in zip(doc.tolist(), word.tolist(), h.tolist(), strict=True):
            ws = (texts[d].lower() if lower else texts[d]).split()
            of.setdefault(tuple(ws[w : w + width]), set()).add(x)
        assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)
        assert sorted(zip(doc.tolist(), word.tolist(), strict=True)) == [(d, i) for d, t in enumerate(texts) for i in range(max(min(1, len(t.split())), len(t.split()) - width + 1))]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_repeated_entries_are_gathered(spark, monkeypatch, chunk):
    rng = random.Random(11)
    rows = [(k - 3, " ".join(rng.choice(["hot", rng.choice("abcdefgh") * rng.randint(1, 40)]) for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(10**12, None)]

    def entries(batch):
        for i, t in enumerate(batch.column("text")):
            ws = (t.as_py() or b"").split()
            yield np.full(len(ws), i), np.array([hash_of(w) for w in ws], np.uint64), np.arange(len(ws), dtype=np.uint32)
            yield np.array([i]), np.zeros(1, np.uint64), np.array([len(ws)], np.uint32) | repeats.GIVEN

    def finish(keys, hashes, values):
        return pa.table({"key": keys, "h": hashes.view(np.int64), "v": values.astype(np.int64)})

    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "RANGE", 4)
    df = spark.createDataFrame(rows, "key bigint, text string").select("key", F.col("text").cast("binary").alias("text")).repartition(5, "key")
    found = sorted((r["key"], r["v"]) for r in repeats.repeated(df, entries, finish, "key bigint, h bigint, v bigint", 500).collect())
    words = [(k, i, w) for k, t in rows for i, w in enumerate((t or "").split())]
    counts = Counter(w for _, _, w in words)
    assert 1 in counts.values() and max(counts.values()) > 20
    given = [(k, len((t or "").split()) + (1 << 31)) for k, t in rows]
    assert found == sorted([(k, i) for k, i, w in words if counts[w] > 1] + given)
    assert repeats.repeated(df.filter("false"), entries, finish, "key bigint, h bigint, v bigint", 500).collect() == []


def hash_of(word):
    return xxhash.xxh64_intdigest(word)


def test_near_copies_are_those_at_the_similarity_and_no_others(spark, tmp_path):
    texts = corpus(7)
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(enumerate(texts)), "k bigint, text string").coalesce(1).write.parquet(path)
    sets = [plain(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if least[i] != least[j] and alike(sets[i], sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    wanted = {i: v for i, v in enumerate(least) if v != i}
    for sizes in ({}, {"together": 500}):
        assert {r["u"]: r["v"] for r in simhash.near_copies(spark.read.parquet(path), "k", **sizes).collect()} == wanted
    close = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j]]
    assert any(0.8 <= x < 0.85 for x in close) and any(0.7 < x < 0.8 for x in close)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_near_copies_of_the_documents_against_brute_force(spark, sf):
    """Every pair of texts with a shingle in common, counted exactly; the links must be all those at 0.8 and no others."""
    from runmerge.llm.common import row_ids

    rows = row_ids(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).select("_row", "text")
    sets = {r["_row"]: plain(r["text"] or "") or {()} for r in rows.collect()}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    least = {k: k for k in sets}

    def find(k):
        while least[k] != k:
            least[k] = least[least[k]]
            k = least[k]
        return k

    common = Counter((a, b) for ks in holders.values() for i, a in enumerate(sorted(ks)) for b in sorted(ks)[i + 1 :])
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            a, b = sorted((find(a), find(b)))
            least[b] = a
    wanted = {k: find(k) for k in sets if find(k) != k}
    assert len(wanted) > 10
    assert {r["u"]: r["v"] for r in simhash.near_copies(rows, "_row").collect()} == wanted


def trees_of(monkeypatch):
    """What ``near_copies`` compares within, gathered as it runs."""
    seen, compare = [], simhash.linked_members
    monkeypatch.setattr(simhash, "linked_members", lambda members, *more: (seen.extend(members.collect()), compare(members, *more))[1])
    return seen


def test_shared_passages_do_not_link_the_table_to_one_tree(spark, monkeypatch):
    """Near copies in pairs, of which each quotes passages that many others quote: trees are the pairs, however many there are."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages, rows = [words(30) for _ in range(20)], []
    for i in range(300):
        text = words(80) + sum((rng.choice(passages) for _ in range(3)), [])
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, "tail"]))]
    seen = trees_of(monkeypatch)
    got = {r["u"]: r["v"] for r in simhash.near_copies(spark.createDataFrame(rows, "k bigint, text string"), "k").collect()}
    assert got == {2 * i + 1: 2 * i for i in range(300)}
    assert max(Counter(r["tree"] for r in seen).values()) == 2


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_counted_entries_carry_the_number_of_their_hash(spark, monkeypatch, chunk):
    words = {f"t{n}": n for n in (1, 2, 3, 16, 17, 60)}
    rows = [(k, " ".join(w for w, n in words.items() if k < n)) for k in range(60)]

    def entries(batch):
        for i, t in enumerate(batch.column("text")):
            ws = t.as_py().decode().split()
            yield np.full(len(ws), i), np.array([hash_of(w) for w in ws], np.uint64), np.zeros(len(ws), np.uint32)

    def finish(keys, hashes, values):
        return pa.table({"key": keys, "h": hashes.view(np.int64), "v": values.astype(np.int64)})

    monkeypatch.setattr(repeats, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "key bigint, text string").select("key", F.col("text").cast("binary").alias("text")).coalesce(1)
    found = repeats.repeated(df, entries, finish, "key bigint, h bigint, v bigint", 500, counted=True).collect()
    by_hash = {}
    for r in found:
        by_hash.setdefault(r["h"], []).append(r["v"])
    for w, n in words.items():
        values = by_hash.get(int(np.uint64(hash_of(w)).view(np.int64)), [])
        assert len(values) == (n if n > 1 else 0) and len(set(values)) <= 1
        if 1 < n <= repeats.OFTEN:
            assert values[0] == n
        if n > repeats.OFTEN and chunk > 1000:
            assert values[0] == repeats.COMMON


def test_a_cut_table_leaves_no_shuffle_files(spark):
    from runmerge.llm.common import cut

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    kept = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), free=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 7


def test_texts_that_fingerprints_link_are_compared_first(spark, monkeypatch):
    """Near copies go through the vantage-point trees of SimHash, whose groups deal them to parts; what they link is checked."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 400, 8)] + [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(df, "k").collect()}
    seen = trees_of(monkeypatch)
    got = {r["u"]: r["v"] for r in simhash.near_copies(df, "k", together=1500).collect()}
    assert got == {i: 0 for i in range(1, 50)}
    assert {r["key"] for r in seen} == set(range(50)) and all(r["near"] == groups[r["key"]] for r in seen)
    assert len({r["near"] for r in seen}) < 50


def test_known_groups_are_kept_and_grow():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 300, 10, 305, 900)]
    sizes = np.full(len(sets), 100)
    assert simhash.link_alike(sets, sizes, 0.8).tolist() == [0, 0, 2, 0, 2, 5]
    assert simhash.link_alike(sets, sizes, 0.8, np.array([0, 1, 0, 3, 4, 5])).tolist() == [0, 0, 0, 0, 0, 5]
    assert simhash.link_alike(sets, sizes, 0.8, np.array([0, 1, 2, 3, 4, 3])).tolist() == [0, 0, 2, 0, 2, 0]
