"""General interfaces: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from runmerge.llm import bpe, chat, components, exact_dedup, licenses, mixing, quality, rules, simhash, stats, suffix_dedup, toxicity
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, score double, kept string, _row string, fp string, size string, row string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ROWS = [
    (1, "a b c", "en", "s", 5), (2, "a  b\tc", "en", "s", 6), (2, "a  b\tc", "en", "s", 6), (None, "a b c", None, None, None), (3, None, "en", "t", 0),
    (4, "", None, "t", 0), (5, " \n\t ", "de", None, 4), (6, LONG, "en", "s", len(LONG)), (7, LONG + " end", "en", "s", 0), (8, "\x1c é 日本 <|endoftext|> 😀", "fr", "u", 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [r + ("d", 1.0, "k", "x", "f", "z", "w") for r in ROWS]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


LABELS = "doc_id bigint, quality int, toxic int"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def every_operator(spark):
    none = spark.createDataFrame([(None, 1, None)], LABELS)
    return {
        "suffix": suffix_dedup.repeated_spans,
        "bpe": lambda d: bpe.encode_documents(d, TOKENS),
        "licenses": licenses.scan_licenses,
        "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit(d, none)),
        "exact": exact_dedup.exact_dedup,
        "quality": lambda d: quality.score_documents(d, quality.fit(d, none)),
        "simhash": simhash.simhash_groups,
        "rules": rules.quality_rules,
        "mixing": mixing.mix_sources,
    }


@pytest.fixture(scope="module")
def of_odd(spark, odd):
    return {name: f(odd).collect() for name, f in every_operator(spark).items()}


@pytest.mark.parametrize("name", ["suffix", "bpe", "licenses", "toxicity", "exact", "quality", "simhash", "rules", "mixing"])
def test_odd_rows_and_empty_tables(spark, of_odd, empty, name):
    assert sorted(r["doc_id"] or -1 for r in of_odd[name]) == sorted(r[0] or -1 for r in ROWS)
    assert every_operator(spark)[name](empty).collect() == []


def test_values_of_odd_rows(of_odd):
    """What each operator says of null, empty and blank texts, repeated rows and very long texts."""
    got = {name: {r["doc_id"]: r for r in rows} for name, rows in of_odd.items()}
    words = {1: 3, 2: 3, None: 3, 3: 0, 4: 0, 5: 0, 6: 20_000, 7: 20_001}
    assert {d: got["licenses"][d]["n_words"] for d in words} == {d: got["rules"][d]["n_words"] for d in words} == {d: got["mixing"][d]["size"] for d in words} == words
    assert all(got["rules"][d]["base_failed"] and not got["rules"][d]["kept"] for d in (None, 1, 2, 3, 4, 5, 8)) and got["rules"][6]["kept"]
    assert [got["bpe"][d]["n_tokens"] for d in (3, 4, 5, 1, 2, None)] == [0, 0, 0, 3, 3, 3] and got["bpe"][3]["ids"] == got["bpe"][5]["decoded"] == ""
    assert {got["simhash"][d]["fingerprint"] for d in (3, 4, 5)} == {"0" * 16} and {got["simhash"][d]["component_id"] for d in (3, 4, 5)} == {3}
    assert {got["simhash"][d]["component_id"] for d in (1, 2, None)} == {1}
    size = len(LONG.encode())
    assert [[tuple(s) for s in got["suffix"][d]["spans"]] for d in (6, 7, 1, 3)] == [[(0, size)], [(0, size)], [], []]
    assert bytes(got["suffix"][7]["kept"]) == b" end" and [got["suffix"][d]["repeats_passage"] for d in (6, 7, 1, 3)] == [True, True, False, False]
    assert len({got["toxicity"][d]["score"] for d in (3, 4, 5)}) == 1 and got["toxicity"][1]["predicted"] == 0
    assert len({got["quality"][d]["score"] for d in (3, 4)}) == 1
    empty_size = {d: got["mixing"][d]["taken"] for d in (3, 4, 5)}
    assert empty_size == {3: 0, 4: 0, 5: 0} and all(r["taken"] <= 3 * r["size"] for r in got["mixing"].values())


def test_exact_dedup_of_odd_rows(odd):
    rows = exact_dedup.exact_dedup(odd, k=2, carry=["kept"]).select("doc_id", "keep_id", "group_size").collect()
    groups = sorted((r["keep_id"], r["group_size"]) for r in rows)
    assert groups == [(1, 4)] * 4 + [(3, 2)] * 2 + [(5, 1), (6, 1), (7, 1), (8, 1)]
    tied = [(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_dedup(odd.filter("doc_id = 2")).select("doc_id", "keep_id", F.col("group_size")).collect()]
    assert tied == [(2, 2), (2, 2)] and exact_dedup.exact_dedup(odd.filter("doc_id = 2")).filter("kept").count() == 1


def test_exact_dedup_keeps_one_of_ties(spark):
    rows = [(None, "x"), (None, "x"), (5, "y"), (5, "y"), (4, "y"), (4, "y"), (None, None), (None, "")] + [(i, "hot  text") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for k in (1, 8, 1024):
        got = exact_dedup.exact_dedup(df, k=k).collect()
        assert len(got) == len(rows)
        kept = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]), key=repr)
        assert kept == sorted([(None, None, 2), (4, 4, 4), (None, None, 2), (100, 100, 300)], key=repr)


def test_rows_without_ids_are_spread_over_the_mix(spark):
    df = spark.createDataFrame([(None, f"t{i} word", "s") for i in range(400)] + [(1, "a b", "t")], "doc_id bigint, text string, source string")
    rows = mixing.mix_sources(df.repartition(3)).select("source", "before", "taken").collect()
    assert sorted(r["before"] for r in rows if r["source"] == "s") == list(range(0, 800, 2)) and sum(r["taken"] for r in rows) == 802
    again = mixing.mix_sources(df.repartition(5), carry=["text"]).select("text", "before").collect()
    first = {r["text"]: r["before"] for r in mixing.mix_sources(df, carry=["text"]).select("text", "before").collect()}
    assert {r["text"]: r["before"] for r in again} == first


def test_shards_stay_bounded_however_many_fingerprints(spark):
    """Trees fitted to a few fingerprints, and as many again that have one half in common."""
    n, shard = 120_000, 2000
    df = spark.range(n, numPartitions=4).select(F.when(F.col("id") % 6 == 0, F.shiftleft(F.pmod(F.xxhash64("id"), F.lit(1 << 31)), 32) + 77).otherwise(F.xxhash64("id")).alias("fp")).distinct()
    dealt, _ = simhash.deal(df, df.count(), 3, shard, 64)
    groups = dealt.groupBy("leaf", "path", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).collect()
    assert sum(r["homes"] for r in groups) == 2 * df.count()
    assert max(r["homes"] for r in groups) <= 4.5 * shard
    alone = [r["n"] for r in groups if r["homes"] < 2 * shard]
    assert len(alone) > 50 and max(alone) < 25 * shard


def test_misra_gries(spark):
    rng = random.Random(5)
    keys = [b"hot"] * 500 + [b"warm"] * 200 + [b"%d" % i for i in range(300)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k binary").repartition(5)
    found = {bytes(r["value"]): r["estimate"] for r in exact_dedup.misra_gries(df, "k", 12).collect()}
    assert {b"hot", b"warm"} <= set(found) and len(found) <= 12 and 500 - 1000 / 13 <= found[b"hot"] <= 500


@pytest.mark.parametrize("limit", [3, 20, 10**6])
def test_induced_sorting_in_memory_and_on_disk(limit):
    rng = random.Random(limit)
    for _ in range(60):
        pick = lambda: bytes(rng.choice(b"ab") for _ in range(rng.choice([7, 7, 3, 0])))
        items = sorted({(rng.randint(0, 2), pick(), pick()) for _ in range(rng.randint(1, 70))})
        group, right, left = np.array([x[0] for x in items]), [x[1] for x in items], [x[2] for x in items]
        count = np.array([rng.choice([1, 1, 2]) for _ in items])
        expected = np.zeros((len(items), 8), bool)
        for level in range(8):
            seen = {}
            for i, (g, r, l) in enumerate(items):
                if len(l) >= level and len(r) >= 7 - level:
                    seen.setdefault((g, l[len(l) - level :], r[: 7 - level]), []).append(i)
            for same in seen.values():
                expected[same, level] = count[same].sum() > 1
        held = suffix_dedup.Seeds(7, limit)
        made = suffix_dedup.make_seeds(group, left, right, count, 7)
        for a in range(0, len(made), 9):
            held.add(made[a : a + 9])
        assert (held.all() == made).all()
        assert (suffix_dedup.induce(held.all(), 5, 12, limit=limit, chunk=rng.choice([2, 5, 100])) == expected).all()


def test_passages_that_repeat_in_another_text(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    just, under, long = [w[:3] for w in words(51)], words(50), words(400)
    rows = {
        1: words(30) + just + words(80), 2: just, 3: words(9) + just + words(1),
        4: words(70) + under + words(70), 5: words(60) + under + words(3), 6: under, 7: words(500),
        8: words(100) + long, 9: long[100:300] + words(5), 10: (w := words(60)) + w, 11: words(51), 12: [],
    }
    path = str(tmp_path / "d.parquet")
    glue = {2: "\n\t", 9: "  "}
    spark.createDataFrame([(i, glue.get(i, " ").join(x)) for i, x in rows.items()], "doc_id bigint, text string").repartition(3).write.parquet(path)
    got = suffix_dedup.repeated_spans(spark.read.parquet(path)).collect()
    assert {r["doc_id"] for r in got if r["repeats_passage"]} == {1, 2, 3, 8, 9} and len(got) == len(rows)


def test_self_overlap_and_document_borders(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "ab" * 300), (2, "q" + "xyz" * 133), (3, "p" * 399), (4, "p" * 399)], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    got = {r["doc_id"]: (r["spans"], bytes(r["kept"])) for r in suffix_dedup.repeated_spans(spark.read.parquet(path)).collect()}
    assert [tuple(s) for s in got[1][0]] == [(0, 600)] and got[1][1] == b""
    assert got[2][0] == got[3][0] == got[4][0] == [] and got[4][1] == b"p" * 399


def test_bpe_on_random_text():
    ours, theirs, rng = bpe.Bpe(TOKENS), Tokenizer.from_file(TOKENS), random.Random(1)
    texts = ["".join(rng.choice("aab'stre 1é́Σσς!!.ßİ日本  ñ<|>endoftx") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>abc<|startoftext|> x<|endoftext|>", "\x1c\x1d a\x1eb", "a" * 5000, "ab" * 3000, "", "ÅΩ ﬁ é"]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids and ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_chat_parts_and_round_trip(spark):
    parts = f"conv bigint, turn bigint, role string, parts {chat.PARTS}"
    rows = [
        (1, 1, "assistant", [("text", "see <|image|> & &lt;| ", None, None), ("image", None, "i2", 2)]),
        (1, 0, "us\ner<|im_end|>", [("image", None, "i1", None), ("text", None, None, None), ("audio", None, "a1", 10), ("what", "?", None, None), ("document", None, "d", 1)]),
        (1, None, None, None),
        (None, 5, "assistant", []),
    ]
    df = spark.createDataFrame(rows, parts)
    got = {r["conv_id"]: r for r in chat.format_chat(df, "conv", parts_col="parts").withColumns(chat.read_back()).collect()}
    one = got[1]
    assert [t["role"] for t in one["turns"]] == ["", "us\ner<|im_end|>", "assistant"]
    assert [t["text"] for t in one["turns"]] == ["", "<|image|><|audio|>?<|document|>", "see <|image|> & &lt;| <|image|>"]
    assert one["loss_text"] == "see <|image|> & &lt;| "
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "i1", 256), ("audio", "a1", 250), ("document", "d", 512), ("image", "i2", 512)]
    assert one["attachment_tokens"] == 1530 and got[None]["loss_text"] == ""
    assert chat.format_chat(df.filter("false"), "conv", parts_col="parts").collect() == []


def test_chat_of_tied_repeated_and_long_turns(spark):
    """Other columns may have the names that are made here; turns that tie go by role and body, repeated ones stay."""
    long = "x<|im_end|>&" * 50_000
    rows = [(7, 2, "user", "b", "m", "f"), (7, 2, "user", "a", "m", "f"), (7, 2, "assistant", "z", None, "f"), (7, 3, "user", "again", "m", "f"), (7, 3, "user", "again", "m", "f"), (7, 9, "assistant", long, "m", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, mask string, formatted string").repartition(3)
    one = chat.format_chat(df).withColumns(chat.read_back()).first()
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "b"), ("user", "again"), ("user", "again"), ("assistant", long)]
    assert one["loss_text"] == "z" + long and chat.format_chat(df.filter("false")).collect() == []


def test_license_diagonals(spark, tmp_path):
    notice = licenses.TEMPLATES["mit-text"].split()
    broken = " ".join(notice[:12] + ["really"] + notice[12:])
    rows = [(1, f"Intro. {broken}. CC  BY, cc-by"), (2, "All rights\nreserved all Rights reserved"), (3, "of the license to any person"), (4, None)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.read.parquet(path)).collect()}
    assert got[1]["labels"] == "cc-by,mit-text" and got[1]["base_labels"] == "cc-by" and got[1]["n_base"] == 2
    span = next(s for s in got[1]["spans"] if s["name"] == "mit-text")
    assert (span["lo"], span["hi"]) == (1, 1 + len(notice))
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == (2, 0, 3, 1.0)
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.6
    assert (got[4]["n_words"], got[4]["first_word"], got[4]["score"]) == (0, None, 0.0)


def test_a_license_is_verified_by_different_places_of_its_template(spark, tmp_path):
    rng = random.Random(12)
    fill = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    whole = licenses.TEMPLATES["mit-license"].split()
    drifted = [w for i, w in enumerate(whole) for w in ([w] if i % 17 else [w, "really", "truly"])]
    rows = [
        (1, "apache license version " * 4), (2, "apache license version " * 2000), (3, "the apache license " * 6), (4, "CC BY NC " * 3),
        (5, f"{fill(50)} {' '.join(whole)} {fill(50)} {' '.join(whole)}"), (6, f"{fill(9)} {' '.join(drifted)}"),
        (7, f"{'permission is hereby ' * 40} {' '.join(whole)}"), (8, " ".join(whole[:70])),
    ]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.read.parquet(path)).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3)] == [""] * 3 and got[1]["score"] == got[2]["score"] == pytest.approx(1 / 6) and got[3]["score"] == pytest.approx(1 / 6)
    assert got[4]["labels"] == "cc-by" and max(s["share"] for s in got[4]["spans"] if s["name"] == "cc-by-nc") == pytest.approx(1 / 5)
    assert {"mit-license", "mit-text"} <= set(got[5]["labels"].split(",")) and got[5]["score"] == 1.0
    assert "mit-license" in got[6]["labels"] and "mit-license" in got[7]["labels"] and got[8]["labels"] == "mit-text"
    full = [s for s in got[5]["spans"] if s["name"] == "mit-license" and s["share"] == 1.0]
    assert sorted({(s["lo"], s["hi"]) for s in full}) == [(50, 49 + len(whole)), (100 + len(whole), 99 + 2 * len(whole))]


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_levenshtein_automaton_against_all_terms():
    rng, terms = random.Random(2), ["idiot", "moron", "scum", "losers", "loser", "abcde", "bbbbb"]
    lexicon = toxicity.Lexicon(terms, ordinary=["moren"], misspelt=terms)
    words = [*terms, "moren", "mor0n", "lossers", "skum", ""] + ["".join(rng.choice("abcdelmorsx") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    words += [t[:i] + c + t[i + k :] for t in terms for i in range(len(t)) for k in (0, 1) for c in ("", "b", "z")]
    for w in words:
        expected = 0 if w in terms else 1 if any(len(t) >= 5 and near(w, t) for t in terms) else None
        found = lexicon.search(w)
        assert (found[1] if found else None) == expected, w
    assert lexicon.match("moren") is None and lexicon.match("moron") == ("moron", 0)


def test_quotation_counts_less_than_abuse(spark):
    model = toxicity.ToxicityModel({t: (10.0, 0.0) for t in toxicity.SEEDS}, (20.0, 200.0), [], [4.0, 0.0, 2.0, 0.5, 0.0, -4.0])
    texts = ["you are an idiot and a moron, pathetic", "you are an idi0t, a mooron", 'the report quotes "idiot" as a word', "a fine day for all of us", None]
    scores = [r["score"] for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert scores[0] > 0.9 > scores[2] and scores[1] > scores[3] and scores[2] < 0.5 and scores[3] == scores[4] < 0.1


def test_vantage_trees_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in range(64)]
    near_ones = [x ^ np.bitwise_xor.reduce([flips[b] for b in rng.choice(64, rng.integers(1, 6), replace=False)]) for x in base[:200]]
    fps = np.unique(np.concatenate([base, np.array(near_ones, np.uint64), base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    expected = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 3]}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(3)
    links = simhash.near_links(df, len(fps), 3, shard=30, sample=300)
    found = {r["u"]: r["v"] for r in components.components(links).collect()}
    root = lambda x: found.get(x, x)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    top = {int(x): int(x) for x in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in expected:
        top[find(b)] = find(a)
    groups = {}
    for x in top:
        groups.setdefault(find(x), set()).add(root(signed(x)))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (5, 5)]
    found = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(1, 31)} | {101: 100}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_near_copies(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (60, 200, 201, 1000)]
    words = base[1].split()
    words[100] = "changed"
    rows = [(i, t) for i, t in enumerate([*base, " ".join(words), base[3] + " tail", None, "", "one"])]
    got = {r["u"]: r["v"] for r in simhash.near_copies(spark.createDataFrame(rows, "k bigint, text string"), "k", together=2).collect()}
    assert got == {4: 1, 5: 3, 7: 6}


def test_targets_against_a_loop(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {None if i == 5 else f"s{i}": rng.choice([0, 1, 10, 100, 5000]) for i in range(rng.choice([1, 4, 7]))}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight, left, target = {s: i % 3 + 1 for i, s in enumerate(names)}, float(sum(sizes.values())), dict.fromkeys(names, 0.0)
        still = set(names)
        while still:
            share = {s: left * weight[s] / sum(weight[x] for x in still) for s in still}
            over = {s for s in still if share[s] > 3 * sizes[s]}
            if not over:
                target |= share
                break
            for s in over:
                target[s] = 3.0 * sizes[s]
                left -= target[s]
            still -= over
        assert got == pytest.approx(target)


def test_mix_meets_its_budgets(spark, odd):
    rows = mixing.mix_sources(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1
    again = sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix_sources(odd.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, r["taken"]) for r in rows)


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    good, poor = rng.normal([2, 0], 1, (200, 2)), rng.normal([0, 0], 1, (100, 2))
    w = quality.fit_pairs(good, poor)
    assert w[0] > 0.5 and abs(w[1]) < 0.4


def test_no_lambda_computes_an_array_anew_for_each_element(spark):
    """A text of many words must cost in proportion: what lambdas refer to has to be a column of the plan."""
    df = spark.createDataFrame([("a b",)], "text string").repartition(1).withColumn("ws", stats.words(F.col("text")))
    plan = stats.with_repeat_words(df, "ws", "n")._jdf.queryExecution().optimizedPlan().toString()
    for outer, inner in (("slice(", "transform("), ("get(", "sort_array("), ("get(", "transform(")):
        for line in plan.split("\n"):
            at = line.find(f"{outer}")
            while at >= 0:
                assert not line[at + len(outer) :].startswith(inner), line
                at = line.find(outer, at + 1)
    long = " ".join(f"w{i % 30_000}" for i in range(60_000))
    began = time.monotonic()
    got = rules.base_statistics(spark.createDataFrame([(long,)], "text string"), "text", []).first()
    assert got["n_words"] == got["n_repeat_words"] == 60_000 and time.monotonic() - began < 60


def test_robust_estimates_ignore_outliers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cov = np.array([[1.0, 0.5, 0], [0.5, 1.0, 0], [0, 0, 0.25]])
    x = np.vstack([rng.multivariate_normal([1, 2, 3], cov, 1700), rng.normal([30, -20, 9], 1, (300, 3))])
    df = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, x1 double, x2 double, x3 double").repartition(3)
    e = rules.robust_estimates(df).first()
    assert np.allclose([e["m0"], e["m1"], e["m2"]], [1, 2, 3], atol=0.15)
    monkeypatch.setattr(rules, "FEW", 0)  # dealt by salt
    other = rules.robust_estimates(df.repartition(5)).first().asDict()
    assert all(other[c] == pytest.approx(v, rel=1e-6, abs=1e-9) for c, v in e.asDict().items() if c != "pool")
    scaled = np.array([[e["c00"], e["c01"]], [e["c01"], e["c11"]]]) * e["scale"]
    assert np.allclose(scaled, cov[:2, :2], atol=0.3)
