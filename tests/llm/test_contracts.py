"""The registered queries against SQL, or against plain versions of their contracts."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from runmerge.llm import queries, rules
from tokenizers import Tokenizer

from tests.support import SMALL, duck, rows_of, rows_of_sql

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return dict(duck().sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def by_id(df, n):
    rows = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == n
    return rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SMALL)) == rows_of_sql(duck(), queries.SQL[name])


def test_op1_against_all_windows(spark, docs):
    data = {d: t.encode() for d, t in docs.items()}
    count = collections.Counter(t[i : i + 400] for t in data.values() for i in range(len(t) - 399))
    got, removed = by_id(queries.op1_suffix_dedup(spark, SMALL), len(data)), 0
    for d, t in data.items():
        cover = np.zeros(len(t) + 2, int)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                cover[i + 1 : i + 401] = 1
        kept = bytes(b for b, c in zip(t, cover[1:-1], strict=True) if not c)
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(cover.sum()), int((np.diff(cover) == 1).sum()), hashlib.sha256(kept).hexdigest())
        removed += r["n_removed"]
    assert removed > 10_000


def test_op2_against_the_library(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for d, r in by_id(queries.op2_bpe(spark, SMALL), len(docs)).items():
        ids = t.encode(docs[d], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    y = np.asarray(y)
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize(("query", "label", "folds", "out", "least"), [(queries.op5_toxicity, "toxic", 3, 1, 0.75), (queries.op7_quality, "quality", 4, 2, 0.95)])
def test_classifiers_on_the_held_out_fold(spark, query, label, folds, out, least):
    path = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in query(spark, path).collect()}
    labels = dict(duck(path).sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    test = [d for d in labels if rows[d]["held_out"]]
    y = [labels[d] for d in test]
    assert auc(np.array([rows[d]["score"] for d in test]), y) > least
    right = np.mean([rows[d]["predicted"] == v for d, v in zip(test, y, strict=True)])
    assert right > 0.9


def fingerprint(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_op8_against_all_pairs(spark, docs):
    f = {d: fingerprint(t) for d, t in docs.items()}
    top = {d: d for d in f}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in f:
        for b in f:
            if a < b and (f[a] ^ f[b]).bit_count() <= 3 and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                top[hi] = lo
    for d, r in by_id(queries.op8_simhash(spark, SMALL), len(f)).items():
        assert r["fingerprint"] == f"{f[d]:016x}" and r["component_id"] == find(d)


def test_op9_base_rules_and_outliers(spark, docs):
    path = "/root/testdata/sf0.01"
    texts = dict(duck(path).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = by_id(queries.op9_quality_rules(spark, path), len(texts))
    for d, t in texts.items():
        words = [w for w in SPACE.split(t) if w]
        lines = [x for x in t.split("\n") if SPACE.sub("", x)]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        twice = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(lines) - len(set(lines)), len(twice), failed)
        assert not (failed and r["kept"])
    labels = dict(duck(path).sql("SELECT doc_id, quality FROM labels").fetchall())
    good = [rows[d]["kept"] for d, q in labels.items() if q == 1 and not rows[d]["base_failed"]]
    poor = [rows[d]["kept"] for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.2
    wanted = plain_verdicts(texts, dict((d, (lang, source)) for d, lang, source in duck(path).sql("SELECT doc_id, lang, source FROM documents").fetchall()), {d for d in rows if not rows[d]["base_failed"]})
    clear = [d for d, x in wanted.items() if not 0.9 < x / rules.CUT_OFF < 1.1]
    assert len(clear) > 0.97 * len(wanted) and sum(not rows[d]["kept"] for d in wanted) > 20
    assert [d for d in clear if rows[d]["kept"] != (wanted[d] <= rules.CUT_OFF)] == []


def plain_verdicts(texts, groups, passed):
    """The squared distance of each text that passed, by concentration steps on exact subsets, one pool at a time."""
    raw = {d: (len([w for w in SPACE.split(texts[d]) if w]), len(SPACE.sub("", texts[d])), sum(c in rules.PUNCTUATION for c in texts[d]), sum(c in rules.UPPER for c in texts[d])) for d in passed}
    by = collections.Counter(groups[d] for d in passed)
    left = collections.Counter(groups[d][0] for d in passed if by[groups[d]] < 100)
    pool = {d: groups[d] if by[groups[d]] >= 100 else groups[d][0] if left[groups[d][0]] >= 100 else None for d in passed}
    out = {}
    for p in set(pool.values()):
        own = sorted(d for d in passed if pool[d] == p)
        rows = own if p is not None else sorted(passed)
        a = np.array([raw[d] for d in rows], float)
        n, t = a[:, 0], a.sum(axis=0)
        even = np.sqrt(n / (n + 200))
        x = np.column_stack([a[:, 1] / n - t[1] / t[0], *(np.log(a[:, i] / n + 0.1) - np.log(t[i] / t[0] + 0.1) for i in (2, 3))]) * even[:, None]
        best = None
        middle = np.median(x, axis=0)
        for m, c in ((middle, np.diag((np.median(np.abs(x - middle), axis=0) * 1.4826) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
            c = c + 1e-4 * np.eye(3)
            for _ in range(100):
                d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
                near = np.argsort(d2, kind="stable")[: int(np.ceil(0.75 * len(x)))]
                m, c = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + 1e-4 * np.eye(3)
            if best is None or np.linalg.det(c) < best[0] * (1 - 1e-6):
                best = (np.linalg.det(c), m, c)
        d2 = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
        d2 /= np.median(d2) / 2.366
        out |= {d: v for d, v in zip(rows, d2, strict=True) if pool[d] == p}
    return out
