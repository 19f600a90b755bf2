"""Repeated strings and near-duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terraspan.llm import probminhash, suffix_dedup


def plain_removal(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        change = np.zeros(len(raw) + 1, int)
        for at in range(len(raw) - 99):
            if seen.setdefault(raw[at : at + 100], (doc, at)) != (doc, at):
                change[at] += 1
                change[at + 100] -= 1
        gone = np.cumsum(change)[: len(raw)] > 0
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[doc] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def patchwork(seed, count=250):
    pick = random.Random(seed)
    passages = ["".join(pick.choice("abcd é") for _ in range(n)) for n in (90, 99, 100, 101, 150, 300, 700)]
    rows = []
    for i in range(count):
        parts = [
            pick.choice([pick.choice(passages), "".join(pick.choice("xyz ") for _ in range(pick.randrange(200))), "!" * pick.randrange(250), "ab" * pick.randrange(120)])
            for _ in range(pick.randrange(5))
        ]
        rows.append((i, "".join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 5000)]


@pytest.mark.parametrize("crowded", [False, True])
def test_repeated_strings(spark, monkeypatch, crowded):
    if crowded:  # every bucket with two classes is split into its strings
        monkeypatch.setattr(suffix_dedup, "CROWDED", 2)
        monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
        monkeypatch.setattr(suffix_dedup, "LEAST_SHARE", 0)
    rows = patchwork(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_bytes", "'k' as key").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == plain_removal(rows)
    cleaned = {r["doc_id"]: r["text"] for r in suffix_dedup.clean_texts(docs).collect()}
    assert all((cleaned[d] == t) == (got[d][1] == 0) for d, t in rows)


def test_repeats_at_the_border_of_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 120)
    rows = patchwork(8, 120)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc", "text"])
    units = [b for b in suffix_dedup._map(np.zeros(0, np.int64))([batch])]
    owned = Counter()
    for b in units:
        for kind, cls, doc, at in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
            owned[doc] += (at & 127) + 1 if kind == suffix_dedup.UNIT else 0
    assert all(owned[d] <= max(0, len((t or "").encode()) - 99) for d, t in rows)


def test_rows_without_id_and_repeated_rows(spark):
    text = "".join(random.Random(1).choices("abcdef", k=400))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 400)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_signatures_estimate_probability_jaccard():
    pick = np.random.default_rng(2)
    shingle = pick.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = pick.integers(1, 9, 300), pick.integers(1, 9, 300)
    a, b = np.arange(300) < 250, np.arange(300) >= 40
    owner = np.concatenate([np.zeros(a.sum(), np.int64), np.ones(b.sum(), np.int64)])
    marks = probminhash.signatures(owner, np.concatenate([shingle[a], shingle[b]]), np.concatenate([wa[a], wb[b]]), 2, registers=4000)
    order_a, order_b = np.argsort(shingle[a]), np.argsort(shingle[b])
    exact = probminhash.probability_jaccard(shingle[a][order_a], wa[a][order_a], shingle[b][order_b], wb[b][order_b])
    assert abs((marks[0] == marks[1]).mean() - exact) < 0.04


def test_probability_jaccard_by_definition():
    pick = np.random.default_rng(4)
    for _ in range(30):
        a, b = np.unique(pick.integers(0, 30, 15)).astype(np.uint64), np.unique(pick.integers(0, 30, 15)).astype(np.uint64)
        wa, wb = pick.integers(1, 6, len(a)), pick.integers(1, 6, len(b))
        x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in set(x) | set(y)) for d in set(x) & set(y))
        assert probminhash.probability_jaccard(a, wa, b, wb) == pytest.approx(want)


def plain_classes(rows):
    names = [d for d, _ in rows]
    owner, shingle, weight, bounds, copies = probminhash._shingles([(t or "").encode() for _, t in rows])
    root = dict(zip(names, names))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x, y = slice(bounds[i], bounds[i + 1]), slice(bounds[j], bounds[j + 1])
            if copies[i] is not None and probminhash.probability_jaccard(shingle[x], weight[x], shingle[y], weight[y]) >= 0.8:
                a, b = find(names[i]), find(names[j])
                root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_near_duplicate_classes(spark):
    pick = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    for family in range(12):
        base = [pick.choice(words) for _ in range(pick.choice([3, 40, 120, 200]))]
        for _ in range(pick.choice([1, 3, 12])):
            edited = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4, 8])):
                edited[pick.randrange(len(edited))] = pick.choice(words)
            rows.append((i, pick.choice([" ", ", ", "\n"]).join(edited)))
            i += 1
    shared = " ".join(pick.choice(words) for _ in range(40))  # one passage in many different texts
    rows += [(i + k, " ".join(pick.choice(words) for _ in range(20)) + " " + shared) for k in range(60)]
    rows += [(500, None), (501, ""), (502, "!?"), (503, ""), (504, "One two"), (505, "one, TWO")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 as class_id", "1 as _id", "'x' as _copy")
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicate_classes(docs.union(docs)).collect()}
    assert got == plain_classes(rows)
    nameless = spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id bigint, text string")
    kept = probminhash.deduplicate(docs.select("doc_id", "text").union(docs.select("doc_id", "text")).unionByName(nameless.limit(1)))
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(got.values()))
    assert kept.filter("doc_id is null").count() == 1
    assert probminhash.near_duplicate_classes(nameless.limit(0)).collect() == []


def test_near_duplicates_of_repeated_ids(spark):
    base = [" ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=200)) for seed in range(12)]
    rows = []
    for i, text in enumerate(base):
        # id 10 i + 2 has a near copy of the text as its smallest one, and another text
        rows += [(10 * i + 1, "aa " + text), (10 * i + 2, "aa " + text + " end"), (10 * i + 2, "zz " + " ".join(random.Random(99 + i).choices("abcdefghij", k=200)))]
    rows += [(500, base[0]), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicate_classes(docs).collect()}
    assert got == {10 * i + j: 10 * i + 1 for i in range(12) for j in (1, 2)} | {500: 500}
    kept = sorted((r["doc_id"], r["text"]) for r in probminhash.deduplicate(docs).collect())
    assert kept == [(10 * i + 1, "aa " + text) for i, text in enumerate(base)] + [(500, None)]
