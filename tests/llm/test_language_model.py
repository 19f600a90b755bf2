"""Kneser-Ney scores against a plain model over dictionaries."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from terraspan.llm import kneser_ney as kn
from terraspan.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
BEGIN, END = ("begin",), ("end",)  # no word is a tuple


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x20\\x09-\\x0D]+", lowered) + [END]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        if all(0 <= x <= k for k, x in enumerate(d, 1)):
            return [0, *d]
    return [0, 0.5, 1.0, 1.5]


class Plain:
    def __init__(self, texts, order=kn.ORDER):
        self.order = order
        longest = Counter()
        for text in texts:
            longest.update(self.grams(text))
        self.counts = {order: longest}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.taken = {k: discounts(c.values()) for k, c in self.counts.items()}
        contexts = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for gram, n in c.items():
                contexts[k][gram[:-1]].append(n)
        self.weights = {k: {c: sum(self.taken[k][min(f, 3)] for f in fs) / sum(fs) for c, fs in contexts[k].items()} for k in contexts}
        self.totals = {k: {c: sum(fs) for c, fs in contexts[k].items()} for k in contexts}
        self.words = Counter()
        for gram, n in longest.items():
            self.words[gram[-1]] += n
        self.total = sum(self.words.values())

    def grams(self, text):
        seq = [BEGIN] * (self.order - 1) + words_of(text)
        return list(zip(*[seq[i:] for i in range(self.order)]))

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        lower, k = self.p(gram[1:]), len(gram)
        if gram[:-1] not in self.totals[k]:
            return lower
        n = self.counts[k][gram]
        return (n - self.taken[k][min(n, 3)]) / self.totals[k][gram[:-1]] + self.weights[k][gram[:-1]] * lower

    def score(self, text):
        words, grams = words_of(text), self.grams(text)
        base = sum(log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in words)
        return [len(words), sum(self.words[w] > 0 for w in words), self.total, base, sum(log10(self.p(g)) for g in grams)]


def scores(spark, rows, shard_bytes=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as shard", "'x' as _text", "3 as n_tokens")
    got = kn.score_documents(docs).collect()
    return sorted(((r["doc_id"], r["text"] or "", r["held_out"], [r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in got), key=str)


def same(got, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([t for i, t in rows if not held(i)])
    want = sorted(((i, t or "", held(i), model.score(t)) for i, t in rows), key=str)
    assert [w[:3] for w in want] == [g[:3] for g in got] and [w[3][:3] for w in want] == [g[3][:3] for g in got]
    assert np.allclose([w[3][3:] for w in want], [g[3][3:] for g in got], rtol=1e-5, atol=1e-9)


def test_query_matches_a_plain_model(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_perplexity"](spark, FOLDER).collect()
    same(sorted(((r["doc_id"], dict(rows)[r["doc_id"]] or "", r["held_out"], [r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in got), key=str), rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than word frequencies on texts not learned from


@pytest.mark.parametrize("shard_bytes", [5000, kn.SHARD_BYTES])
def test_odd_texts(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(kn.fit, "__defaults__", ("text", shard_bytes))
    texts = [None, "", " ", "\n", "a b c a b c a b d", "A B C", "a", "x\u00a0y \x1cz", "\u0130 I i \u0131", "word " * 3000, "q" * 50_000, "a b c d e f g", "a b x", "</s> <s>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "a b c"), (1, "a b c"), (None, "null id a b"), (None, "null id a b"), (2, None)]
    rows += [(100 + i, "the hot text of all") for i in range(60)]
    same(scores(spark, rows), rows)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_longer_ngrams(order):
    """The steps of a fit of any order in one process, against the plain model."""
    import tempfile

    texts = ["a b c a b c a b d", "a b c", "", "a b x a b", "x y z a b c", "a b c a b c a b d"] * 3
    folder, before = tempfile.mkdtemp(), kn.ORDER
    try:
        kn.ORDER = order
        sequence, bounds = kn.tokens([t.encode() for t in texts])
        grams = kn._grams(sequence, bounds, order)
        runs = [b for b in kn._runs(*kn._counted([grams]), 2)]
        headers = {}
        for length in range(order, 0, -1):
            rows = [(s, p) for b in runs for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            runs, headers[length] = [], np.zeros(kn._HEADER, np.int64)
            for shard in sorted({s for s, _ in rows}):
                parts = [kn._unpacked(p, length) for s, p in rows if s == shard]
                keys, words, values = kn._summed(*[np.concatenate([p[i] for p in parts]) for i in range(2)])
                kn._store(folder, length, shard, keys, values, kn._bits(length, 2))
                headers[length] += np.fromfile(f"{folder}/{length}/{shard}.ngrams", np.int64, kn._HEADER)
                if length > 1:
                    for shorter in kn._passed_on(length, words, values):
                        runs += list(kn._runs(*kn._summed(*shorter), kn._bits(length - 1, 2)))
        taken = {k: kn.discounts(h[1:5].tolist()) for k, h in headers.items()}
        _, once, twice, _, _, left, count, vocabulary, _ = headers[1].tolist()
        spread = float(taken[1][1] * once + taken[1][2] * twice + taken[1][3] * (vocabulary - once - twice)) / left
        model = kn.Model(folder, 2, taken, left, spread, count, vocabulary)
        plain = Plain(texts, order)
        for text in [*texts, "a q b c", "q", "b c a b x"]:
            got, want = model.scorer().score([text.encode()]), plain.score(text)
            assert [int(got["n_tokens"][0]), int(got["n_known"][0])] == want[:2]
            assert np.allclose([got["base_score"][0], got["score"][0]], want[3:], rtol=1e-9)
    finally:
        kn.ORDER = before


def test_nothing_to_learn_from(spark):
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = kn.score_texts(one, one.limit(0)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert scores(spark, []) == []


def test_probabilities_of_a_context_add_up(spark):
    texts = ["a b c a b d", "a b c b b", "d a b", "c c a b e", ""] * 2
    model = Plain(texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    scorer = kn.fit(docs).scorer()
    for context in (["a", "b"], ["b", "b"], ["never", "b"], ["never", "seen"], ["c"]):
        vocabulary = [w for w in model.words if w != END] + ["unknown"]
        total = 0.0
        for word in vocabulary:
            p, _ = scorer.probabilities(*kn.tokens([" ".join([*context, word]).encode()]))
            total += p[len(context)]
        p, _ = scorer.probabilities(*kn.tokens([" ".join(context).encode()]))
        assert abs(total + p[-1] - 1) < 1e-6


def test_files_are_written_whole_and_only_once(tmp_path):
    keys, values = np.array([3, 9, 1 << 63], np.uint64), np.array([[1], [254], [70_000]], np.int64)
    for _ in range(2):
        kn._store(f"file:{tmp_path}", kn.ORDER, 0, keys << np.uint64(0), values, 0)
    assert [p.name for p in (tmp_path / str(kn.ORDER)).iterdir()] == ["0.ngrams"]
    found = kn.Table(str(tmp_path), kn.ORDER, 0).find(np.array([1 << 63, 5 << 60, 0], np.uint64))
    assert found["count"][0] == 70_000 and found["count"][1] == 0


@pytest.mark.parametrize("bits, length", [(0, 2), (3, 2), (0, 1), (4, 1)])
def test_every_stored_hash_is_found(tmp_path, bits, length):
    draw = np.random.default_rng(bits)
    keys = np.sort(draw.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(bits))
    values = draw.integers(0, 600, (5000, len(kn._values(length))))
    kn._store(str(tmp_path), length, 0, keys, values, bits)
    shard = kn.Shard(kn.Table(str(tmp_path), length, 0)._mapped(f"{tmp_path}/{length}/0.ngrams"), length, bits)
    assert (shard.find(keys).T == values).all()
    assert not shard.find(draw.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(bits)).any()
