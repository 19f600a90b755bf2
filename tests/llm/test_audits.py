"""Filter audit against plain counts of every order; whitening against exact sums and a dense eigensolver."""

import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from terraspan.llm import filter_audit, whitening
from terraspan.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def fails(text, doc_id, firsts):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and doc_id > firsts[text]:
        out.add("E")
    return out


def plain(docs, labels):
    """Apply the filters one after the other to all rows, for every order."""
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = {}
    for i, text, source in docs:
        rows.setdefault(source or "", []).append((i, fails(text, i, firsts)))
    out = {}
    for part, members in rows.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                total[f] += len(gone)
                failing = sum(f in m[1] for m in members)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in members),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audit(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as mask", "2 as _id", "3 as _part", "'x' as part", "4 as n")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'y' as text", "5 as _good")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.audit_filters(docs, labels).collect()}


def test_audit_of_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    texts = [
        None, "", "", "a b c", "A B C #", long_text, long_text, long_text + " |", "x " * 300, "X" * 100_000, "\u00a0" * 3, "a\x0bb\x1cc\td\r\ne",
        "\U0001f600" * 60 + "Q", long_text.upper(), "$ " * 100, " ".join(f"W{i}" for i in range(200)),
    ]
    docs = [(i, t, [None, "", "s", "s"][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, "a b c", "s"), (3, "a b c", "t"), (None, "a b c", "s"), (None, "a b c", "s"), (None, None, None), (5, "other", "s"), (90, long_text, "u")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(10)] + [(None, 1, 1), (3, 0, 1), (3, None, None), (11, 7, -1), (400, 1, 1)]
    want = plain(docs, labels)
    assert len(want) == 600 * 4 and audit(spark, docs, labels) == want


def test_audit_of_a_copy_in_most_rows(spark):
    docs = [(1000 - i, "same text", f"s{i % 3}") for i in range(900)] + [(i, f"text {i}", "s0") for i in range(90)]
    assert audit(spark, docs, [(101, 1, 1), (102, 1, 0)]) == plain(docs, [(101, 1, 1), (102, 1, 0)])


def test_audit_of_nothing(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    one = audit(spark, [(1, "# a", "s")], [])
    assert len(one) == 600 and one["s", "ABCDE", 1] == [0, 1, 0, 0, 0, 0, 60]


@pytest.mark.parametrize("filters", [1, 2, 3, 5])
def test_walk_counts_what_passes_every_subset(filters):
    cells = np.random.default_rng(filters).integers(0, 50, (1 << filters, 3))
    want = [cells[[m for m in range(1 << filters) if m & s == 0]].sum(axis=0) for s in range(1 << filters)]
    assert (filter_audit.walk(cells, filters) == np.array(want)).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as whitened", "2 as n", "'x' as i", "3 as _v")


def check_whitening(rows, got, components=8):
    """Rows of the operator against whole-number sums and a dense solver."""
    good = [(i, [float(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(c) for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(d)]
    centred = [[n * v[k] - sums[k] for k in range(d)] for v in x]
    cov = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = len({r["component"] for r in got})
    assert k == min(components, int((values > values[0] * d * 1e-14).sum())) and len(got) == n * k
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    keys = {}
    for (i, _), c in zip(good, centred):
        keys.setdefault((i, sum(e * e for e in c)), []).append(c)
    assert set(by_row) == set(keys)
    table = np.array([[np.mean([r["whitened"] for r in by_row[key][j + 1]]) for j in range(k)] for key in keys])
    want = np.array([np.array(c[0], float) / n @ vectors[:, :k] / np.sqrt(values[:k]) for c in keys.values()])
    for j in range(k):
        sign = np.sign((table[:, j] * want[:, j]).sum())
        assert np.allclose(table[:, j], sign * want[:, j], rtol=1e-6, atol=1e-6)
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / cov.trace()) < 1e-9


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, QUERIES["op11_whitening"](spark, FOLDER).collect())


def test_whitening_of_odd_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(draw.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5])]
    odd = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0]), (4, [float("nan")] * 5), (5, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, None)]
    check_whitening(rows, whitening.whitened_components(frame(spark, [*odd, *rows, (6, [1.0, 2.0])])).collect())
    repeated = [*rows, rows[0], rows[0], (None, rows[1][1])]
    check_whitening(repeated, whitening.whitened_components(frame(spark, repeated + odd)).collect())
    shown = whitening.whiten(frame(spark, odd), whitening.fit_whitening(frame(spark, rows)))
    assert shown.columns == ["vec_id", "embedding", "n", "i", "_v", "whitened", "deviation"]
    assert all(r["whitened"] is None and r["deviation"] is None for r in shown.collect()) and shown.count() == len(odd)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0, 3.0]) for i in range(5)]):
        got = whitening.whitened_components(frame(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_whitening_of_dependent_dimensions(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(a), float(2 * a), float(b), 0.0]) for i, (a, b) in enumerate(draw.integers(-9, 9, (40, 2)))]
    check_whitening(rows, whitening.whitened_components(frame(spark, rows)).collect())


def test_whitening_of_huge_and_long_vectors(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0]), (4, [1e6, -5.0])]
    got = whitening.whitened_components(frame(spark, rows)).collect()  # beside the first, the second dimension has no variance in a double
    assert len(got) == 4 and all(r["identity_error"] < 1e-6 for r in got)
    x = {i: [min(max(int(np.floor(1024 * float(np.float32(c)))) if abs(c) < 1e30 else int(np.sign(c)) << 50, -(1 << 50)), 1 << 50) + 100000 for c in v] for i, v in rows}
    exact = {i: sum((4 * v[k] - sum(w[k] for w in x.values())) ** 2 for k in range(2)) for i, v in x.items()}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 1 << 63 else None for i, d in exact.items()}
    long_rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(30, 600)).astype(np.float32))]
    got = whitening.whitened_components(frame(spark, long_rows)).collect()
    assert len(got) == 240 and all(r["identity_error"] < 1e-9 for r in got)


def test_products_are_exact_at_every_size():
    for bits in (5, 20, 24, 40, 51):
        z = np.random.default_rng(bits).integers(-(1 << bits), 1 << bits, (300, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(3)] for i in range(3)]
        assert whitening._products(z).tolist() == want
