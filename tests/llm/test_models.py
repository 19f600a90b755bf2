"""Neighbour search, mixing, page text, quality and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from compare import check, connect

import __spark_entry__ as entry
import corpus_pipeline
from terraspan.llm import cross_polytope, html_text, mixing, quality
from terraspan.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    check(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])


def plain_nearest(rows, every, k):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            scores = [(-float((good[q] * good[i]).sum()), i) for i in good if i != q and len(good[i]) == len(good[q])]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def nearest(spark, rows, every=20, k=20):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as id", "2 as v")
    out = {}
    for r in sorted(cross_polytope.nearest(frame, every, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_with_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, (centre * (1 + i % 3)).astype(np.float32).tolist()) for i in range(90)]  # ties within three groups of copies
    rows += [(100 + i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(40)]
    rows += [(200, None), (220, [0.0] * 16), (240, [float("nan")] * 16), (260, [float("inf")] + [1.0] * 15), (280, []), (None, [1.0] * 16), (300, [1.0, 2.0]), (320, [None] + [1.0] * 15)]
    got, want = nearest(spark, rows + rows[:5], every=10, k=7), plain_nearest(rows, 10, 7)
    assert got.keys() == {q for q, found in want.items() if found}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        if q < 90:
            assert [i for i, _ in found] == [i for i, _ in want[q]]
    assert nearest(spark, [(1, [1.0])][:0]) == {}
    assert nearest(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.0])])[20] == [(1, 0.5)]


def test_nearest_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = nearest(spark, rows), plain_nearest(rows, 20, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_pseudo_rotation_keeps_lengths():
    rows = np.random.default_rng(3).standard_normal((5, 64))
    turned = cross_polytope.rotate(rows, 2)
    assert np.allclose((turned[:, :64] ** 2).sum(axis=1), (rows**2).sum(axis=1)) and np.allclose(turned[:, :64], -turned[:, 64:])


MIX = [
    (1, "a b c d e f g h", "en", "src0"), (2, "a b c", "en", "src0"), (3, "a b", "de", "src0"), (4, "x y z", "en", "src1"), (5, "x " * 500, "fr", "src2"),
    (6, "q", None, None), (7, None, "en", "src1"), (8, " \n", "en", "src1"), (9, "w " * 50, "es", "odd'name"), (10, "t " * 40, "en", "src4"),
]


@pytest.mark.parametrize("share, epochs", [((1, 2), 2), ((9, 10), 1), ((3, 1), 2), ((0, 1), 2), ((7, 5), 3)])
def test_mixing_matches_sql(spark, share, epochs):
    docs = spark.createDataFrame(MIX, "doc_id bigint, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?)", MIX)
    want = sorted(con.execute(mixing.mix_sql("docs", share=share, max_epochs=epochs)).fetchall())
    nameless = spark.createDataFrame([(None, "a b", "en", "src0")], docs.schema)
    got = sorted(tuple(r) for r in mixing.select_mix(docs.union(docs).union(nameless), share=share, max_epochs=epochs).collect())
    assert got == want
    total = sum(len((t or "").split()) for _, t, _, _ in MIX)
    if share[0] * 1.0 / share[1] <= 1:
        assert sum(r[-1] for r in got) == total * share[0] // share[1]


def test_mixing_keeps_columns(spark):
    docs = spark.createDataFrame(MIX, "doc_id bigint, text string, lang string, source string").selectExpr("*", "9 as epochs", "1 as _turn")
    rows = mixing.mix(docs.union(docs)).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and rows[0].__fields__[:4] == ["doc_id", "text", "lang", "source"]
    assert mixing.select_mix(docs.limit(0)).collect() == []


def exhaustive(parent, unary, edge):
    n = len(parent)
    weights = np.zeros((n, 2))
    for bits in range(2**n):
        y = [bits >> i & 1 for i in range(n)]
        weight = np.exp(sum(unary[i][y[i]] for i in range(n)) + sum(edge[y[parent[i]]][y[i]] for i in range(1, n)))
        for i in range(n):
            weights[i, y[i]] += weight
    return weights / weights.sum(axis=1, keepdims=True)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(6)
    for _ in range(10):
        n = 8
        page = html_text.Page()
        for i in range(1, n):
            parent = int(rng.integers(0, i))
            page.parent.append(parent)
            page.depth.append(page.depth[parent] + 1)
            page.tag.append("div")
        unary, edge = rng.standard_normal((n, 2)), rng.standard_normal((2, 2))
        full, _ = html_text.Forest([page]).beliefs(unary.copy(), edge)
        assert np.allclose(html_text._shares(full), exhaustive(page.parent, unary, edge))


@pytest.fixture(scope="module")
def page_model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


BODY = "<h1>Title here</h1><p>First &amp; foremost, a paragraph that\n goes on.<br>And on.</p><ul><li>An item of the list</li></ul><p>The last one."
BOXES = (
    '<nav><a href="#">Home</a></nav><div class="cookie-notice"><p>We use cookies. Accept them all.</p></div>{}<aside class="side-bar"><p>Popular stories you may like.</p></aside>'
    '<section id="comments"><div class="comment"><p>Great article, thanks for it all.</p></div></section><form><p>Sign up now for news.</p></form><footer>Copyright</footer>'
)


@pytest.mark.parametrize("frame", ["<article>{}</article>", '<main class="x">{}</main>', '<div class="post-content">{}</div>', '<section class="entry">{}</section>'])
def test_page_text(page_model, frame):
    source = "<html><head><title>No</title><script>var p='<p>no</p>';</script></head><body>" + BOXES.format(frame.format(BODY)) + "</body></html>"
    want = "Title here\nFirst & foremost, a paragraph that goes on. And on.\nAn item of the list\nThe last one."
    assert html_text.extract(page_model, [source]) == [want]


def test_page_text_of_broken_pages(spark, page_model):
    odd = [None, "", "<", "<p", "a<b>c</b>d <i>e", "<div><p>" * 3000 + "x", '<a href="x>never closed', "<script>", "<!-- open", "</p></div>", "&#0;&#xD800;&bogus;", "<p>" + "y " * 100_000]
    assert len(html_text.extract(page_model, odd)) == len(odd)
    pages = spark.createDataFrame([(i, None, s) for i, s in enumerate(odd)], "page_id bigint, url string, html string").selectExpr("*", "'t' as TEXT")
    rows = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert len(rows) == len(odd) and rows[0]["text"] == rows[1]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.score_quality(docs, labels).collect() if r["doc_id"] in known and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in rows) >= 0.95 * len(rows) and len(rows) > 50


def test_quality_never_learns_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    first, second = ({r["doc_id"]: r["score"] for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert first == second


def test_quality_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "abc"), (3, "x" * 50_000)], "doc_id bigint, text string").selectExpr("*", "'s' as score", "1 as held_out")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 7)], "doc_id bigint, quality int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 4 and all(r["score"] == quality.UNKNOWN and r["predicted"] == 0 for r in rows)
    one = quality.score_quality(docs, spark.createDataFrame([(3, 1)], labels.schema)).filter("doc_id = 3").first()
    assert one["score"] == pytest.approx(1.0)


def test_quality_that_shows_in_words_alone():
    rng = np.random.default_rng(4)
    good, bad, both = (["".join(rng.choice(list("abcdefghijkl"), 4)) for _ in range(40)] for _ in range(3))
    texts = [" ".join(rng.choice((good if i % 2 else bad) + both, 60)).encode() for i in range(400)]
    counts, labels = quality.term_counts(texts), np.arange(400) % 2
    scores = quality.score(quality.fit(counts[:300], labels[:300]), counts[300:])
    assert ((scores >= 0.5) == labels[300:]).mean() >= 0.95


def test_pipeline(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, ids = documents, {r[0] for r in documents.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == documents.columns and now and now <= ids and docs.count() == len(now), name
        ids = now
    final = corpus_pipeline.run(spark, FOLDER)
    assert {r[0] for r in final.select("doc_id").collect()} <= ids and final.columns[: len(documents.columns)] == documents.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), FOLDER).collect() == []


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_quality_is_a_plain_cosine_vote(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    counts, marks = quality.labelled_sample(docs, labels)
    rows = sorted((r["doc_id"], r["text"], r["score"]) for r in quality.score_quality(docs, labels).select("doc_id", "text", "score").collect())
    own = np.array([quality.term_counts([(t or "").encode()])[0] for _, t, _ in rows], float)
    known = counts[0 : len(counts)].astype(float)
    rarity = np.log((1 + len(known)) / (1 + (known > 0).sum(axis=0))) + 1

    def unit(x):
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.where(length > 1e-12, x / np.maximum(length, 1e-12), 0)

    known, own = unit(np.log1p(known) * rarity), unit(np.log1p(own) * rarity)
    basis = np.linalg.svd(known, full_matrices=False)[2][: quality.DIMENSIONS].T  # the exact leading directions
    near = unit(own @ basis) @ unit(known @ basis).T
    for (_, _, got), cosines in zip(rows, near):
        best = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[best], 0)
        want = float((weight * marks[best]).sum() / weight.sum()) if weight.sum() > 0 else quality.UNKNOWN
        assert abs(got - want) < 1e-3


def test_leading_directions_of_few_rows():
    rows = np.eye(5, quality.TERMS, dtype=np.float32) * np.arange(1, 6, dtype=np.float32)[:, None]
    basis = quality.leading_directions(rows.T @ rows, quality.DIMENSIONS)
    assert np.allclose(basis.T @ basis, np.eye(quality.DIMENSIONS), atol=1e-5)
    assert np.allclose(np.abs(basis[:5, :5]), np.eye(5)[::-1], atol=1e-5)
