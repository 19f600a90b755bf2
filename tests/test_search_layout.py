"""Paging, text search and key lookups over a laid-out table: same rows as a scan, few files read."""

from pyspark.sql import functions as F

from terraspan.functions.text import row_contains
from terraspan.sources.search_layout import write_search_layout


def _rows(spark):
    text = F.concat(F.lit("scene-"), F.sha2(F.col("id").cast("string"), 256).substr(1, 6), F.lit("/B04.TIF"))
    note = F.when(F.col("id") == 617, "Straße 🚲🚲x").when(F.col("id") % 5 == 0, F.lit(None).cast("string")).otherwise("ok")
    return spark.range(2000).select(F.format_string("k%05d", (F.col("id") * 7) % 2000).alias("key"), text.alias("path"), note.alias("note"), F.array("id").alias("ids"))


def test_layout_reads_few_files(spark, tmp_path):
    df = _rows(spark)
    laid = write_search_layout(df, str(tmp_path / "t"), ["key"], keys=["key"], rows_per_part=100)
    assert laid.parts == 20 and laid.rows == 2000
    every = len(laid.read().inputFiles())
    assert every == 20

    def same(text, most):
        got = laid.search(text)
        assert got.columns == df.columns
        want = df.filter(row_contains(text, df.columns))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert len(got.inputFiles()) <= most
        return want.count()

    rare = df.filter("id = 900" if "id" in df.columns else "key = 'k00900'").first()["path"]
    assert same(rare.upper()[:14], 4) == 1  # few parts hold all of its trigrams
    assert same("STRASSE", 0) == 0 and same("straße 🚲", 1) == 1 and same("🚲🚲X", 1) == 1
    assert same("b04.tif", every) == 2000 and same("ok", every) > 1000 and same("", every) == 2000
    assert same("[617]", 2) == 1

    page = laid.page(1150, 100)
    assert [r["key"] for r in page.collect()] == [f"k{n:05d}" for n in range(1150, 1250)] and len(page.inputFiles()) == 2
    assert laid.page(1995, 100).count() == 5 and laid.page(5000, 10).count() == 0
    assert [r["path"] for r in laid.lookup(key="k00123").collect()] == [r["path"] for r in df.filter("key = 'k00123'").collect()]
    assert len(laid.lookup(key="k00123").inputFiles()) <= 3 and laid.lookup(key="none").count() == 0
    assert laid.lookup(key="k00123", note="nothing of it").count() == 0


def test_layout_of_an_empty_table_and_odd_values(spark, tmp_path):
    schema = "part INT, gram STRING"  # names the layout uses itself
    empty = write_search_layout(spark.createDataFrame([], schema), str(tmp_path / "e"), ["part"])
    assert empty.parts == 0 and empty.search("abc").count() == 0 == empty.page().count() and empty.read().count() == 0
    long = "x" * 200_000 + "needle" + "y" * 200_000
    odd = write_search_layout(spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, long), (5, "a\nb'c"), (6, None)], schema), str(tmp_path / "o"), ["part"], rows_per_part=2)
    assert [r["part"] for r in odd.search("NEEDLE").collect()] == [4] and [r["part"] for r in odd.search("\nb'").collect()] == [5]
    assert [r["part"] for r in odd.search("ab").collect()] == [3] and odd.page(0, 9).count() == 6


def test_many_parts_share_folders(spark, tmp_path, monkeypatch):
    """Of a layout of very many parts some share a file; pages, texts and keys find the same rows."""
    from terraspan.sources import search_layout

    monkeypatch.setattr(search_layout, "MOST_FOLDERS", 4)
    df = _rows(spark)
    laid = search_layout.write_search_layout(df, str(tmp_path / "t"), ["key"], keys=["key"], rows_per_part=30)
    assert laid.parts == 67 and len(laid.read().inputFiles()) == 4
    assert [r["key"] for r in laid.page(505, 40).collect()] == [f"k{n:05d}" for n in range(505, 545)]
    for text in ("straße 🚲", "b04.tif", "ok", "[617]", "k00"):
        want = df.filter(row_contains(text, df.columns))
        assert sorted(map(tuple, laid.search(text).collect())) == sorted(map(tuple, want.collect())), text
    assert len(laid.lookup(key="k00123").inputFiles()) == 1 == laid.lookup(key="k00123").count()
    assert sorted(r["_rank"] for r in laid.read([0, 1, 40]).collect()) == [*range(1, 61), *range(1201, 1231)]
