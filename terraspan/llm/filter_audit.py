"""Audit of how document filters interact, for every order in which they could be applied.

Each document fails some of the filters; the set it fails is a mask. Spark counts the
documents of each part (source) and mask, split by what ``labels`` say of them. From
then on only those cells matter, at most ``2 ** filters`` a part, however many documents
there are. A Gray-code walk visits all subsets of active filters and toggles one filter
a step: every cell keeps a counter of the active filters it fails, and a cell that goes
from zero to one, or back, is all that changes the running survivors. The survivors of
each subset are stored; a step of an order is the difference of two of them.

Identical texts are told by their SHA-256. Equal texts fail the same filters, so they are
folded by (text, part, labels) before the shuffle, and a text that stands in a third of
all rows stays one small row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[ \t-\r]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 200
MIN_DISTINCT = 50  # distinct words in 100
MAX_CAPITALS = 2  # capitals in 100 code points
SIGNS = r"[#$%&*|]"
# The last filter of the query compares rows; the others look at one text.
REPEATED = "E"
COUNTS = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

Filters = dict[str, Callable[[Column, Column], Column]]

# Failure conditions, given a text that is not null and its words.
TEXT_FILTERS: Filters = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * MIN_DISTINCT,
    "C": lambda text, words: (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS,
    "D": lambda text, words: text.rlike(SIGNS),
}


def failure_masks(docs: DataFrame, filters: Filters = TEXT_FILTERS, part: str = "source") -> DataFrame:
    """One row (_id, _part, _digest, _mask) for each row of ``docs``: bit i is set where the text fails filter i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    words = F.filter(F.split("_text", BLANKS), lambda w: w != "")

    def failed(words: Column) -> Column:
        return sum((F.when(fails(F.col("_text"), words), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))

    mask = F.transform(F.array(words), failed)[0]  # the words are cut once
    return rows.select("_id", "_part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"), mask.cast("int").alias("_mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, repeated: int) -> DataFrame:
    """Documents by part and mask (part, mask, n, good, toxic); ``repeated`` is the bit of texts that a smaller id has too.

    A row without id has no smaller one and is none itself. A document labelled in several
    rows is good or toxic if one of them says so.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_known")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    kind = ["_part", "_mask", "_good", "_toxic"]
    marked = masks.join(marks, F.col("_id") == F.col("_known"), "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("_good", "_toxic")}
    )
    # rows of one id stay where the join has put them
    ids = marked.groupBy("_id", "_digest", *kind).agg(F.count(F.lit(1)).alias("_n"))
    loose = ids.filter(F.col("_id").isNull()).select(*kind, "_n")
    texts = ids.filter(F.col("_id").isNotNull()).groupBy("_digest", *kind).agg(
        F.sum("_n").alias("_all"), F.min("_id").alias("_first"), F.min_by("_n", "_id").alias("_rows")
    )
    # a text has at most one row for each part and pair of labels here
    own = F.col("_first") == F.min("_first").over(Window.partitionBy("_digest"))
    split = texts.withColumn("_kept", F.when(own, F.col("_rows")).otherwise(0))
    split = split.select(*kind, F.explode(F.array(
        F.struct(F.lit(0).alias("_bit"), F.col("_kept").alias("_n")),
        F.struct(F.lit(repeated).alias("_bit"), (F.col("_all") - F.col("_kept")).alias("_n")),
    )).alias("_c"))
    split = split.select("_part", (F.col("_mask") + F.col("_c._bit")).alias("_mask"), "_good", "_toxic", F.col("_c._n").alias("_n"))
    return split.unionByName(loose).groupBy(F.col("_part").alias("part"), F.col("_mask").alias("mask")).agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_good"), F.col("_n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic"), F.col("_n")).otherwise(0)).alias("toxic"),
    )


def walk(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of active filters, from the ``2 ** filters`` cells of a part (rows) and their measures (columns)."""
    subsets = 1 << filters
    failing = [[m for m in range(subsets) if m >> f & 1] for f in range(filters)]
    active_failures = [0] * subsets
    running = cells.sum(axis=0)
    out = np.zeros_like(cells)
    out[0] = running
    active = 0
    for step in range(1, subsets):
        turned = (step & -step).bit_length() - 1  # the bit in which consecutive Gray codes differ
        active ^= 1 << turned
        change = 1 if active >> turned & 1 else -1
        for mask in failing[turned]:
            before = active_failures[mask]
            active_failures[mask] = before + change
            if before + change == 1 and change == 1:
                running = running - cells[mask]
            elif before == 1 and change == -1:
                running = running + cells[mask]
        out[active] = running
    return out


def steps(survivors: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """All steps of all orders of the filters ``names``, as differences of ``survivors`` (documents, good, toxic)."""
    n = len(names)
    everything = (1 << n) - 1
    fails = [int(survivors[0, 0] - survivors[1 << f, 0]) for f in range(n)]
    alone = [int(survivors[everything ^ (1 << f), 0] - survivors[everything, 0]) for f in range(n)]
    rows, shapley = [], [0] * n
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in survivors[before] - survivors[after])
            shapley[f] += removed
            rows.append(("".join(names[i] for i in order), step, int(survivors[after, 0]), removed, fails[f] - removed, alone[f], good, toxic, f))
            before = after
    out = pd.DataFrame(rows, columns=["filter_order", "step", "kept", *COUNTS])
    out["shapley"] = [shapley[f] for f in out["shapley"]]
    return out


def audit_cells(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Steps of every order for each part of ``cells`` (part, mask, n, good, toxic)."""
    subsets = 1 << len(names)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((subsets, 3), np.int64)
        table[part["mask"].to_numpy()] = part[["n", "good", "toxic"]].to_numpy(np.int64)
        out = steps(walk(table, len(names)), names)
        out.insert(0, "part", part["part"].iloc[0])
        return out

    counts = ", ".join(f"{c} long" for c in ("kept", *COUNTS))
    return cells.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {counts}")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Filters = TEXT_FILTERS, part: str = "source") -> DataFrame:
    """Effect of each filter at each step of every order, per value of ``part``.

    ``filters`` are named by single letters and hold where a text fails; ``REPEATED`` is added
    as the last one. Result: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley, one row per part, order and step,
    zeros included. A null text is empty, a null part the empty string. Repeated rows
    count each time; rows of one id do not repeat one another. Documents without labels
    are neither good nor toxic. Only doc_id, text and the part are read of ``docs``, doc_id,
    quality and toxic of ``labels``; other columns play no role. No documents, no rows.
    """
    masks = failure_masks(docs, filters, part)
    return audit_cells(mask_cells(masks, labels, 1 << len(filters)), [*filters, REPEATED])


def audit_sql() -> str:
    """DuckDB SQL for the query: every order and step judged on the documents' masks themselves."""
    return r"""
WITH flags AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT body, min(doc_id) AS first_id FROM flags GROUP BY body),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(body) - length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(body))::INT
    + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, FALSE)::INT AS mask
  FROM flags JOIN firsts USING (body) LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masked GROUP BY ALL
), letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31
), places AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT part, filter_order, step::INT AS step, own,
    coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM counted, places GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""
