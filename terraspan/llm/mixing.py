"""Mixing sources to target weights by hierarchical token budgets.

The budget is handed down a tree of domains, languages and sources in proportion to the
weights. A node can take no more than its tokens times ``max_epochs``; what it cannot
take goes to its siblings first, in proportion to their weights, and only what a whole
subtree cannot take goes to the siblings of its parent. All shares are whole tokens.

Each source is then read in seeded order, epoch by epoch: all of it for every full epoch
its share covers, and a prefix of as many tokens as remain of one more epoch, whose order
depends on seed, epoch and document. The running token count of a source is computed over
range partitions, so a source may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from ..session import materialize
from .batches import without

LEVELS = ("domain", "lang", "source")
# Production parameters: relative weights by name (1 where none is given), share of all tokens, epochs at most.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARE = (3, 4)
MAX_EPOCHS = 2
SEED = 17
TOKEN = r"[^ \t\n\r\f]+"


def domain_of(source: Column) -> Column:
    """Domain of a source: d0 to d3 by the number at the end of its name, d0 without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.right(number, F.lit(9)).try_cast("bigint") % 4, F.lit(0)).cast("string"))


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, levels, n_tokens) of documents with an id and at least one token; one row per id.

    Tokens are runs of anything but white space. A missing language or source is called
    "none". Of rows that repeat an id the one smallest by these columns counts.
    """
    name = {"lang": F.coalesce("lang", F.lit("none")), "source": F.coalesce("source", F.lit("none")), "domain": domain_of(F.col("source"))}
    rows = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), *[name[level].alias(level) for level in LEVELS], F.regexp_count(text, F.lit(TOKEN)).cast("bigint").alias("n_tokens")
    )
    first = rows.groupBy("doc_id").agg(F.min(F.struct(*LEVELS, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))).alias("_row"))
    return first.select("doc_id", "_row.*").filter("n_tokens > 0")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    rule = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        rule = F.when(F.col(level) == name, F.lit(weight)).otherwise(rule)
    return rule.cast("decimal(38,0)")


def _share_out(children: DataFrame, parent: Sequence[str], own: str) -> DataFrame:
    """``_budget`` of each child from ``_given`` of its parent, by ``_weight`` up to ``_room``.

    Children are filled in the order of room per weight. One is full when its fair part of
    what the fuller ones before it leave exceeds its room; the others divide the rest, and
    tokens lost to rounding go one by one to the first of them by name.
    """
    children = children.filter("_weight > 0")
    ratio = F.col("_room").cast("double") / F.col("_weight").cast("double")
    order = Window.partitionBy(*parent).orderBy(ratio, own)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    placed = children.withColumns({
        "_left": F.col("_given") - F.coalesce(F.sum("_room").over(before), F.lit(0)), "_weights": F.sum("_weight").over(after),
    })
    full = F.col("_room") * F.col("_weights") <= F.col("_left") * F.col("_weight")
    whole = Window.partitionBy(*parent)
    open_ = ~F.col("_full")
    placed = placed.withColumn("_full", full).withColumns({
        "_rest": F.col("_given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_room"))).over(whole), F.lit(0)),
        "_open": F.sum(F.when(open_, F.col("_weight"))).over(whole),
    })
    part = F.when(F.col("_full"), F.col("_room")).otherwise(F.expr("floor(_rest * _weight div _open)").cast("decimal(38,0)"))
    placed = placed.withColumn("_part", part)
    lost = F.col("_rest") - F.sum(F.when(open_, F.col("_part"))).over(whole)
    turn = F.row_number().over(Window.partitionBy(*parent, "_full").orderBy(own))
    extra = F.when(open_ & (turn <= lost), 1).otherwise(0)
    return placed.withColumn("_budget", (F.col("_part") + extra).cast("decimal(38,0)"))


def budgets(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(levels, available, budget) of every source, from (levels, available)."""
    room = leaves.withColumn("_room", (F.col("available") * max_epochs).cast("decimal(38,0)"))
    given: DataFrame | None = None
    for depth in range(len(LEVELS)):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = room.groupBy(*path).agg(F.sum("_room").cast("decimal(38,0)").alias("_room"), F.sum("available").alias("available"))
        nodes = nodes.withColumn("_weight", _weight(LEVELS[depth], weights))
        nodes = nodes.withColumn("_given", F.lit(budget).cast("decimal(38,0)")) if given is None else nodes.join(given, parent)
        given = _share_out(nodes, parent or [F.lit(0)], LEVELS[depth]).select(*path, F.col("_budget").alias("_given"), "available")
        if depth < len(LEVELS) - 1:
            given = given.drop("available")
    return given.select(*LEVELS, "available", F.col("_given").cast("bigint").alias("budget"))


def select_mix(
    docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS,
    seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The mix: doc_id, levels, n_tokens, epochs (in how many it is read) and taken_tokens (over all epochs).

    Documents of which nothing is taken are absent, as are those without id or tokens. The
    last document of a source's prefix may be taken in part. Weights are whole numbers; a
    node of weight 0 gets nothing. An empty table gives an empty mix.
    """
    tokens = materialize(token_table(docs, doc_id, text))
    leaves = materialize(tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available")))
    total = leaves.agg(F.sum("available")).first()[0] or 0
    shares = budgets(leaves, total * share[0] // share[1], weights, max_epochs).withColumns({
        "_epochs": F.expr("budget div available"), "_rest": F.expr("budget % available"),
    })
    shares = materialize(shares.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "_epochs", "_rest"))
    same = F.lit(True)
    for level in LEVELS:
        same = same & (F.col(level) == F.col(f"_{level}"))
    # sources are few beside documents, but one of them may hold most of these: the join leaves the choice to its measured size
    drawn = tokens.join(shares, same).drop(*[f"_{c}" for c in LEVELS])
    drawn = drawn.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("_epochs"), F.col("doc_id")).cast("binary")))
    counted = running_total(drawn, LEVELS, ["_key", "doc_id"], "n_tokens", "_upto")
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("_rest") - (F.col("_upto") - F.col("n_tokens"))))
    return counted.withColumn("_part", part).select(
        "doc_id", *LEVELS, "n_tokens", (F.col("_epochs") + F.when(F.col("_part") > 0, 1).otherwise(0)).cast("bigint").alias("epochs"),
        (F.col("_epochs") * F.col("n_tokens") + F.col("_part")).cast("bigint").alias("taken_tokens"),
    ).filter("taken_tokens > 0")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The chosen rows of ``docs`` with domain, n_tokens, epochs and taken_tokens; one row per id."""
    added = ["domain", "n_tokens", "epochs", "taken_tokens"]
    chosen = select_mix(docs, doc_id=doc_id, text=text, **parameters).select(F.col("doc_id").alias("_chosen"), *added)
    rows = without(docs, [*added, "_chosen", "_turn"])
    columns = rows.columns
    joined = rows.join(chosen, F.col(doc_id) == F.col("_chosen")).drop("_chosen")
    turn = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last()))
    return joined.withColumn("_turn", turn).filter("_turn = 1").select(*columns, *added)


def _case(level: str, weights: Mapping[str, Mapping[str, int]]) -> str:
    rules = " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights.get(level, {}).items())
    return f"CASE {level} {rules} ELSE 1 END" if rules else "1"


def mix_sql(documents: str = "documents", weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for :func:`select_mix` over a relation with unique ids."""
    steps = [f"""tokens AS (
  SELECT * FROM (SELECT doc_id, 'd' || (coalesce(try_cast(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) AS BIGINT), 0) % 4)::VARCHAR AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens
  FROM {documents} WHERE doc_id IS NOT NULL) WHERE n_tokens > 0)""",
             "leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS available FROM tokens GROUP BY ALL)"]
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent}" if parent else ""
        given = f"(SELECT sum(available) * {share[0]} // {share[1]} FROM leaves)" if not depth else "given"
        source = f"nodes{depth}" if not depth else f"nodes{depth} JOIN given{depth - 1} USING ({parent})"
        steps += [
            f"nodes{depth} AS (SELECT {path}, sum(available * {max_epochs}) AS room, sum(available) AS available, {_case(level, weights)}::HUGEINT AS weight FROM leaves GROUP BY {path})",
            f"""placed{depth} AS (SELECT *, room * weights <= rest_before * weight AS filled FROM (
  SELECT *, total - coalesce(sum(room) OVER ({by} ORDER BY room::DOUBLE / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_before,
    sum(weight) OVER ({by} ORDER BY room::DOUBLE / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM (SELECT nodes{depth}.*, {given} AS total FROM {source} WHERE weight > 0)))""",
            f"""parts{depth} AS (SELECT *, CASE WHEN filled THEN room ELSE rest * weight // opened END AS part FROM (
  SELECT *, total - coalesce(sum(room) FILTER (filled) OVER ({by}), 0) AS rest, sum(weight) FILTER (NOT filled) OVER ({by}) AS opened FROM placed{depth}))""",
            f"""given{depth} AS (SELECT {path}, available, part + CASE WHEN NOT filled AND turn <= lost THEN 1 ELSE 0 END AS given FROM (
  SELECT *, rest - sum(part) FILTER (NOT filled) OVER ({by}) AS lost, row_number() OVER (PARTITION BY {parent + ', ' if parent else ''}filled ORDER BY {level}) AS turn FROM parts{depth}))""",
        ]
        if depth < len(LEVELS) - 1:
            steps[-1] = steps[-1].replace(f"SELECT {path}, available,", f"SELECT {path},", 1)
    last = len(LEVELS) - 1
    steps += [
        f"drawn AS (SELECT t.*, given // available AS full_epochs, given % available AS rest, md5('{seed}:' || (given // available)::VARCHAR || ':' || doc_id::VARCHAR) AS key FROM tokens t JOIN given{last} USING (domain, lang, source))",
        "counted AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM drawn)",
        "taken AS (SELECT *, greatest(0, least(n_tokens, rest - before)) AS part FROM counted)",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, domain, lang, source, n_tokens, (full_epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT AS epochs,
  (full_epochs * n_tokens + part)::BIGINT AS taken_tokens
FROM taken WHERE full_epochs * n_tokens + part > 0"""
