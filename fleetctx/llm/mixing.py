"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A budget of tokens is dealt from the root down a tree (domain, language, source). A node can take its supply
times max_epochs. Among siblings the budget is filled like water in proportion to their weights: who is
full passes its shortage to its siblings, and only what a whole family cannot hold reaches the family's own
siblings, since a parent's capacity is the sum of its children's. A leaf spends its quota in epochs: whole
ones, then the token-prefix of the next epoch's seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WS_CLASS, documents, materialize, unveiled

NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), f"{WS_CLASS}+"), "")).cast("long")


def deal(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget_ratio: float, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """leaves (levels..., supply) -> (levels..., supply, quota): whole tokens for each leaf.

    weights: level -> value -> weight among siblings, default_weight where not named; weight 0 takes
    nothing. The budget is budget_ratio times the whole supply. Ties in saturation order fall to names.
    """
    nodes = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("double"))
    dealt = nodes.agg((F.sum("supply") * F.lit(float(budget_ratio))).alias("budget"))
    for depth, level in enumerate(levels, 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        named = weights.get(level, {})
        weight = F.lit(float(default_weight))
        for value, w in named.items():
            weight = F.when(F.col(level) == value, F.lit(float(w))).otherwise(weight)
        here = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", weight).where("w > 0")
        here = here.join(dealt, parent) if parent else here.join(F.broadcast(dealt))  # at the root the budget is one row
        fill = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level)
        lower, upper = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
        here = here.withColumn("lam", (F.col("budget") - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))) / F.sum("w").over(upper))
        here = here.withColumn("full", F.col("cap") <= F.col("lam") * F.col("w")).withColumn("rn", F.row_number().over(fill))
        family = Window.partitionBy(*parent)
        here = here.withColumn("lam", F.min_by("lam", F.when(~F.col("full"), F.col("rn"))).over(family))
        dealt = here.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("lam") * F.col("w"))).alias("budget"))
    return leaves.join(dealt, list(levels)).select(*levels, "supply", F.floor(F.col("budget") + 0.5).cast("long").alias("quota"))


def select(docs: DataFrame, tree: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], budget_ratio: float = 1.0, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, levels..., tokens, n_rows, epoch, take): what each epoch takes of each document.

    Rows equal in doc_id, text and leaf are one document of n_rows copies, taken together. take is below tokens (n_rows copies of
    the text) only for the document in which a leaf's quota ends; the takes of a leaf add up to its quota. Documents without tokens
    come with the first epoch's whole pass only if their place in the order is reached. Null names are '(none)'.
    """
    levels = list(tree)
    leaf = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in tree.items()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), *leaf, n_tokens(F.col(text_col)).alias("tokens"))
    units = materialize(rows.groupBy("doc_id", "th", *levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-units")
    quota = deal(units.groupBy(*levels).agg(F.sum("tokens").alias("supply")), levels, weights, budget_ratio, max_epochs)
    whole = F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply"))).otherwise(0).cast("int")
    quota = materialize(quota.select(*levels, whole.alias("whole"), (F.col("quota") - whole * F.col("supply")).alias("rest")), "mix-quota")
    placed = units.join(quota, levels)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    placed = placed.withColumn("h", order).withColumn("bucket", F.substring("h", 1, 3))
    full = placed.where("whole > 0").select("doc_id", "th", *levels, "tokens", "n_rows", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), F.col("tokens").alias("take"))
    # The prefix of the last epoch: whole buckets by their totals, rows only in the bucket where the quota ends.
    part = placed.where("rest > 0")
    totals = part.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0)))
    part = part.join(totals, [*levels, "bucket"]).where("offset < rest")
    inside = part.where("offset + held <= rest").withColumn("take", F.col("tokens"))
    rank = Window.partitionBy(*levels, "bucket").orderBy("h", "tokens", "th").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.where("offset + held > rest").withColumn("start", F.col("offset") + F.coalesce(F.sum("tokens").over(rank), F.lit(0))).where("start < rest")
    edge = edge.withColumn("take", F.least("tokens", F.col("rest") - F.col("start"))).drop("start")
    last = inside.unionByName(edge).select("doc_id", "th", *levels, "tokens", "n_rows", F.col("whole").alias("epoch"), "take")
    return full.unionByName(last)


def mix(docs: DataFrame, tree: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs dealt to the weights: each row as often as epochs take it, whole, all columns as they are, whatever their names.

    Nulls in doc_id, text or a level are values like others; an empty table stays empty.
    """
    levels = list(tree)
    keys = {"id": F.col(id_col).cast("long"), "th": F.xxhash64(F.col(text_col).cast("string"))} | {f"level{k}": F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in enumerate(tree.values())}
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], *[c.alias(k) for k, c in keys.items()])
    taken = select(docs, tree, weights, id_col=id_col, text_col=text_col, **how).groupBy("doc_id", "th", *levels).agg(F.count(F.lit(1)).cast("int").alias("times"))
    taken = taken.toDF(*[f"taken_{k}" for k in keys], "times")
    on = F.col("id").eqNullSafe(F.col("taken_id"))
    for k in list(keys)[1:]:
        on &= F.col(k) == F.col(f"taken_{k}")
    return unveiled(own.join(taken, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


#: Production parameters for documents: sources of one digit are the web, the others curated.
WEIGHTS = {"domain": {"web": 1.0, "curated": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
BUDGET_RATIO, MAX_EPOCHS, SEED = 1.0, 4, 17


def tree() -> dict[str, Column]:
    domain = F.when(F.coalesce(F.col("source"), F.lit("")).rlike("^src[0-9]$"), "web").otherwise("curated")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op8_hierarchical(spark, sf_dir: str) -> DataFrame:
    """Query op8: documents dealt to WEIGHTS, as many tokens as there are."""
    return select(documents(spark, sf_dir), tree(), WEIGHTS, BUDGET_RATIO, MAX_EPOCHS, SEED).drop("th")


def op8_sql() -> str:
    """The same in DuckDB."""
    levels = ["domain", "lang", "source"]
    weight = {k: "CASE " + k + "".join(f" WHEN '{v}' THEN {w}::DOUBLE" for v, w in WEIGHTS[k].items()) + " ELSE 1.0::DOUBLE END" if k in WEIGHTS else "1.0::DOUBLE" for k in levels}
    steps, last = [f"dealt0 AS (SELECT sum(supply) * {BUDGET_RATIO}::DOUBLE AS budget FROM leaves)"], "dealt0"
    for depth, level in enumerate(levels, 1):
        path, parent = ", ".join(levels[:depth]), ", ".join(levels[: depth - 1])
        by = f"PARTITION BY {parent}" if parent else ""
        steps.append(f"""n{depth} AS (SELECT {path}, sum(supply * {MAX_EPOCHS})::DOUBLE AS cap, {weight[level]} AS w FROM leaves GROUP BY {path}),
f{depth} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam,
  row_number() OVER ({by} ORDER BY cap / w, {level}) AS rn FROM n{depth} {f"JOIN {last} USING ({parent})" if parent else f"CROSS JOIN {last}"}),
l{depth} AS (SELECT {parent + ", " if parent else ""}min_by(lam, rn) FILTER (cap > lam * w) AS level FROM f{depth} {f"GROUP BY {parent}" if parent else ""}),
dealt{depth} AS (SELECT {path}, CASE WHEN cap <= lam * w THEN cap ELSE least(cap, level * w) END AS budget FROM f{depth} {f"JOIN l{depth} USING ({parent})" if parent else f"CROSS JOIN l{depth}"})""")
        last = f"dealt{depth}"
    path = ", ".join(levels)
    return f"""
WITH base AS (SELECT doc_id::BIGINT AS doc_id, text, CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS t FROM documents),
units AS (SELECT doc_id, {path}, sum(t)::BIGINT AS tokens, count(*) AS n_rows FROM base GROUP BY doc_id, text, {path}),
leaves AS (SELECT {path}, sum(tokens) AS supply FROM units GROUP BY {path}),
{", ".join(steps)},
quota AS (SELECT {path}, supply, floor(budget + 0.5)::BIGINT AS quota, CASE WHEN supply > 0 THEN floor(floor(budget + 0.5) / supply) ELSE 0 END::INT AS whole FROM leaves JOIN {last} USING ({path})),
placed AS (SELECT units.*, whole, (quota - whole * supply)::BIGINT AS rest, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM units JOIN quota USING ({path})),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {path} ORDER BY h, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM placed)
SELECT doc_id, {path}, tokens, n_rows, e::INT AS epoch, tokens AS take FROM placed, unnest(range(0, whole)) x(e)
UNION ALL SELECT doc_id, {path}, tokens, n_rows, whole AS epoch, least(tokens, rest - start) AS take FROM run WHERE start < rest"""
