"""Keyword retrieval at a character budget, and graders of answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no question.
STOPWORDS = frozenset("what which when where have does that this with from they were been there their about into than then them".split())
WORDS, LINE_CHARS = 8, 200


def keywords(question: str) -> list[str]:
    """The first eight words, hyphens included, of four characters or more that are no stopwords."""
    return [w for w in (x.lower() for x in re.findall(r"[A-Za-z][A-Za-z-]{3,}", question)) if w not in STOPWORDS][:WORDS]


def retrieve(lines: DataFrame, question: str, budget: int, block: int = 1024) -> DataFrame:
    """Of lines (id, text) those that hold enough keywords, in order of id, until the budget is passed.

    A line is kept if it holds max(1, a quarter, rounded down) of the keywords; it counts with 200 characters at most and one for
    its end. The line that passes the budget is the last, cut where the budget ends. Where no line is kept, or nothing is asked,
    the first lines of all stand. Running sums are taken in blocks of ids, so no task sees all lines.
    """
    words = keywords(question)
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    rows = lines.select("id", F.left(F.coalesce("text", F.lit("")), F.lit(LINE_CHARS)).alias("line"), F.coalesce(hits, F.lit(0)).alias("hits")).withColumn("size", F.length("line") + 1)
    kept = rows.where(F.col("hits") >= max(1, len(words) // 4)) if words else rows
    if words and kept.isEmpty():
        kept = rows
    shown = running(kept, budget + 1, block)
    return shown.select("id", F.left("line", F.lit(budget).cast("long").cast("int") - F.col("before").cast("int")).alias("line"), "hits")


def running(rows: DataFrame, budget: int, block: int = 1024) -> DataFrame:
    """rows (id, size, ...) with `before`, the sizes ahead of each, while that is below the budget."""
    rows = rows.withColumn("block", F.floor(F.col("id") / block))
    totals = rows.groupBy("block").agg(F.sum("size").alias("held"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = totals.withColumn("offset", F.coalesce(F.sum("held").over(ahead), F.lit(0))).where(F.col("offset") < budget)
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals.select("block", "offset"), "block")
    return rows.withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).where(F.col("before") < budget).drop("block", "offset")


def holds_all(answer: Column, *wanted: str) -> Column:
    return F.array_min(F.array(*[F.contains(F.lower(answer), F.lit(w.lower())) for w in wanted])).cast("double")


def holds_any(answer: Column, *wanted: str) -> Column:
    return F.array_max(F.array(*[F.contains(F.lower(answer), F.lit(w.lower())) for w in wanted])).cast("double")


def near_number(answer: Column, value: float, tolerance: float) -> Column:
    """1 if any number in the answer, or that number of percent, is within tolerance of value."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"(-?\d+(?:\.\d+)?)")), lambda x: x.cast("double"))
    return F.exists(numbers, lambda x: (F.abs(x - value) <= tolerance) | (F.abs(x - value * 100) <= tolerance * 100)).cast("double")


def mean_of(*grades: Column) -> Column:
    return sum(grades[1:], grades[0]) / len(grades)
