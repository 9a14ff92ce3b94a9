"""Health checks and the day's activity, as small frames."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import ledger as L
from .brief import DAY_S

#: Bounds of the checks.
LAG_WARN, LEAST_RATE = 500, 0.15
ORDER = ["ok", "warn", "error"]


def _row(df: DataFrame, name: str, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))


def checks(events: DataFrame, cursor: int, ledger: DataFrame, plan: DataFrame, decisions: DataFrame, claims: DataFrame, versions: tuple[str, str] | None = None, stored: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(check, status, detail) of migration parity, cursor, referents, effectiveness, echo, labels and version.

    stored: tables as they lie on disk, by name; columns that today's schema has and they lack are named.
    """
    spark = events.sparkSession
    gaps = schema.migration_gaps() + [f"{name}.{c}" for name, df in sorted((stored or {}).items()) for c in schema.TABLES[name].fieldNames() if c not in df.columns]
    one = spark.range(1)
    lag = F.col("head") - cursor
    head = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("head"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("project", F.lit("")) == "").alias("bare"))
    lost = L.dangling(ledger, plan, decisions).agg(F.count(F.lit(1)).alias("lost"))
    echo = claims.where((F.col("status") == "asserted") & (F.col("subject").ilike("fleet-context%") | F.col("subject").ilike("%moving target%"))).agg(F.count(F.lit(1)).alias("echoes"))
    low = F.col("rate").isNotNull() & (F.col("rate") < LEAST_RATE)
    rows = [
        _row(one, "schema.migration_parity", F.lit("error" if gaps else "ok"), F.lit(", ".join(gaps) or "schema and migrations agree")),
        _row(head, "projector.cursor", F.when(lag < 0, "error").when(lag > LAG_WARN, "warn").otherwise("ok"), F.concat(F.lit(f"cursor {cursor} / log head "), F.col("head").cast("string"))),
        _row(lost, "ledger.referents", F.when(F.col("lost") > 0, "warn").otherwise("ok"), F.concat(F.col("lost").cast("string"), F.lit(" refs name no row"))),
        _row(L.effectiveness(ledger), "delivery.effectiveness", F.when(low, "warn").otherwise("ok"), F.concat(F.col("used").cast("string"), F.lit("/"), F.col("delivered").cast("string"), F.lit(" delivered items acted on"))),
        _row(echo, "memory.echo", F.when(F.col("echoes") > 0, "error").otherwise("ok"), F.concat(F.col("echoes").cast("string"), F.lit(" claims derived from an injected brief"))),
        _row(head, "tenant.labelling", F.when(F.col("bare") > 0, "warn").otherwise("ok"), F.concat(F.col("bare").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" events with no project label"))),
    ]
    if versions is not None:
        rows.append(_row(one, "release.version", F.lit("ok" if versions[0] == versions[1] else "error"), F.lit(f"package {versions[0]}, metadata {versions[1]}")))
    return reduce(DataFrame.unionByName, rows)


def worst(report: DataFrame) -> DataFrame:
    """One row (status): the worst of a report."""
    rank = F.max(F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")))
    return report.agg(F.coalesce(F.element_at(F.array(*map(F.lit, ORDER)), rank.cast("int")), F.lit("ok")).alias("status"))


def activity(events: DataFrame, tool_events: DataFrame, ledger: DataFrame, decisions: DataFrame, awareness: DataFrame, as_of: float) -> DataFrame:
    """One row of the last 24 hours: sessions, deliveries, agents reached, traversals, tool calls and errors; standing decisions, active agents."""
    since = as_of - DAY_S
    late = F.col("ts") > since
    parts = [
        events.where(late).agg(F.count_if(F.col("kind") == "session.start").alias("sessions_started"), F.count_if((F.col("kind") == "observation") & F.col("payload").ilike("%traversal%")).alias("traversals")),
        ledger.where(F.col("delivered_at") > since).agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("agent_id").alias("agents_reached")),
        tool_events.where(late).agg(F.coalesce(F.sum("is_error"), F.lit(0)).cast("long").alias("tool_errors"), F.count(F.lit(1)).alias("tool_calls")),
        decisions.agg(F.count_if(F.col("status") == "standing").alias("open_decisions")),
        awareness.agg(F.count_if(F.col("status") == "active").alias("live_agents")),
    ]
    return reduce(lambda a, b: a.join(b), parts)  # one row each


def top_asked(events: DataFrame, as_of: float, limit: int = 3) -> DataFrame:
    """(q, n) most asked in 24 hours; payloads that are no JSON have no question."""
    rows = events.where((F.col("kind") == "observation") & F.col("payload").ilike("%traversal%") & (F.col("ts") > as_of - DAY_S))
    return rows.groupBy(F.get_json_object("payload", "$.q").alias("q")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("q")).limit(limit)


def as_text(report: DataFrame) -> str:
    """A report's lines, the worst status first."""
    rows = report.collect()  # seven checks
    return "\n".join([worst(report).first().status, *(f"  {r.status:5} {r.check}: {r.detail}" for r in rows)])


def as_json(report: DataFrame) -> str:
    return json.dumps({"status": worst(report).first().status, "checks": [r.asDict() for r in report.collect()]}, sort_keys=True)


def verdict(stats: dict, judge=None) -> str:
    """A judge's text on the stats, or a fixed sentence where there is none or it fails."""
    try:
        said = judge(stats) if judge else ""
    except Exception:  # noqa: BLE001  whatever a model call raises, the report stands
        said = ""
    return said or f"{stats['sessions_started']} sessions, {stats['deliveries']} deliveries, {stats['tool_errors']}/{stats['tool_calls']} tool errors."


def assessment(stats: DataFrame, asked: DataFrame, judge=None) -> str:
    """The day as text: a row of activity(), the questions of top_asked(), and the verdict on both."""
    row = stats.first().asDict()
    lines = [f"  {k.replace('_', ' ')}: {v}" for k, v in row.items()]
    lines += [f"  asked {r.n} times: {r.q}" for r in asked.collect()]  # at most its limit
    return "\n".join(["last 24 hours", *lines, verdict(row, judge)])
