"""The fold: projections as functions of the log, in closed form.

No row is replayed. The first open of a node decides who owns it; later rows of other tenants are refused;
of the accepted rows the latest by id decides each attribute. A rebuild and an incremental run are thereby
the same query with another bound on id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT, as_long, as_text, capped, fields, payload_object, text_or, too_long, truthy

PLAN_STATUS = {"plan.claim": "claimed", "plan.done": "done", "plan.block": "blocked"}
PLAN_KINDS = ["plan.open", *PLAN_STATUS]
DECISION_KINDS = ["decision.make", "decision.supersede"]
SESSION_KINDS = ["session.start", "session.end"]
#: Fields that hold whole numbers; an event with one beyond 64 bits is a dead letter: counted, skipped, and the fold goes on.
NUMBERS = frozenset(("node", "node_id", "root_id", "decision", "decision_id", "target", "scope_root"))
KINDS = [*PLAN_KINDS, *DECISION_KINDS, "claim.assert", *SESSION_KINDS]


def _log(events: DataFrame, kinds: list[str], upto: int | None, *keys: str) -> DataFrame:
    """Events of some kinds with the fields of their payloads; each payload is parsed once."""
    rows = events.where(F.col("kind").isin(kinds))
    if upto is not None:
        rows = rows.where(F.col("id") <= upto)
    rows = rows.select("id", "ts", "kind", "actor", F.coalesce("project", F.lit(DEFAULT)).alias("project"), payload_object(F.col("payload"), *keys).alias("v"))
    rows = rows.select("id", "ts", "kind", "actor", "project", *fields("v", *keys))
    numbers = [too_long(k) for k in keys if k in NUMBERS]
    return rows.withColumn("dead", reduce(lambda a, b: a | b, numbers, F.lit(False)))


def _guarded(rows: DataFrame) -> DataFrame:
    """rows (target, id, is_open, project, ...) with first_id, owner_project, refused, accepted."""
    first = rows.where("is_open and target is not null").groupBy("target").agg(F.min(F.struct("id", "project")).alias("first"))
    rows = rows.join(first.select("target", F.col("first.id").alias("first_id"), F.col("first.project").alias("owner_project")), "target", "left")
    refused = (F.col("id") > F.col("first_id")) & (F.col("project") != F.col("owner_project"))
    accepted = (F.col("id") >= F.col("first_id")) & (F.col("project") == F.col("owner_project"))
    return rows.select("*", F.coalesce(refused, F.lit(False)).alias("refused"), F.coalesce(accepted, F.lit(False)).alias("accepted"))


def _latest(value: str | Column, when: Column | None = None) -> Column:
    at = F.col("id") if when is None else F.when(when, F.col("id"))
    return F.max_by(value, at)


def plan_rows(events: DataFrame, upto: int | None = None) -> DataFrame:
    """Plan events with their target and whether the tenant guard takes them."""
    is_open = F.col("kind") == "plan.open"
    opened = F.coalesce(F.when(F.coalesce(as_text("node_id"), F.lit("")) != "", as_long("node_id")), F.col("id"))
    moved = F.when(truthy("node"), as_long("node")).otherwise(as_long("node_id"))
    status = F.col("kind")
    for kind, name in PLAN_STATUS.items():
        status = F.when(F.col("kind") == kind, name).otherwise(status)
    named = F.when(truthy("owner"), as_text("owner"))
    owner = F.when(is_open | (F.col("kind") == "plan.claim"), F.coalesce(named, F.col("actor"))).otherwise(named)
    return _guarded(
        _log(events, PLAN_KINDS, upto, "node", "node_id", "root_id", "kind", "title", "status", "owner", "origin", "shared").where("not dead").select(
            "id",
            "kind",
            "project",
            is_open.alias("is_open"),
            F.when(is_open, opened).otherwise(moved).alias("target"),
            F.when(is_open, text_or("status", F.lit("open"), 40)).otherwise(status).alias("status"),
            capped(owner, 80).alias("owner"),
            (is_open | (F.coalesce(owner, F.lit("")) != "")).alias("sets_owner"),
            F.when(is_open, F.struct(as_long("root_id").alias("root_id"), text_or("kind", F.lit("goal"), 40).alias("kind"), text_or("title", F.lit(""), 300).alias("title"), text_or("origin", F.col("project"), 80).alias("origin"), truthy("shared").cast("int").alias("shared"))).alias("open"),
        )
    )


def plan_node(events: DataFrame, upto: int | None = None) -> DataFrame:
    """The plan: one row a node, as PLAN_NODE."""
    rows = plan_rows(events, upto).where("accepted")
    state = rows.groupBy("target").agg(_latest("open", F.col("is_open")).alias("o"), _latest("status").alias("status"), _latest("owner", F.col("sets_owner")).alias("owner"), F.first("owner_project").alias("project"))
    return state.select(F.col("target").alias("id"), "o.root_id", "o.kind", "o.title", "status", "owner", "project", "o.origin", "o.shared")


def decision_rows(events: DataFrame, upto: int | None = None) -> DataFrame:
    is_open = F.col("kind") == "decision.make"
    made = F.coalesce(F.when(F.coalesce(as_text("decision_id"), F.lit("")) != "", as_long("decision_id")), F.col("id"))
    aimed = F.when(truthy("decision"), as_long("decision")).when(truthy("decision_id"), as_long("decision_id")).otherwise(as_long("target"))
    return _guarded(
        _log(events, DECISION_KINDS, upto, "decision", "decision_id", "target", "scope_root", "subject", "choice", "rationale", "binds", "status", "origin", "shared").where("not dead").select(
            "id",
            "kind",
            "project",
            is_open.alias("is_open"),
            F.when(is_open, made).otherwise(aimed).alias("target"),
            F.when(is_open, text_or("status", F.lit("standing"), 40)).otherwise(F.lit("superseded")).alias("status"),
            F.when(is_open, F.struct(as_long("scope_root").alias("scope_root"), *(text_or(k, F.lit(""), n).alias(k) for k, n in (("subject", 200), ("choice", 500), ("rationale", 800), ("binds", 300))), text_or("origin", F.col("project"), 80).alias("origin"), truthy("shared").cast("int").alias("shared"))).alias("open"),
        )
    )


def decision(events: DataFrame, upto: int | None = None) -> DataFrame:
    """Decisions, as DECISION."""
    state = decision_rows(events, upto).where("accepted").groupBy("target").agg(_latest("open", F.col("is_open")).alias("o"), _latest("status").alias("status"), F.first("owner_project").alias("project"))
    return state.select(F.col("target").alias("id"), "o.scope_root", "o.subject", "o.choice", "o.rationale", "o.binds", "status", "project", "o.origin", "o.shared")


def claim(events: DataFrame, upto: int | None = None, block: int = 4096) -> DataFrame:
    """Claims, as CLAIM; keyed by the event that asserted them. id counts them in the order of the log, in blocks of event ids."""
    rows = _log(events, ["claim.assert"], upto, "subject", "predicate", "body", "confidence", "status", "source")
    rows = rows.select(F.col("id").alias("asserted_by"), text_or("subject", F.lit(""), 200).alias("subject"), text_or("predicate", F.lit(""), 120).alias("predicate"), text_or("body", F.lit(""), 1000).alias("body"), as_text("confidence").try_cast("double").alias("confidence"), text_or("status", F.lit("asserted"), 40).alias("status"), text_or("source", F.col("actor"), 200).alias("source"), "project", F.floor(F.col("id") / block).alias("block"))
    totals = rows.groupBy("block").agg(F.count(F.lit(1)).alias("held"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = totals.select("block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("asserted_by"))
    return rows.withColumn("rank", rank).join(totals, "block").select((F.col("offset") + F.col("rank")).alias("id"), "subject", "predicate", "body", "confidence", "status", "source", "project", "asserted_by")


def awareness(events: DataFrame, heartbeats: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """Presence of each agent, as AWARENESS; heartbeats (HEARTBEAT) only touch agents that are there."""
    start = F.col("kind") == "session.start"
    rows = _log(events, SESSION_KINDS, upto, "role", "task").select("id", "ts", "actor", "project", start.alias("start"), text_or("role", F.when(start, "builder"), 60).alias("role"), F.when(start, text_or("task", F.lit(""), 140)).alias("task"))
    out = rows.groupBy(F.col("actor").alias("agent_id")).agg(
        F.coalesce(_latest("role", F.col("start")), F.min_by("role", "id")).alias("role"),
        _latest("task", F.col("start")).alias("task_head"),
        F.when(_latest("start"), "active").otherwise("idle").alias("status"),
        _latest("ts").alias("updated_at"),
        _latest("project").alias("project"),
    )
    if heartbeats is None:
        return out.select("agent_id", "role", "task_head", F.array().cast("array<string>").alias("files_hot"), "status", "updated_at", "project")
    beat = heartbeats.groupBy("agent_id").agg(F.max_by(F.struct("files_hot", "status", "updated_at", "project"), "updated_at").alias("b"))
    newer = F.coalesce(F.col("b.updated_at") >= F.col("updated_at"), F.lit(False))
    files = F.transform(F.slice("b.files_hot", 1, 8), lambda p: capped(p, 300))
    late = lambda name: F.when(newer, F.coalesce(F.col(f"b.{name}"), F.col(name))).otherwise(F.col(name)).alias(name)
    return out.join(beat, "agent_id", "left").select("agent_id", "role", "task_head", F.coalesce(files, F.array().cast("array<string>")).alias("files_hot"), late("status"), late("updated_at"), late("project"))


def tallies(events: DataFrame, upto: int | None = None, after: int = 0) -> DataFrame:
    """One row: what a fold of the events in (after, upto] counts, and where its cursor stands.

    Rows are judged by the whole log up to `upto`, so counts of consecutive ranges add up to a rebuild's.
    """
    plan = plan_rows(events, upto).select(F.lit("plan_node").alias("what"), "id", "target", "refused")
    decided = decision_rows(events, upto).select(F.lit("decision").alias("what"), "id", "target", "refused")
    both = plan.unionByName(decided).where(F.col("id") > after)
    took = F.col("target").isNotNull() & ~F.col("refused")
    guarded = both.agg(F.count_if(took & (F.col("what") == "plan_node")).alias("plan_node"), F.count_if(took & (F.col("what") == "decision")).alias("decision"), F.count_if(F.col("target").isNull()).alias("no_target"), F.count_if("refused").alias("cross_tenant"))
    rows = events.where(F.col("id") > after) if upto is None else events.where((F.col("id") > after) & (F.col("id") <= upto))
    plain = rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "claim.assert").alias("claim"), F.count_if(F.col("kind").isin(SESSION_KINDS)).alias("awareness"), F.count_if(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))).alias("unknown"), F.coalesce(F.max("id"), F.lit(after)).alias("last_event_id"))
    dead = dead_letters(events, upto).where(F.col("id") > after).agg(F.count(F.lit(1)).alias("dead_letter"))
    return plain.join(guarded).join(dead).select("events", "plan_node", "decision", "claim", "awareness", (F.col("no_target") + F.col("unknown") + F.col("dead_letter")).alias("skipped"), "cross_tenant", "dead_letter", "last_event_id")  # one row each


def dead_letters(events: DataFrame, upto: int | None = None) -> DataFrame:
    """(id, kind) of the events that no projection can hold; failures of the store or the cluster are not among them, they fail the job."""
    plan = _log(events, PLAN_KINDS, upto, "node", "node_id", "root_id")
    decided = _log(events, DECISION_KINDS, upto, "decision", "decision_id", "target", "scope_root")
    return plan.where("dead").select("id", "kind").unionByName(decided.where("dead").select("id", "kind"))


def snapshot(events: DataFrame, upto: int | None = None) -> dict[str, DataFrame]:
    """Every projection of the log up to an event."""
    return {"plan_node": plan_node(events, upto), "decision": decision(events, upto), "claim": claim(events, upto), "awareness": awareness(events, upto=upto)}


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
