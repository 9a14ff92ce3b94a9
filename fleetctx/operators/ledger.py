"""The delivery ledger: appended rows, their current state, usage and effectiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ref_ident, ref_kind, subject_tokens

#: Refs that keep books and are no content.
SENTINELS = ["manual", "wm"]


def current(ledger: DataFrame) -> DataFrame:
    """The latest row of each (agent_id, item_ref), with used_at kept once it is set."""
    last = F.max_by(F.struct("watermark", "delivered_at"), F.struct("delivered_at", "watermark"))
    out = ledger.groupBy("agent_id", "item_ref").agg(last.alias("r"), F.min("used_at").alias("used_at"))
    return out.select("agent_id", "item_ref", "r.watermark", "r.delivered_at", "used_at", F.when(F.col("used_at").isNotNull(), "used").otherwise("emitted").alias("state"))


def mark(emitted: DataFrame, now: float) -> DataFrame:
    """(agent_id, item_ref, watermark) -> rows to append to the ledger."""
    return emitted.groupBy("agent_id", "item_ref").agg(F.max("watermark").alias("watermark")).select("agent_id", "item_ref", "watermark", F.lit(float(now)).alias("delivered_at"), F.lit(None).cast("double").alias("used_at"), F.lit("emitted").alias("state"))


def watermarks(ledger: DataFrame) -> DataFrame:
    """(agent_id, since, met): each agent's watermark, and whether it had its first contact."""
    return ledger.groupBy("agent_id").agg(F.coalesce(F.max(F.when(F.col("item_ref") == "wm", F.col("watermark"))), F.lit(0)).alias("since"), F.coalesce(F.max(F.col("item_ref") == "manual"), F.lit(False)).alias("met"))


def subjects(plan: DataFrame, decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """(kind, ident, subject) behind refs."""
    return plan.select(F.lit("build").alias("kind"), F.col("id").alias("ident"), F.col("title").alias("subject")).unionByName(decisions.select(F.lit("decision").alias("kind"), F.col("id").alias("ident"), "subject")).unionByName(claims.select(F.lit("claim").alias("kind"), F.col("id").alias("ident"), "subject"))


def signal_text(*signals: Column) -> Column:
    """Signals as one lower-cased text of at most 600 characters."""
    return F.left(F.lower(F.concat_ws(" ", *(F.nullif(s, F.lit("")) for s in signals))), F.lit(600))


def used_refs(ledger: DataFrame, named: DataFrame, signals: DataFrame) -> DataFrame:
    """(agent_id, item_ref) of unused deliveries whose subject a signal (agent_id, text) names.

    A ref is used if any token of four characters of its subject lies in the text; texts below four characters name nothing.
    """
    open_refs = current(ledger).where("used_at is null").select("agent_id", "item_ref", ref_kind(F.col("item_ref")).alias("kind"), ref_ident(F.col("item_ref")).alias("ident"))
    told = open_refs.join(named, ["kind", "ident"]).select("agent_id", "item_ref", subject_tokens(F.col("subject")).alias("tokens"))
    risk = open_refs.where("kind = 'risk'").select("agent_id", "item_ref", subject_tokens(F.split_part(F.regexp_replace("item_ref", "^risk:", ""), F.lit("/"), F.lit(1))).alias("tokens"))
    heard = signals.where(F.length("text") >= 4)
    hit = told.unionByName(risk).join(heard, "agent_id").where(F.exists("tokens", lambda t: F.contains(F.col("text"), t)))
    return hit.select("agent_id", "item_ref").distinct()


def mark_used(ledger: DataFrame, used: DataFrame, now: float) -> DataFrame:
    """Rows to append: the used refs' current rows with used_at."""
    return current(ledger).join(used, ["agent_id", "item_ref"], "left_semi").select("agent_id", "item_ref", "watermark", "delivered_at", F.lit(float(now)).alias("used_at"), F.lit("used").alias("state"))


def delivery_state(ledger: DataFrame) -> DataFrame:
    """(agent_id, emitted, used) without sentinels."""
    rows = ledger.where(~F.col("item_ref").isin(SENTINELS))
    state = F.when(F.col("used_at").isNotNull(), "used").otherwise(F.coalesce("state", F.lit("emitted")))
    return rows.groupBy("agent_id").agg(F.count_if(state == "emitted").alias("emitted"), F.count_if(state == "used").alias("used"))


def effectiveness(ledger: DataFrame, by_agent: bool = False) -> DataFrame:
    """used, delivered, rate (3 places, half even; null without deliveries)."""
    rows = ledger.where(~F.col("item_ref").isin(SENTINELS))
    n, used = F.count(F.lit(1)), F.count_if(F.col("used_at").isNotNull())
    rate = F.when(n > 0, F.bround(used.cast("double") / n, 3))
    return (rows.groupBy("agent_id") if by_agent else rows).agg(used.alias("used"), n.alias("delivered"), rate.alias("rate"))


def dangling(ledger: DataFrame, plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """Refs of builds and decisions that name no row."""
    refs = ledger.select("agent_id", "item_ref", ref_kind(F.col("item_ref")).alias("kind"), ref_ident(F.col("item_ref")).alias("ident")).where(F.col("kind").isin("build", "decision") & F.col("ident").isNotNull())
    there = plan.select(F.lit("build").alias("kind"), F.col("id").alias("ident")).unionByName(decisions.select(F.lit("decision").alias("kind"), F.col("id").alias("ident")))
    return refs.join(there, ["kind", "ident"], "left_anti").select("agent_id", "item_ref")
