"""The log and its companions, derived from the test tables by fixed expressions.

`events` becomes the log; its types stand for kinds, one mapping an aspect. The same expressions are written in DuckDB
SQL for the oracles: LOG has a row an event with what every mapping needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which event type stands for which kind, by aspect.
ASPECTS = {
    "plan": {"signup": "plan.open", "click": "plan.claim", "purchase": "plan.done", "error": "plan.block", "view": "observation"},
    "decision": {"signup": "decision.make", "error": "decision.supersede", "view": "observation"},
    "claim": {"purchase": "claim.assert", "view": "observation"},
    "session": {"signup": "session.start", "purchase": "session.end", "view": "observation"},
}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, event_type, actor, project, tenant, k, value) of every row of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select((F.col("event_id") + 1).alias("id"), ts.cast("double").alias("ts"), "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"), (F.col("user_id") % 4).alias("tenant"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


def _payload(nid: Column) -> Column:
    goal, root = nid % 10 == 0, nid - nid % 10
    text = lambda head: F.concat(F.lit(head), nid.cast("string"))
    fields = {
        "signup": F.to_json(F.struct(nid.alias("node_id"), nid.alias("decision_id"), F.when(~goal, root).alias("root_id"), root.alias("scope_root"), F.when(goal, "goal").otherwise("task").alias("kind"), text("item ").alias("title"), text("rule ").alias("subject"), text("choose ").alias("choice"), text("binds ").alias("binds"), (nid % 50 == 0).cast("int").alias("shared"), F.concat(F.lit("r"), (nid % 3).cast("string")).alias("role"), text("task item ").alias("task"))),
        "error": F.to_json(F.struct(nid.alias("node"), nid.alias("decision"))),
        "purchase": F.to_json(F.struct(nid.alias("node"), text("thing ").alias("subject"), F.lit("is").alias("predicate"), text("body ").alias("body"), F.col("value").alias("confidence"))),
        "click": F.to_json(F.struct(nid.alias("node"))),
        "view": F.to_json(F.struct(F.lit(True).alias("traversal"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("q"))),
    }
    out = F.lit("{}")
    for name, value in fields.items():
        out = F.when(F.col("event_type") == name, value).otherwise(out)
    return out


def log(spark: SparkSession, sf_dir: str, aspect: str, apart: bool = False) -> DataFrame:
    """The log of an aspect as EVENTS without hash. apart: tenants have ids of their own, else they collide."""
    rows = raw(spark, sf_dir)
    nid = F.col("k") + 100 * F.col("tenant") if apart else F.col("k")
    kind = F.lit("unknown")
    for name, k in ASPECTS[aspect].items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return rows.select("id", "ts", kind.alias("kind"), "actor", F.lit("s").alias("session"), _payload(nid).alias("payload"), "project")


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    return rows.select("id", F.lit("s").alias("session"), F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string")).alias("tool"), F.when(F.col("k") % 10 != 0, F.concat(F.lit("f"), F.col("k").cast("string"))).alias("path"), (F.col("event_type") == "error").cast("int").alias("is_error"), "ts", "project")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries: events up to the middle one told an agent of the item they name; purchases used it."""
    rows = raw(spark, sf_dir)
    half = rows.agg((F.max("id") / 2).alias("half"))
    told = rows.join(F.broadcast(half)).where(F.col("id") <= F.col("half"))  # one row
    ref = F.concat(F.when(F.col("event_type") == "click", F.lit("build:")).otherwise(F.lit("decision:")), (F.col("k") + 100 * F.col("tenant")).cast("string"))
    ref = F.when(F.col("event_type") == "view", F.lit("wm")).when(F.col("event_type") == "signup", F.lit("manual")).otherwise(ref)
    return told.groupBy(F.col("actor").alias("agent_id"), ref.alias("item_ref")).agg(F.max("id").alias("watermark"), F.max("ts").alias("delivered_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("used_at")).withColumn("state", F.when(F.col("used_at").isNotNull(), "used").otherwise("emitted"))


#: What DuckDB reads as the raw rows, the ledger and the tool events.
LOG = """log AS (SELECT event_id + 1 AS id, date_diff('second', TIMESTAMP '1970-01-01', ts)::DOUBLE AS ts, event_type, 'u' || user_id AS actor, 'p' || (user_id % 4) AS project, user_id % 4 AS tenant, user_id,
  json_extract_string(props, '$.k')::BIGINT AS k, value FROM events)"""
TOOLS = "tools AS (SELECT 't' || (user_id % 6) AS tool, CASE WHEN k % 10 <> 0 THEN 'f' || k END AS path, (event_type = 'error')::INT AS is_error, ts, project FROM log)"
LEDGER = """told AS (SELECT actor AS agent_id, CASE event_type WHEN 'view' THEN 'wm' WHEN 'signup' THEN 'manual' WHEN 'click' THEN 'build:' || (k + 100 * tenant) ELSE 'decision:' || (k + 100 * tenant) END AS item_ref, id, ts, event_type
  FROM log WHERE id <= (SELECT max(id) / 2.0 FROM log)),
ledger AS (SELECT agent_id, item_ref, max(id) AS watermark, max(ts) AS delivered_at, max(ts) FILTER (event_type = 'purchase') AS used_at FROM told GROUP BY 1, 2)"""


def fold_sql(kinds: str, make: str, apart: bool, p: str = "") -> str:
    """seen and ok, the guarded fold for plan or decisions; p goes before the names of its steps."""
    nid = "k + 100 * tenant" if apart else "k"
    return f"""{p}raw AS (SELECT *, {nid} AS nid FROM log WHERE event_type IN ({kinds})),
{p}rows AS (SELECT *, CASE WHEN event_type = '{make}' OR nid <> 0 THEN nid END AS target FROM {p}raw),
{p}firsts AS (SELECT target, min(id) AS first_id, arg_min(project, id) AS owner_project FROM {p}rows WHERE event_type = '{make}' GROUP BY target),
{p}seen AS (SELECT r.*, first_id, owner_project, coalesce(id > first_id AND project <> owner_project, false) AS refused, coalesce(id >= first_id AND project = owner_project, false) AS accepted FROM {p}rows r LEFT JOIN {p}firsts USING (target)),
{p}ok AS (SELECT * FROM {p}seen WHERE accepted)"""


PLAN = """plan AS (SELECT target AS id, CASE WHEN target % 10 <> 0 THEN target - target % 10 END AS root_id, CASE WHEN target % 10 = 0 THEN 'goal' ELSE 'task' END AS kind, 'item ' || target AS title,
  arg_max(CASE event_type WHEN 'signup' THEN 'open' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'done' ELSE 'blocked' END, id) AS status,
  arg_max(actor, id) FILTER (event_type IN ('signup', 'click')) AS owner, any_value(owner_project) AS project, any_value(owner_project) AS origin, (target % 50 = 0)::INT AS shared FROM ok GROUP BY target)"""
DECISIONS = """decisions AS (SELECT target AS id, target - target % 10 AS scope_root, 'rule ' || target AS subject, 'choose ' || target AS choice, '' AS rationale, 'binds ' || target AS binds,
  arg_max(CASE event_type WHEN 'signup' THEN 'standing' ELSE 'superseded' END, id) AS status, any_value(owner_project) AS project, any_value(owner_project) AS origin, (target % 50 = 0)::INT AS shared FROM ok GROUP BY target)"""
PLAN_KINDS, DECISION_KINDS = "'signup', 'click', 'purchase', 'error'", "'signup', 'error'"
