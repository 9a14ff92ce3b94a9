"""Queries of every operator over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import brief, compose, fold, health, ledger, probe
from ..sources import log as source
from .derived import DECISION_KINDS, DECISIONS, LEDGER, LOG, PLAN, PLAN_KINDS, TOOLS, fold_sql
from . import derived

TENANT = "p1"
BUDGET = 20_000
QUESTION = "Which licensed work mentions the cookie license and the mailing address?"


def _day_end(events: DataFrame) -> float:
    return events.agg(F.max("ts")).first()[0] or 0.0


def plan_fold(spark, d):
    return fold.plan_node(derived.log(spark, d, "plan", apart=True))


def plan_fold_shared_ids(spark, d):
    return fold.plan_node(derived.log(spark, d, "plan"))


def decision_fold(spark, d):
    return fold.decision(derived.log(spark, d, "decision", apart=True))


def claim_fold(spark, d):
    return fold.claim(derived.log(spark, d, "claim"))


def awareness_fold(spark, d):
    return fold.awareness(derived.log(spark, d, "session")).drop("files_hot")


def fold_tallies(spark, d):
    return fold.tallies(derived.log(spark, d, "plan"))


def fold_upto(spark, d):
    """The bounded replay: the plan as of the thousandth event."""
    return fold.plan_node(derived.log(spark, d, "plan", apart=True), upto=1000)


def active_builds(spark, d):
    return brief.active_builds(plan_fold(spark, d), TENANT)


def standing_decisions(spark, d):
    return brief.standing_decisions(decision_fold(spark, d), TENANT)


def live_agents(spark, d):
    """As of the last session event, so that somebody is there."""
    events = derived.log(spark, d, "session")
    aware = fold.awareness(events)
    return brief.live_agents(aware, aware.agg(F.max("updated_at")).first()[0] or 0.0)


def tool_risk(spark, d):
    return brief.tool_risk(derived.tool_events(spark, d))


def path_risk(spark, d):
    return brief.path_risk(derived.tool_events(spark, d), TENANT)


def attention(spark, d):
    events = derived.log(spark, d, "plan")
    return brief.attention(events, _day_end(events), TENANT)


def attention_ref(spark, d):
    """The reference under which a snapshot of questions is delivered."""
    events = derived.log(spark, d, "plan")
    rows = brief.attention(events, _day_end(events), TENANT, brief.ASKED_SHIFT).select("n", "last_id", brief.attention_line(F.col("q"), F.col("n")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.col("last_id")).alias("b"), "line"))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit("attention:"), F.left(F.sha2(lines.cast("binary"), 256), F.lit(16))).alias("item_ref"))


def log_heads(spark, d):
    return brief.log_heads(derived.log(spark, d, "plan"))


def delta_page(spark, d):
    return brief.delta_page(derived.log(spark, d, "plan"), 100, TENANT).select("id", "kind", "actor")


def pending(spark, d):
    return brief.pending(derived.log(spark, d, "plan"), 100, TENANT)


def text_dedupe(spark, d):
    """First-wins append: documents by the hash of their text."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"), "lang")
    return source.first_wins(docs, "hash", "doc_id")


def event_dedupe(spark, d):
    """The log without events that repeat tenant, kind, actor and payload, at any time."""
    rows = derived.raw(spark, d).select("id", F.sha2(F.concat_ws("|", "project", "event_type", "actor", F.col("k").cast("string")).cast("binary"), 256).alias("hash"), "actor")
    return source.first_wins(rows)


def telemetry(spark, d):
    """The first 40 calls of each batch: a user's calls of one hour."""
    calls = derived.raw(spark, d).select(F.concat_ws(":", "actor", F.floor(F.col("ts") / 3600).cast("string")).alias("batch"), F.col("id").alias("seq"), F.col("actor").alias("session"), F.col("event_type").alias("tool"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.when(F.col("event_type") == "error", "Error: failed").otherwise("fine").alias("response"), "ts", "project")
    return source.telemetry(calls)


def undelivered(spark, d):
    """Candidates of every agent: decisions and goals it may see and was not told."""
    agents = derived.raw(spark, d).select(F.col("actor").alias("agent_id"), "project").distinct()
    return compose.candidates(plan_fold(spark, d), decision_fold(spark, d), derived.ledger(spark, d), agents)


def agent_pages(spark, d):
    """The next events past its watermark of every agent in its project and in p0, and how many it has not seen."""
    agents = derived.raw(spark, d).select(F.col("actor").alias("agent_id"), F.explode(F.array("project", F.lit("p0"))).alias("project")).distinct()
    marks = ledger.watermarks(derived.ledger(spark, d)).select("agent_id", "since")
    agents = agents.join(marks, "agent_id", "left").select("agent_id", "project", F.coalesce("since", F.lit(0)).alias("since"))
    out = compose.pages(derived.log(spark, d, "plan"), agents)
    return out.select("agent_id", "project", "since", F.array_join(F.transform("events", lambda e: e["id"].cast("string")), ",").alias("ids"), "unseen")


def compose_fleet(spark, d):
    """Payloads of every agent in one job (packing is tested against a loop)."""
    agents = derived.raw(spark, d).select(F.col("actor").alias("agent_id"), "project").distinct()
    events, aware = derived.log(spark, d, "plan"), fold.awareness(derived.log(spark, d, "session"))
    return compose.payloads(events, plan_fold(spark, d), decision_fold(spark, d), aware, derived.tool_events(spark, d), derived.ledger(spark, d), agents, _day_end(events))


def delivery_state(spark, d):
    return ledger.delivery_state(derived.ledger(spark, d))


def effectiveness(spark, d):
    return ledger.effectiveness(derived.ledger(spark, d))


def dangling_refs(spark, d):
    return ledger.dangling(derived.ledger(spark, d), plan_fold(spark, d), decision_fold(spark, d))


def usage(spark, d):
    """Deliveries whose subject an agent's signals name: each error event is a signal 'item 7 rule 7'."""
    rows = derived.raw(spark, d).where("event_type = 'error'")
    text = F.concat(F.lit("edit item "), F.col("k").cast("string"))
    signals = rows.select(F.col("actor").alias("agent_id"), ledger.signal_text(text).alias("text")).distinct()
    named = ledger.subjects(plan_fold(spark, d), decision_fold(spark, d), claim_fold(spark, d))
    return ledger.used_refs(derived.ledger(spark, d), named, signals)


def inline_build(spark, d):
    """Nodes of the builds that agents' tasks name."""
    tasks = derived.raw(spark, d).groupBy(F.col("actor").alias("agent_id"), "project").agg(F.concat(F.lit("work on ITEM"), F.min("k").cast("string"), F.lit(" item")).alias("task"))
    plan = plan_fold(spark, d)
    matched = compose.matched_builds(plan, tasks)
    return compose.inline_nodes(plan, matched).select("agent_id", "goal_id", "id", "status")


def inline_rules(spark, d):
    """Rules of the builds that agents' tasks name: each agent's own item, as title and task hold each other's words."""
    tasks = derived.raw(spark, d).groupBy(F.col("actor").alias("agent_id"), "project").agg(F.when(F.min("k") % 2 == 0, F.concat(F.lit("work on ITEM item"), F.min("k").cast("string"))).otherwise("sort mail").alias("task"))
    return compose.inline_decisions(decision_fold(spark, d), compose.matched_builds(plan_fold(spark, d), tasks)).select("agent_id", "goal_id", "id", "subject")


def health_checks(spark, d):
    events = derived.log(spark, d, "plan")
    return health.checks(events, 9_000, derived.ledger(spark, d), plan_fold(spark, d), decision_fold(spark, d), claim_fold(spark, d), stored={"events": events, "plan_node": plan_fold(spark, d)})


def activity(spark, d):
    events = derived.log(spark, d, "session")
    held = derived.ledger(spark, d).withColumn("delivered_at", F.col("delivered_at") + 15 * 86400)
    return health.activity(events, derived.tool_events(spark, d), held, decision_fold(spark, d), fold.awareness(events), _day_end(events))


def top_asked(spark, d):
    events = derived.log(spark, d, "plan")
    return health.top_asked(events, _day_end(events))


def tenant_from_path(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", scalars.project_from_path(F.col("url")).alias("project"))


def budget_prefix(spark, d):
    """Documents in order until a budget of characters is passed."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("size"))
    return probe.running(docs, 200_000).select("id", "size", "before")


def retrieval(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return probe.retrieve(docs, QUESTION, BUDGET)


def fleet_brief(spark, d):
    """The lines of a tenant's brief."""
    events = derived.log(spark, d, "session")
    return brief.full_brief(events, plan_fold(spark, d), decision_fold(spark, d), fold.awareness(events), derived.tool_events(spark, d), _day_end(events), TENANT)


def first_payload(spark, d):
    """The payloads of first contact of every agent, with the builds that its task names."""
    events = derived.log(spark, d, "session")
    agents = derived.raw(spark, d).groupBy(F.col("actor").alias("agent_id"), "project").agg(F.concat(F.lit("work on item "), F.min("k").cast("string")).alias("task"))
    return compose.first_contacts(events, plan_fold(spark, d), decision_fold(spark, d), fold.awareness(events), derived.tool_events(spark, d), _day_end(events), agents)


def latency_summary(spark, d):
    """Median, least, greatest and mean of values by type."""
    rows = derived.raw(spark, d)
    return rows.groupBy("event_type").agg(F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (active_builds, plan_fold, plan_fold_shared_ids, decision_fold, claim_fold, awareness_fold, fold_tallies, fold_upto, standing_decisions, live_agents, tool_risk, path_risk, attention, attention_ref, log_heads, delta_page, pending, text_dedupe, event_dedupe, telemetry, undelivered, agent_pages, compose_fleet, delivery_state, effectiveness, dangling_refs, usage, inline_build, inline_rules, health_checks, activity, top_asked, tenant_from_path, budget_prefix, retrieval, fleet_brief, first_payload, latency_summary)}

_PLAN = f"WITH {LOG}, {fold_sql(PLAN_KINDS, 'signup', True)}, {PLAN}"
_BOTH = f"WITH {LOG}, {fold_sql(PLAN_KINDS, 'signup', True)}, {PLAN}, {fold_sql(DECISION_KINDS, 'signup', True, 'd_')}, {DECISIONS.replace('FROM ok', 'FROM d_ok')}, {LEDGER}"
_DECISIONS = f"WITH {LOG}, {fold_sql(DECISION_KINDS, 'signup', True)}, {DECISIONS}"
_SESSION = f"""WITH {LOG}, sess AS (SELECT *, event_type = 'signup' AS start FROM log WHERE event_type IN ('signup', 'purchase')),
aware AS (SELECT actor AS agent_id, arg_max('r' || (k % 3), id) FILTER (start) AS role, arg_max('task item ' || k, id) FILTER (start) AS task_head, CASE WHEN arg_max(start, id) THEN 'active' ELSE 'idle' END AS status, arg_max(ts, id) AS updated_at, arg_max(project, id) AS project FROM sess GROUP BY actor)"""
_NEWEST = "newest AS (SELECT id, 'k' || k AS q FROM log WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM log) - 86400 AND project = 'p1' ORDER BY id DESC LIMIT 200), asked AS (SELECT q, count(*) AS n, max(id) AS last_id FROM newest GROUP BY q ORDER BY n DESC, last_id DESC LIMIT 4)"
_KIND = "CASE event_type WHEN 'signup' THEN 'plan.open' WHEN 'click' THEN 'plan.claim' WHEN 'purchase' THEN 'plan.done' WHEN 'error' THEN 'plan.block' ELSE 'observation' END"
_COLS = "id, root_id, kind, title, status, owner, project, origin, shared"
_LINE = "CASE WHEN length({0}) <= 400 THEN {0} ELSE left({0}, 397) || '...' END"
_MATCH = "matched AS (SELECT t.agent_id, t.project, p.id AS goal_id FROM tasks t JOIN plan p ON p.kind = 'goal' AND p.status NOT IN ('done', 'abandoned') AND (p.project = t.project OR p.shared = 1) AND len(list_filter(string_split(lower(task), ' '), lambda w: length(w) > 3 AND (contains(lower(p.title), w) OR contains(w, lower(p.title))))) > 0)"

ORACLE_SQL = {
    "plan_fold": f"{_PLAN} SELECT {_COLS} FROM plan",
    "plan_fold_shared_ids": f"WITH {LOG}, {fold_sql(PLAN_KINDS, 'signup', False)}, {PLAN} SELECT {_COLS} FROM plan",
    "fold_upto": f"{_PLAN} SELECT {_COLS} FROM plan".replace("FROM log WHERE event_type IN", "FROM log WHERE id <= 1000 AND event_type IN"),
    "decision_fold": f"{_DECISIONS} SELECT id, scope_root, subject, choice, rationale, binds, status, project, origin, shared FROM decisions",
    "claim_fold": f"WITH {LOG} SELECT row_number() OVER (ORDER BY id) AS id, 'thing ' || k AS subject, 'is' AS predicate, 'body ' || k AS body, value AS confidence, 'asserted' AS status, actor AS source, project, id AS asserted_by FROM log WHERE event_type = 'purchase'",
    "awareness_fold": f"{_SESSION} SELECT agent_id, role, task_head, status, updated_at, project FROM aware",
    "fold_tallies": f"""WITH {LOG}, {fold_sql(PLAN_KINDS, 'signup', False)} SELECT (SELECT count(*) FROM log) AS events, count(*) FILTER (target IS NOT NULL AND NOT refused) AS plan_node, 0::BIGINT AS decision, 0::BIGINT AS claim, 0::BIGINT AS awareness,
count(*) FILTER (target IS NULL) + (SELECT count(*) FROM log WHERE event_type = 'view') AS skipped, count(*) FILTER (refused) AS cross_tenant, 0::BIGINT AS dead_letter, (SELECT max(id) FROM log) AS last_event_id FROM seen""",
    "active_builds": f"""{_PLAN} SELECT n.id, any_value(n.title) AS title, count(*) FILTER (c.status = 'open') AS n_open, count(*) FILTER (c.status = 'done') AS n_done, any_value(n.project) AS project, any_value(n.origin) AS origin
FROM plan n LEFT JOIN plan c ON c.root_id = n.id WHERE n.kind = 'goal' AND n.status NOT IN ('done', 'abandoned') AND (n.project = '{TENANT}' OR n.shared = 1) GROUP BY n.id ORDER BY n.id DESC LIMIT 5""",
    "standing_decisions": f"{_DECISIONS} SELECT id, subject, choice, project, origin FROM decisions WHERE status = 'standing' AND (project = '{TENANT}' OR shared = 1) ORDER BY id DESC LIMIT 5",
    "live_agents": f"{_SESSION} SELECT agent_id, role, status, coalesce(task_head, '') AS task, updated_at FROM aware WHERE updated_at > (SELECT max(updated_at) FROM aware) - 900 ORDER BY updated_at DESC, agent_id LIMIT 8",
    "tool_risk": f"WITH {LOG}, {TOOLS} SELECT tool, count(*) AS n, round(sum(is_error)::DOUBLE / count(*), 3) AS err FROM tools GROUP BY tool HAVING count(*) >= 20 AND round(sum(is_error)::DOUBLE / count(*), 3) > 0 ORDER BY err DESC, n DESC, tool LIMIT 3",
    "path_risk": f"WITH {LOG}, {TOOLS} SELECT path, count(*) AS n, round(sum(is_error)::DOUBLE / count(*), 3) AS err FROM tools WHERE path IS NOT NULL AND project = '{TENANT}' GROUP BY path HAVING count(*) >= 10 AND round(sum(is_error)::DOUBLE / count(*), 3) > 0 ORDER BY err DESC, n DESC, path LIMIT 3",
    "attention": f"WITH {LOG}, {_NEWEST} SELECT * FROM asked",
    "attention_ref": f"WITH {LOG}, {_NEWEST} SELECT 'attention:' || left(sha256(string_agg('  ' || n || 'x :: ' || q, chr(10) ORDER BY n DESC, last_id DESC)), 16) AS item_ref FROM (SELECT * FROM asked ORDER BY n DESC, last_id DESC LIMIT 3)",
    "log_heads": f"WITH {LOG} SELECT project, max(id) AS watermark FROM log GROUP BY project",
    "delta_page": f"WITH {LOG} SELECT id, {_KIND} AS kind, actor FROM log WHERE id > 100 AND project = '{TENANT}' ORDER BY id LIMIT 12",
    "pending": f"WITH {LOG} SELECT count(*) AS pending FROM log WHERE id > 100 AND project = '{TENANT}'",
    "text_dedupe": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS hash, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 2",
    "event_dedupe": f"WITH {LOG}, h AS (SELECT id, sha256(project || '|' || event_type || '|' || actor || '|' || k) AS hash, actor FROM log) SELECT min(id) AS id, hash, arg_min(actor, id) AS actor FROM h GROUP BY hash",
    "telemetry": f"WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY actor, floor(ts / 3600) ORDER BY id) AS rn FROM log) SELECT actor AS session, event_type AS tool, 'f' || k AS path, (event_type = 'error')::INT AS is_error, ts, project FROM n WHERE rn <= 40",
    "undelivered": f"""{_BOTH}, agents AS (SELECT DISTINCT actor AS agent_id, project FROM log),
items AS (SELECT 0 AS rank, id AS ident, 'decision:' || id AS item_ref, 'NEW DECISION d' || id || ' [' || subject || '] ' || left(choice, 70) || ' (binds: ' || left(binds, 60) || ')' AS line, project AS p, shared FROM decisions WHERE status = 'standing'
UNION ALL SELECT 1, id, 'build:' || id, 'NEW BUILD build:' || id || ' "' || title || '" [' || status || '] (nodes: root_id = ' || id || ')', project, shared FROM plan WHERE kind = 'goal')
SELECT a.agent_id, a.project, rank, ident, i.item_ref, CASE WHEN p = a.project THEN '' ELSE '[from project:' || p || '] ' END || line AS line FROM agents a JOIN items i ON a.project = p OR shared = 1 ANTI JOIN ledger l ON l.agent_id = a.agent_id AND l.item_ref = i.item_ref""",
    "agent_pages": f"""WITH {LOG}, {LEDGER}, pairs AS (SELECT actor AS agent_id, project FROM log UNION SELECT actor, 'p0' FROM log),
agents AS (SELECT a.agent_id, project, coalesce(max(watermark) FILTER (item_ref = 'wm'), 0) AS since FROM pairs a LEFT JOIN ledger USING (agent_id) GROUP BY ALL),
nxt AS (SELECT agent_id, agents.project, since, log.id, row_number() OVER (PARTITION BY agent_id, agents.project ORDER BY log.id) AS rn FROM agents LEFT JOIN log ON log.project = agents.project AND log.id > since)
SELECT agent_id, project, since, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (rn <= 12), '') AS ids, count(id) AS unseen FROM nxt GROUP BY ALL""",
    "delivery_state": f"WITH {LOG}, {LEDGER} SELECT agent_id, count(*) FILTER (used_at IS NULL) AS emitted, count(used_at) AS used FROM ledger WHERE item_ref NOT IN ('manual', 'wm') GROUP BY agent_id",
    "effectiveness": f"WITH {LOG}, {LEDGER} SELECT count(used_at) AS used, count(*) AS delivered, round_even(count(used_at)::DOUBLE / count(*), 3) AS rate FROM ledger WHERE item_ref NOT IN ('manual', 'wm')",
    "dangling_refs": f"{_BOTH} SELECT agent_id, item_ref FROM ledger WHERE (item_ref LIKE 'build:%' AND split_part(item_ref, ':', 2)::BIGINT NOT IN (SELECT id FROM plan)) OR (item_ref LIKE 'decision:%' AND split_part(item_ref, ':', 2)::BIGINT NOT IN (SELECT id FROM decisions))",
    "usage": f"""{_BOTH}, signals AS (SELECT DISTINCT actor AS agent_id, 'edit item ' || k AS text FROM log WHERE event_type = 'error'),
named AS (SELECT 'build:' || id AS item_ref, title AS subject FROM plan UNION ALL SELECT 'decision:' || id, subject FROM decisions)
SELECT DISTINCT agent_id, item_ref FROM ledger JOIN named USING (item_ref) JOIN signals USING (agent_id) WHERE used_at IS NULL AND len(list_filter(regexp_split_to_array(lower(subject), '[^a-z0-9]+'), lambda t: length(t) >= 4 AND contains(text, t))) > 0""",
    "inline_build": f"""{_PLAN}, tasks AS (SELECT actor AS agent_id, project, 'work on ITEM' || min(k) || ' item' AS task FROM log GROUP BY 1, 2), {_MATCH},
n AS (SELECT m.agent_id, m.goal_id, p.id, p.status, row_number() OVER (PARTITION BY m.agent_id, m.goal_id ORDER BY p.id) AS rn FROM matched m JOIN plan p ON (p.root_id = m.goal_id OR p.id = m.goal_id) AND (p.project = m.project OR p.shared = 1))
SELECT agent_id, goal_id, id, status FROM n WHERE rn <= 12""",
    "inline_rules": f"""{_BOTH}, tasks AS (SELECT actor AS agent_id, project, CASE WHEN min(k) % 2 = 0 THEN 'work on ITEM item' || min(k) ELSE 'sort mail' END AS task FROM log GROUP BY 1, 2), {_MATCH},
n AS (SELECT m.agent_id, m.goal_id, q.id, q.subject, row_number() OVER (PARTITION BY m.agent_id, m.goal_id ORDER BY q.id) AS rn FROM matched m JOIN decisions q ON q.scope_root = m.goal_id AND q.status = 'standing' AND (q.project = m.project OR q.shared = 1))
SELECT agent_id, goal_id, id, subject FROM n WHERE rn <= 6""",
    "activity": f"""{_BOTH}, late AS (SELECT max(ts) - 86400 AS t FROM log), sess AS (SELECT actor, arg_max(event_type, id) AS last FROM log WHERE event_type IN ('signup', 'purchase') GROUP BY actor)
SELECT (SELECT count(*) FROM log, late WHERE ts > t AND event_type = 'signup') AS sessions_started, (SELECT count(*) FROM log, late WHERE ts > t AND event_type = 'view') AS traversals,
(SELECT count(*) FROM ledger, late WHERE delivered_at + 15 * 86400 > t) AS deliveries, (SELECT count(DISTINCT agent_id) FROM ledger, late WHERE delivered_at + 15 * 86400 > t) AS agents_reached,
(SELECT count(*) FROM log, late WHERE ts > t AND event_type = 'error') AS tool_errors, (SELECT count(*) FROM log, late WHERE ts > t) AS tool_calls,
(SELECT count(*) FROM decisions WHERE status = 'standing') AS open_decisions, (SELECT count(*) FROM sess WHERE last = 'signup') AS live_agents""",
    "top_asked": f"WITH {LOG} SELECT 'k' || k AS q, count(*) AS n FROM log WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM log) - 86400 GROUP BY 1 ORDER BY n DESC, q LIMIT 3",
    "tenant_from_path": "SELECT page_id, coalesce(nullif(left(regexp_replace(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda x: trim(x) <> '')[-1], '[^\\p{L}\\p{N}._-]', '', 'g'), 64), ''), 'default') AS project FROM pages",
    "budget_prefix": "WITH r AS (SELECT doc_id AS id, length(text) AS size, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) SELECT id, size, before FROM r WHERE before < 200000",
    "retrieval": "WITH h AS (SELECT doc_id AS id, left(coalesce(text, ''), 200) AS line, " + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in probe.keywords(QUESTION)) + f" AS hits FROM documents), held AS (SELECT * FROM h WHERE hits >= {max(1, len(probe.keywords(QUESTION)) // 4)}), chosen AS (SELECT * FROM held UNION ALL SELECT * FROM h WHERE NOT EXISTS (FROM held)), k AS (SELECT *, coalesce(sum(length(line) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chosen) SELECT id, left(line, ({BUDGET} - before)::INT) AS line, hits FROM k WHERE before <= {BUDGET}",
    "latency_summary": "SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY event_type",
    "health_checks": f"""{_BOTH}, eff AS (SELECT count(used_at) AS used, count(*) AS n FROM ledger WHERE item_ref NOT IN ('manual', 'wm')), h AS (SELECT max(id) AS head, count(*) AS n, count(*) FILTER (project IS NULL OR project = '') AS bare FROM log),
lost AS (SELECT count(*) AS n FROM ledger WHERE (item_ref LIKE 'build:%' AND split_part(item_ref, ':', 2)::BIGINT NOT IN (SELECT id FROM plan)) OR (item_ref LIKE 'decision:%' AND split_part(item_ref, ':', 2)::BIGINT NOT IN (SELECT id FROM decisions))),
echo AS (SELECT count(*) AS n FROM (SELECT 'thing ' || k AS subject FROM log WHERE event_type = 'purchase') WHERE subject ILIKE 'fleet-context%' OR subject ILIKE '%moving target%')
SELECT 'schema.migration_parity' AS check, 'error' AS status, 'events.hash' AS detail UNION ALL SELECT 'projector.cursor', CASE WHEN head - 9000 < 0 THEN 'error' WHEN head - 9000 > 500 THEN 'warn' ELSE 'ok' END, 'cursor 9000 / log head ' || head FROM h
UNION ALL SELECT 'ledger.referents', CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END, n || ' refs name no row' FROM lost UNION ALL SELECT 'delivery.effectiveness', CASE WHEN round_even(used::DOUBLE / n, 3) < 0.15 THEN 'warn' ELSE 'ok' END, used || '/' || n || ' delivered items acted on' FROM eff
UNION ALL SELECT 'memory.echo', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n || ' claims derived from an injected brief' FROM echo UNION ALL SELECT 'tenant.labelling', CASE WHEN bare > 0 THEN 'warn' ELSE 'ok' END, bare || '/' || n || ' events with no project label' FROM h""",
}
