"""Events of an agent harness: lines of JSON in, frames for the log, telemetry, the ledger and composition out, envelopes back.

A line that is no JSON object contributes nothing and stops nothing. Every line of a batch is handled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import agent_id, project_from_path
from ..operators.ledger import signal_text

#: Event names, caps in characters, and how context is announced.
START, PROMPT, TOOL, ENDS = "SessionStart", "UserPromptSubmit", "PostToolUse", ["Stop", "SessionEnd"]
SESSION_CHARS, TASK_CHARS = 36, 200
HEADS = {START: "[fleet-context]\n", PROMPT: "[fleet-update]\n"}
_LINE = "hook_event_name string, session_id string, cwd string, project string, prompt string, tool_name string, tool_input struct<file_path: string, path: string, command: string>, tool_response string, __broken string"


def parse(lines: DataFrame) -> DataFrame:
    """lines (seq, ts, line) -> (seq, ts, event, session, agent_id, project, cwd, task, tool, path, command, response)."""
    held = lines.where(F.trim("line").startswith("{")).select("seq", "ts", F.from_json("line", _LINE, {"columnNameOfCorruptRecord": "__broken"}).alias("v")).where("v.__broken is null and v is not null")
    session = F.left(F.coalesce("v.session_id", F.lit("unknown")), F.lit(SESSION_CHARS))
    path = F.coalesce(F.nullif("v.tool_input.file_path", F.lit("")), F.nullif("v.tool_input.path", F.lit("")))
    return held.select("seq", "ts", F.coalesce("v.hook_event_name", F.lit("")).alias("event"), session.alias("session"), agent_id(session).alias("agent_id"), project_from_path(F.coalesce("v.cwd", F.lit("")), F.col("v.project")).alias("project"), F.coalesce("v.cwd", F.lit("")).alias("cwd"), F.left(F.coalesce("v.prompt", F.lit("")), F.lit(TASK_CHARS)).alias("task"), F.coalesce("v.tool_name", F.lit("?")).alias("tool"), path.alias("path"), F.coalesce("v.tool_input.command", F.lit("")).alias("command"), F.coalesce("v.tool_response", F.lit("")).alias("response"))


def events(parsed: DataFrame) -> DataFrame:
    """Session starts and ends for the log: (ts, kind, actor, session, payload, project)."""
    begin = F.col("event") == START
    payload = F.when(begin, F.to_json(F.struct(F.lit("builder").alias("role"), F.left("cwd", F.lit(200)).alias("task")))).otherwise("{}")
    return parsed.where(begin | F.col("event").isin(ENDS)).select("ts", F.when(begin, "session.start").otherwise("session.end").alias("kind"), F.col("agent_id").alias("actor"), "session", payload.alias("payload"), "project")


def calls(parsed: DataFrame) -> DataFrame:
    """Tool calls for log.telemetry; each line is a batch of its own."""
    return parsed.where(F.col("event") == TOOL).select(F.col("seq").alias("batch"), "seq", "session", "tool", "path", "response", "ts", "project")


def heartbeats(parsed: DataFrame) -> DataFrame:
    """Touched files, as HEARTBEAT."""
    return parsed.where((F.col("event") == TOOL) & F.col("path").isNotNull()).select("agent_id", F.array("path").alias("files_hot"), F.lit("active").alias("status"), F.col("ts").alias("updated_at"), "project")


def signals(parsed: DataFrame) -> DataFrame:
    """(agent_id, text) for ledger.used_refs: path, command and tool of each call."""
    return parsed.where(F.col("event") == TOOL).select("agent_id", signal_text(F.coalesce("path", F.lit("")), F.col("command"), F.col("tool")).alias("text"))


def requests(parsed: DataFrame) -> DataFrame:
    """Who asks for a payload: (event, agent_id, project, task); a prompt is the task."""
    return parsed.where(F.col("event").isin(START, PROMPT)).select("event", "agent_id", "project", F.when(F.col("event") == PROMPT, F.col("task")).otherwise("").alias("task"))


def envelope(event: Column, context: Column) -> Column:
    return F.to_json(F.struct(F.struct(event.alias("hookEventName"), context.alias("additionalContext")).alias("hookSpecificOutput")))


def envelopes(composed: DataFrame) -> DataFrame:
    """composed (event, payload, is_quiet) -> (line): what goes back to the harness. A quiet prompt gets none; a start always does."""
    head = F.when(F.col("event") == START, HEADS[START]).otherwise(HEADS[PROMPT])
    told = composed.where((F.col("event") == START) | ~F.col("is_quiet"))
    return told.select(envelope(F.col("event"), F.concat(head, "payload")).alias("line"))
