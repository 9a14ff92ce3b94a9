"""Capture: emitters of events, the append that keeps the first of equal ones, telemetry, versioned snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import DEFAULT, PAYLOAD_CHARS, capped, error_flag, event_hash, norm_project

#: Payload fields of each emitter with their caps in characters.
FIELDS = {
    "plan.open": {"title": 300, "kind": 40, "root_id": None, "owner": 80, "node_id": None, "status": 40, "origin": 80, "shared": None},
    "plan.claim": {"node": None, "owner": 80},
    "plan.done": {"node": None, "owner": 80},
    "plan.block": {"node": None, "owner": 80},
    "decision.make": {"subject": 120, "choice": 2000, "rationale": 2000, "binds": 300, "scope_root": None, "decision_id": None, "origin": 80, "shared": None},
    "decision.supersede": {"decision": None, "reason": 300},
    "claim.assert": {"subject": 200, "predicate": 120, "body": 1000, "confidence": None, "source": 200},
    "session.start": {"role": 60, "task": 200},
    "session.end": {},
    "observation": {"traversal": None, "q": 200, "refs": None},
}
TOOL_CHARS, PATH_CHARS, BATCH_ROWS, REFS = 80, 300, 40, 12


def payload(fields: Mapping) -> str:
    """Canonical JSON: sorted keys, cut at 4000 characters."""
    return json.dumps(fields, sort_keys=True, default=str)[:PAYLOAD_CHARS]


def event(kind: str, actor: str, ts: float, /, session: str = "", project: str = DEFAULT, **fields) -> dict:
    """One event of a known kind, its fields capped; None fields are left out."""
    caps = FIELDS.get(kind)
    if caps is not None and (odd := set(fields) - set(caps)):
        raise ValueError(f"{kind} has no {', '.join(sorted(odd))}")
    held = {k: v[: caps[k]] if caps and isinstance(v, str) and caps.get(k) else v for k, v in fields.items() if v is not None}
    if kind == "observation":
        held = {"traversal": True} | held
        held["refs"] = list(held.get("refs", ()))[:REFS]
        session = session or "traversal"
    return {"ts": float(ts), "kind": kind, "actor": actor, "session": session, "payload": payload(held), "project": project}


def frame(spark: SparkSession, events: Iterable[Mapping], first_id: int = 1) -> DataFrame:
    """Events in arrival order, numbered before equal ones are dropped."""
    rows = [(k, None, e["ts"], e["kind"], e["actor"], e["session"], e["payload"], e["project"]) for k, e in enumerate(events, first_id)]
    df = spark.createDataFrame(rows, schema.EVENTS)
    return df.withColumn("project", norm_project(F.col("project"))).withColumn("hash", event_hash(*map(F.col, ("project", "kind", "actor", "session", "payload"))))


def first_wins(events: DataFrame, key: str = "hash", order: str = "id") -> DataFrame:
    """The first row of each key. Rows of a key are reduced before they are shuffled."""
    rest = [c for c in events.columns if c != key]
    kept = events.groupBy(key).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("r"))
    return kept.select(*(F.col(key) if c == key else F.col(f"r.{c}") for c in events.columns))


def append(log: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of more that the log does not hold yet, first ones only."""
    return first_wins(more).join(log.select("hash"), "hash", "left_anti").select(*log.columns)


def telemetry(calls: DataFrame) -> DataFrame:
    """Tool calls (batch, seq, session, tool, path, response, ts, project) -> TOOL_EVENTS without id; the first 40 of a batch."""
    rank = Window.partitionBy("batch").orderBy("seq")
    path = F.nullif(F.coalesce(capped(F.col("path"), PATH_CHARS), F.lit("")), F.lit(""))
    kept = calls.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= BATCH_ROWS)
    return kept.select("session", capped(F.coalesce("tool", F.lit("")), TOOL_CHARS).alias("tool"), path.alias("path"), error_flag(F.col("response")).alias("is_error"), "ts", norm_project(F.col("project")).alias("project"))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with columns of later releases filled in; empty where nothing is stored yet."""
    want = schema.TABLES[name]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], want)
    df = spark.read.parquet(path)
    for c, value in schema.ADDED.get(name, {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in df.columns and value is not None else F.col(c) if c in df.columns else F.lit(value))
    return df.select(*(F.col(f.name).cast(f.dataType) for f in want))


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, last_event_id: int) -> str:
    """Write a snapshot of several tables under a new version, then name it in one rename: readers see all or nothing."""
    version = f"v-{last_event_id}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    out = fs.create(path(f"{root}/{version}/manifest"), True)
    out.write(bytearray(json.dumps({"version": version, "last_event_id": last_event_id, "tables": sorted(tables)}).encode()))
    out.close()
    final = path(f"{root}/manifest-{last_event_id:020d}-{version}")
    if not fs.rename(path(f"{root}/{version}/manifest"), final):
        raise OSError(f"cannot publish {final}")
    return version


def latest(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], int]:
    """The tables of the newest published snapshot and its cursor; nothing and 0 where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    found = path(root).getFileSystem(conf).globStatus(path(f"{root}/manifest-*")) or []
    names = sorted(f.getPath().toString() for f in found)
    if not names:
        return {}, 0
    said = json.loads("".join(r.value for r in spark.read.text(names[-1]).collect()))
    return {t: spark.read.parquet(f"{root}/{said['version']}/{t}") for t in said["tables"]}, said["last_event_id"]
