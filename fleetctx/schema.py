"""Schemas of the log, its projections and the delivery ledger."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "strings": T.ArrayType(T.StringType())}[t]) for n, t in (x.split() for x in text.split(","))])


EVENTS = _struct("id long,hash string,ts double,kind string,actor string,session string,payload string,project string")
PLAN_NODE = _struct("id long,root_id long,kind string,title string,status string,owner string,project string,origin string,shared int")
DECISION = _struct("id long,scope_root long,subject string,choice string,rationale string,binds string,status string,project string,origin string,shared int")
CLAIM = _struct("id long,subject string,predicate string,body string,confidence double,status string,source string,project string,asserted_by long")
AWARENESS = _struct("agent_id string,role string,task_head string,files_hot strings,status string,updated_at double,project string")
HEARTBEAT = _struct("agent_id string,files_hot strings,status string,updated_at double,project string")
DELIVERY = _struct("agent_id string,item_ref string,watermark long,delivered_at double,used_at double,state string")
TOOL_EVENTS = _struct("id long,session string,tool string,path string,is_error int,ts double,project string")

#: Columns that later releases added, with the value that older rows read as.
ADDED = {
    "plan_node": {"project": "default", "origin": None, "shared": 0},
    "decision": {"project": "default", "origin": None, "shared": 0},
    "events": {"project": "default"},
    "awareness": {"project": "default"},
    "tool_events": {"project": "default"},
    "delivery": {"used_at": None, "state": "emitted"},
}
TABLES = {"events": EVENTS, "plan_node": PLAN_NODE, "decision": DECISION, "claim": CLAIM, "awareness": AWARENESS, "delivery": DELIVERY, "tool_events": TOOL_EVENTS, "heartbeat": HEARTBEAT}


def migration_gaps() -> list[str]:
    """Added columns that a table's schema lacks."""
    return [f"{t}.{c}" for t, cols in ADDED.items() for c in cols if c not in TABLES[t].fieldNames()]
