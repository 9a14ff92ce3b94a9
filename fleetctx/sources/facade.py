"""SQL over a tenant's view of the tables, and who the tenant is."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT, PROJECT_CHARS
from ..functions.scope import own, scoped

VARIABLE, MARKER = "FLEETCTX_PROJECT", ".fleetctx-project"


class Facade:
    """Tables under their names, each cut to what a tenant may see: its rows, and shared ones where rows can be shared.

    None is the operator's view of all. Views live in a session of their own, so two facades do not see each other's.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], project: str | None = None):
        self.spark, self.views = spark, {}
        for name, df in tables.items():
            seen = df if project is None or "project" not in df.columns else df.where(scoped(project) if "shared" in df.columns else own(project))
            view = f"{name}_{uuid.uuid4().hex}"
            seen.createOrReplaceTempView(view)
            self.views[name] = view

    def sql(self, query: str, args: Mapping | None = None, strict: bool = False) -> DataFrame:
        """The result of a query with named parameters. One that does not parse or resolve raises if strict, else it is an empty frame.

        Table names stand for the tenant's views; failures while the query runs always raise.
        """
        heads = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in self.views.items())
        text = query.strip().rstrip(";")
        text = re.sub(r"(?is)^with\s+", f"WITH {heads}, ", text, count=1) if re.match(r"(?is)with\s", text) else f"WITH {heads} {text}"
        try:
            return self.spark.sql(text, args=dict(args or {}))
        except (AnalysisException, ParseException):
            if strict:
                raise
            return self.spark.createDataFrame([], "empty string")


def projects_of(awareness: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, project) of agents (agent_id): where each is registered, 'default' where it is not."""
    return agents.join(awareness.select("agent_id", "project"), "agent_id", "left").select("agent_id", F.coalesce("project", F.lit(DEFAULT)).alias("project"))


def _label(text: str) -> str:
    return "".join(c for c in text if c.isalnum() or c in "-_.")[:PROJECT_CHARS]


def tenant(path: str, explicit: str | None = None) -> str:
    """The tenant of a working folder on the driver: an explicit label, the environment's, that of a marker file in the folder or one above
    it, else the last segment of the path, drive letters dropped."""
    for named in (explicit, os.environ.get(VARIABLE)):
        if named and (label := _label(named.strip())):
            return label
    here = Path(path) if path else None
    for folder in [here, *here.parents] if here and here.is_absolute() else []:
        marker = folder / MARKER
        if marker.is_file() and (label := _label(marker.read_text(encoding="utf-8").strip())):
            return label
    parts = [x for x in re.sub("^[A-Za-z]:", "", path.replace("\\", "/")).split("/") if x.strip()]
    return (_label(parts[-1]) if parts else "") or DEFAULT
