"""Tenant predicates: who may see a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DEFAULT


def own(project: str | None, column: str = "project") -> Column:
    """Rows of one tenant; null labels are 'default'. None is the operator's view of all."""
    return F.lit(True) if project is None else F.coalesce(F.col(column), F.lit(DEFAULT)) == project


def scoped(project: str | None, column: str = "project", shared: str = "shared") -> Column:
    """A tenant's rows and those that others share."""
    return F.lit(True) if project is None else own(project, column) | (F.coalesce(F.col(shared), F.lit(0)) == 1)
