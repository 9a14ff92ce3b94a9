"""Event-sourced analytics for agent fleets, on PySpark."""
