"""Tool runs of a record: where they stand, and their status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FINDINGS = "findings: ARRAY<STRUCT<test_id: STRING, check_id: STRING, filename: STRING, path: STRING>>"
TOOL_RUN = f"STRUCT<name: STRING, available: BOOLEAN, status: STRING, command: ARRAY<STRING>, returncode: INT, {_FINDINGS}, error: STRING>"
#: An older layout: runs by tool and phase, or by tool alone.
OLD_RUN = f"STRUCT<available: BOOLEAN, status: STRING, {_FINDINGS}, before: {TOOL_RUN}, after: {TOOL_RUN}>"

STATUSES = ["success", "missing", "timeout", "error", "unavailable", "unknown"]
def tool_run(validation: Column, tool: str, phase: str, unphased: bool = False) -> Column:
    """A phase's run of a tool: of the record's own fields, else of the older layout by tool and phase (``unphased``: else by tool alone)."""
    old = validation["tool_results"][tool]
    found = F.coalesce(validation[f"{tool}_{phase}"], old[phase])
    if unphased:
        whole = F.struct(F.lit(None).cast("string").alias("name"), old["available"].alias("available"), old["status"].alias("status"), F.lit(None).cast("array<string>").alias("command"), F.lit(None).cast("int").alias("returncode"), old["findings"].alias("findings"), F.lit(None).cast("string").alias("error"))
        found = F.coalesce(found, F.when(old.isNotNull(), whole.cast(TOOL_RUN)))
    return found


def run_status(run: Column) -> Column:
    """The status of a run, or what its availability says; no run is unavailable, any other word unknown."""
    said = F.coalesce(F.nullif(run["status"], F.lit("")), F.when(F.coalesce(run["available"], F.lit(False)), "success").otherwise("unavailable"))
    return F.when(run.isNull(), "unavailable").when(said.isin(STATUSES), said).otherwise("unknown")
