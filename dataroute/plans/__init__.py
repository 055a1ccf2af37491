"""Jobs composed from the functions and operators."""

from dataroute.plans.inventory import literal_inventory
from dataroute.plans.lineage import (
    contested_destinations,
    destination_use,
    reads_without_writer,
    script_accesses,
    script_levels,
)
from dataroute.plans.redirects import redirect_collisions, redirect_plan, redirect_rows
from dataroute.plans.runs import (
    append_outcomes,
    audit,
    compact_log,
    finish_run,
    read_log,
    run_job,
)
from dataroute.plans.taken import TakenDestinations

__all__ = [
    "TakenDestinations",
    "append_outcomes",
    "audit",
    "compact_log",
    "contested_destinations",
    "destination_use",
    "finish_run",
    "literal_inventory",
    "read_log",
    "reads_without_writer",
    "redirect_collisions",
    "redirect_plan",
    "redirect_rows",
    "run_job",
    "script_accesses",
    "script_levels",
]
