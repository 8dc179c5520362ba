"""Network-flow analytics on Spark DataFrames."""

from fluxlens.model import FLOW_SCHEMA, OBSERVATION_SCHEMA, ROLLUP_SCHEMA, available_fields
from fluxlens.operators.filters import QueryError
from fluxlens.operators.query import FlowTables, choose_table, flow_detail, flow_query
from fluxlens.operators.rollup import build_rollup_1m, compact_rollup
from fluxlens.plans.reports import Scope
from fluxlens.session import apply_settings, work_folder

__all__ = [
    "FLOW_SCHEMA",
    "OBSERVATION_SCHEMA",
    "ROLLUP_SCHEMA",
    "FlowTables",
    "QueryError",
    "Scope",
    "apply_settings",
    "available_fields",
    "build_rollup_1m",
    "choose_table",
    "compact_rollup",
    "flow_detail",
    "flow_query",
    "work_folder",
]
