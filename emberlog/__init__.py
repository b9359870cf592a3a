"""emberlog: explain why Spark workloads are slow, from their event logs, on Spark."""

from emberlog.plans.lake import TABLES, Lake, build_tables, run, run_configured
from emberlog.session import build_session

__all__ = ["TABLES", "Lake", "build_session", "build_tables", "run", "run_configured"]
