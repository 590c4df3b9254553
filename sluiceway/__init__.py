"""Metadata-driven batch ingestion on Spark: read, check, dedupe, upsert one partition."""

from sluiceway.context import RunContext
from sluiceway.plans.jobs import JOBS, Job, run_job
from sluiceway.plans.metadata import ItemDef, RuleSpec, export_items, load_item, registry

__all__ = [
    "JOBS",
    "ItemDef",
    "Job",
    "RuleSpec",
    "RunContext",
    "export_items",
    "load_item",
    "registry",
    "run_job",
]
