"""Reconciliation of retail point-of-sale files as PySpark jobs."""

from posrecon.config import (
    FormatConfig,
    LayoutField,
    OutputConfig,
    ValidationConfig,
    ValidationRule,
    load_format_config,
    save_format_config,
)
from posrecon.operators.compare import (
    apply_tolerance,
    item_comparison,
    item_summary,
    item_validation,
    rank_by_diff,
    sort_by_diff,
    store_diffs,
    store_validation,
    top_by_diff,
)
from posrecon.operators.review import file_review, review_from_summaries, review_rows
from posrecon.operators.stores import store_list_diff, store_list_text
from posrecon.operators.summarize import aggregate, aggregate_by_rule, merge_summaries
from posrecon.plans.item_audit import item_audit
from posrecon.plans.profile import profile_files
from posrecon.plans.reconcile import onboard, reconcile
from posrecon.sources.dispatch import read_pos
from posrecon.sources.layout import load_layout, resolve_layouts
from posrecon.sources.sinks import write_report, write_reports

__all__ = [
    "FormatConfig", "LayoutField", "OutputConfig", "ValidationConfig", "ValidationRule",
    "aggregate", "aggregate_by_rule", "apply_tolerance", "file_review",
    "item_audit", "item_comparison", "item_summary", "item_validation", "load_format_config",
    "load_layout", "merge_summaries", "onboard", "profile_files", "rank_by_diff", "read_pos",
    "reconcile", "resolve_layouts", "review_from_summaries", "review_rows",
    "save_format_config", "sort_by_diff", "store_diffs", "store_list_diff", "store_list_text",
    "store_validation", "top_by_diff", "write_report", "write_reports",
]
