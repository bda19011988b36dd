"""Dataset reliability checks, drift, cleaning and contracts as Spark jobs."""

from datavitals.operators.checks import Scan, run_quality_checks, scan
from datavitals.operators.cleaning import compare_cleaning, simulate_cleaning
from datavitals.operators.contract import data_contract
from datavitals.operators.drift import DriftReport, compare_datasets
from datavitals.operators.profile import column_profile, dtype_summary, table_overview
from datavitals.operators.remediation import apply_issue_fix, preview_issue_fix
from datavitals.operators.scoring import health_score, score_breakdown, severity_counts
from datavitals.plans.options import ScanOptions
from datavitals.roles import Roles
from datavitals.session import get_session

__all__ = [
    "DriftReport", "Roles", "Scan", "ScanOptions", "apply_issue_fix", "column_profile",
    "compare_cleaning", "compare_datasets", "data_contract", "dtype_summary", "get_session",
    "health_score", "preview_issue_fix", "run_quality_checks", "scan", "score_breakdown",
    "severity_counts", "simulate_cleaning", "table_overview",
]
