"""Quality checks: rules over column facts, giving one row per issue.

All rules are column expressions over the small facts relation, so detection is one projection
after the scan and never touches user rows again."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from datavitals.functions import names
from datavitals.functions.cells import literal
from datavitals.plans.facts import TableFacts, metrics_frame, refreshed_facts, table_facts
from datavitals.plans.options import ScanOptions
from datavitals.roles import Roles

# What the rules read, derived from a facts row in order. Each step may use the ones before it.
_DERIVED = (
    {
        "present": "rows - missing",
        "ratio": "unique_ratio",
        "is_column": "kind <> 'dataset'",
        "named_id": f"rlike(lower(column), '{names.pattern(names.IDENTIFIER_FRAGMENTS)}')",
        "measured": f"rlike(lower(column), '{names.pattern(names.CONTINUOUS_FRAGMENTS)}')",
        "timed": f"rlike(lower(column), '{names.pattern(names.TIME_FRAGMENTS)}')",
        "leaking": f"rlike(lower(column), '{names.pattern(names.LEAKAGE_FRAGMENTS)}')",
        "token_like": """coalesce(median_ge8 AND compact_rate >= 0.90D
            AND (mixed_rate >= 0.50D OR sep_rate >= 0.50D OR uuid_rate >= 0.50D), false)""",
        "low_variance": """coalesce(num_present >= 10 AND num_distinct_gt2 AND num_mean <> 0
            AND try_divide(num_std, abs(num_mean)) < 0.01D, false)""",
        "whole": "kind = 'integral' AND dtype = 'int64' AND all_integral",
    },
    {
        # First match wins; the ratio keeps missing rows in its denominator.
        "feature_type": """CASE
            WHEN timed THEN 'timestamp-like'
            WHEN kind = 'string' AND (named_id OR token_like) THEN 'identifier-like'
            WHEN kind = 'string' AND median_ge30 THEN 'free-text-like'
            WHEN kind = 'string' THEN 'categorical'
            WHEN whole AND named_id AND ratio >= 0.90D THEN 'identifier-like'
            WHEN whole AND NOT measured AND ratio >= 0.98D THEN 'identifier-like'
            WHEN whole AND n_unique <= least(20, greatest(2, rows div 10)) THEN 'ordinal'
            WHEN kind IN ('integral', 'floating', 'boolean') THEN 'continuous numeric'
            ELSE 'categorical' END""",
    },
    {
        "duplicate_rate": "duplicate_rows / greatest(1, rows)",
        "top_share": "try_divide(top_n, present)",
        "key_rate": "try_divide(key_duplicates, key_rows)",
        "parse_rate": "CASE WHEN kind = 'string' THEN parsed WHEN kind IN ('integral', 'floating', 'temporal') THEN present END / greatest(1, rows)",
        "parsed_ratio": "CASE WHEN kind = 'string' THEN parsed_unique ELSE n_unique END / greatest(1, rows)",
        "identifier": """coalesce(is_column AND NOT ml_excluded AND rows >= 2 AND present > 0 AND ratio >= 0.95D
            AND feature_type <> 'continuous numeric' AND (named_id OR token_like OR (low_variance AND NOT measured)), false)""",
    },
)

# check number, issue type, condition, severity, value, metric text, whether the feature type is told
RULES = (
    (1, "missing_values", "is_column AND missing > 0",
     "CASE WHEN missing_rate > 0.40D THEN 'critical' WHEN missing_rate >= 0.05D THEN 'warning' ELSE 'minor' END",
     "missing_rate", "format_string('%.1f%% missing', missing_rate * 100)", False),
    (2, "duplicate_rows", "NOT is_column AND duplicate_rows > 0",
     "CASE WHEN duplicate_rate > 0.20D THEN 'critical' ELSE 'warning' END",
     "duplicate_rate", "format_string('%.1f%% duplicate rows', duplicate_rate * 100)", False),
    (3, "constant_column", "is_column AND missing = 0 AND n_unique = 1", "'critical'", "1", "'1 unique value'", False),
    (4, "high_cardinality_categorical",
     """is_column AND NOT ml_excluded AND rows >= 2 AND kind = 'string' AND feature_type = 'categorical'
        AND n_unique >= 50 AND ratio >= 0.30D""",
     "'warning'", "ratio", "format_string('%d unique values (%.1f%% of rows)', n_unique, ratio * 100)", False),
    (5, "numeric_outliers_iqr", "is_column AND present >= 4 AND differs AND outlier_rate > 0",
     "CASE WHEN outlier_rate > 0.10D THEN 'critical' ELSE 'minor' END",
     "outlier_rate", "format_string('%.1f%% outside IQR bounds', outlier_rate * 100)", False),
    (6, "likely_id_column", "identifier", "'warning'", "ratio", "format_string('%.1f%% unique values', ratio * 100)", True),
    (7, "possible_wrong_dtype", "kind = 'string' AND numeric_like_rate >= 0.80D", "'minor'", "numeric_like_rate",
     "format_string('%.1f%% numeric-looking strings', numeric_like_rate * 100)", False),
    (8, "imbalanced_categorical", "kind = 'string' AND NOT protected AND n_unique >= 2 AND top_share >= 0.95D", "'warning'",
     "top_share", "format_string('top category is %.1f%% of non-missing rows', top_share * 100)", False),
    (9, "suspicious_timestamp_granularity",
     "is_column AND rows >= 10 AND timed AND NOT is_timestamp AND parse_rate >= 0.80D AND parsed_ratio > 0.80D", "'warning'",
     "parsed_ratio", "format_string('%.1f%% unique timestamp values', parsed_ratio * 100)", False),
    (10, "potential_target_leakage", "is_column AND leaking AND NOT is_target", "'warning'", "NULL",
     "'name suggests target or post-outcome signal'", False),
    (11, "entity_id_integrity_risk", "is_column AND is_entity AND key_duplicates > 0",
     "CASE WHEN key_rate <= 0.20D THEN 'warning' ELSE 'critical' END", "key_rate",
     "format_string('%.1f%% duplicate non-missing keys (%s)', key_rate * 100, key_label)", False),
    (12, "too_many_unique_values",
     """is_column AND NOT ml_excluded AND rows >= 10 AND NOT identifier
        AND feature_type IN ('identifier-like', 'free-text-like') AND n_unique > 20 AND ratio > 0.80D""",
     "CASE WHEN feature_type = 'identifier-like' THEN 'warning' ELSE 'minor' END",
     "ratio", "format_string('%d unique values (%.1f%% of rows)', n_unique, ratio * 100)", True),
    (13, "target_quality_risk", "is_target AND missing > 0", "CASE WHEN missing_rate > 0.05D THEN 'critical' ELSE 'warning' END",
     "missing_rate", "format_string('%.1f%% target missing', missing_rate * 100)", False),
    (14, "target_imbalance_risk", "is_target AND n_unique >= 2 AND top_share >= 0.90D", "'warning'", "top_share",
     "format_string('top target class is %.1f%%', top_share * 100)", False),
)
_EMPTY = (0, "empty_dataset", "NOT is_column", "'critical'", "rows", "'no usable rows or columns'", False)


def _issue(rule: tuple) -> str:
    check, kind, when, severity, value, metric, typed = rule
    feature = "feature_type" if typed else "CAST(NULL AS string)"
    return (
        f"CASE WHEN {when} THEN struct({check} AS check_ord, col_ord, '{kind}' AS issue_type, column, {severity} AS severity, "
        f"CAST({value} AS double) AS metric_value, {metric} AS metric, {feature} AS feature_type) END"
    )


def _role_flags(roles: Roles) -> dict[str, str]:
    def among(members) -> str:
        return f"column IN ({', '.join(literal(m) for m in sorted(members))})" if members else "false"

    label = " + ".join(x for x in (roles.entity_id, roles.timestamp) if x)
    return {
        "ml_excluded": among(roles.ml_excluded), "protected": among(roles.protected),
        "is_target": among([roles.target] if roles.target else []),
        "is_entity": among([roles.entity_id] if roles.entity_id else []),
        "is_timestamp": among([roles.timestamp] if roles.timestamp else []), "key_label": literal(label),
    }


def derived(facts_frame: DataFrame, roles: Roles) -> DataFrame:
    """Facts rows with everything the rules read, feature types included."""
    for step in (_role_flags(roles), *_DERIVED):
        facts_frame = facts_frame.selectExpr("*", *[f"{sql} AS {name}" for name, sql in step.items()])
    return facts_frame


def issues_of(facts_frame: DataFrame, roles: Roles) -> DataFrame:
    """Issue rows from a facts relation that includes the dataset row."""
    rules = ", ".join(_issue(r) for r in RULES)
    return (
        derived(facts_frame, roles)
        .selectExpr(f"inline(array_compact(CASE WHEN rows = 0 THEN array({_issue(_EMPTY)}) ELSE array({rules}) END))")
        .orderBy("check_ord", "col_ord")
    )


class Scan:
    """One table's scan. Facts are collected once, on first use; everything else derives from them."""

    def __init__(self, df: DataFrame, roles=None, options: ScanOptions | None = None, unique: str = "rules"):
        self.df, self.roles = df, Roles.of(roles)
        self.options, self.unique = options or ScanOptions(), unique
        self._known: tuple[TableFacts, set[str]] | None = None

    def after(self, df: DataFrame, changed: set[str] | None) -> Scan:
        """A scan of what this table became: the facts of columns that are not `changed` are kept. None stands for other rows, which
        leave nothing to keep."""
        scan = Scan(df, self.roles, self.options, self.unique)
        scan._known = None if changed is None else (self.facts, changed)
        return scan

    @cached_property
    def facts(self) -> TableFacts:
        if self._known is not None:
            return refreshed_facts(self.df, *self._known, self.roles, self.options, self.unique)
        return table_facts(self.df, self.roles, self.options, self.unique, keys=True)

    @cached_property
    def metrics(self) -> DataFrame:
        frame = metrics_frame(self.df.sparkSession, self.facts, self.options)
        return derived(frame, self.roles).select(*frame.columns, "feature_type")

    @cached_property
    def issues(self) -> DataFrame:
        frame = metrics_frame(self.df.sparkSession, self.facts, self.options, with_dataset=True)
        return issues_of(frame, self.roles)


def scan(df: DataFrame, roles=None, options: ScanOptions | None = None) -> Scan:
    return Scan(df, roles, options)


def run_quality_checks(df: DataFrame, roles=None, options: ScanOptions | None = None) -> DataFrame:
    return Scan(df, roles, options).issues


def by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") == severity)


def ml_columns(metrics: DataFrame, roles=None) -> DataFrame:
    """Columns the feature checks look at."""
    return metrics.filter(f"NOT {_role_flags(Roles.of(roles))['ml_excluded']}")
