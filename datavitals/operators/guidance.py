"""Guidance attached to issues: what it means, why it matters, what to do in Spark.

A dimension table of one row per issue type, joined to the issues by broadcast. `{column}` and
`{metric}` are filled in per issue."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from datavitals.operators.checks import RULES


@dataclass(frozen=True)
class Advice:
    display_name: str
    ml_impact: str
    business_impact: str
    why_this_matters: str
    suggested_fix: str
    example_code: str
    insight: str


# Display names are fixed values; they title issues in reports and in the run history.
ADVICE: dict[str, Advice] = {
    "missing_values": Advice(
        "Missing signal risk",
        "A model can pick up how the data was collected instead of what it describes.",
        "Totals and averages silently leave out part of the population.",
        "Gaps are rarely random: whoever was not measured often differs from whoever was.",
        "Find out why cells are empty, fill them with a value you can defend and keep a flag.",
        'df.withColumn("{column}_was_missing", F.col("{column}").isNull())',
        "Check whether the gaps in `{column}` ({metric}) already exist at prediction time.",
    ),
    "duplicate_rows": Advice(
        "Duplicate training signal",
        "Copies weigh some examples twice and can sit on both sides of a train/test split.",
        "Counts, sums and rates come out too high.",
        "The table looks larger and more certain than the evidence behind it.",
        "Agree on the business key, then keep one row per real event.",
        "df.dropDuplicates()",
        "Repeated rows ({metric}) add confidence without adding evidence.",
    ),
    "constant_column": Advice(
        "Non-informative feature",
        "A column with one value cannot separate any two outcomes.",
        "Often a stuck sensor, a default in an export or a dead field.",
        "It costs storage and attention and explains nothing.",
        "Drop it unless an audit needs the value.",
        'df.drop("{column}")',
        "`{column}` never varies here; ask whether its producer still works.",
    ),
    "high_cardinality_categorical": Advice(
        "Sparse categorical risk",
        "Encodings become wide and sparse, and rare labels are memorised.",
        "Reports split into segments too small to act on.",
        "Most labels occur too seldom to learn anything that carries over.",
        "Keep the frequent labels and pool the others, or encode by frequency.",
        'df.groupBy("{column}").count().orderBy(F.desc("count")).limit(20)',
        "`{column}` has {metric}; a few labels may carry nearly all of its signal.",
    ),
    "numeric_outliers_iqr": Advice(
        "Unstable distribution feature",
        "Extreme values dominate squared losses and scaling.",
        "They are either the most valuable cases or plain entry errors.",
        "A handful of rows can decide an average or a coefficient.",
        "Look at the rows, check units, then cap, transform, split off or keep on purpose.",
        'df.withColumn("{column}", F.least(F.greatest("{column}", F.lit(low)), F.lit(high)))',
        "Read the tail of `{column}` ({metric}) as a question about stability.",
    ),
    "likely_id_column": Advice(
        "Memorization-prone identifier",
        "A model can look rows up by it instead of generalising.",
        "Good for joins and tracing, useless as a rule.",
        "A value seen once teaches nothing about the next row.",
        "Keep it as a key, leave it out of the features.",
        'features = df.drop("{column}")',
        "`{column}` is a handle for rows, not a measurement of them.",
    ),
    "possible_wrong_dtype": Advice(
        "Possible schema mismatch",
        "Numbers kept as text are treated as unordered labels.",
        "Two systems may report different totals for one metric.",
        "Separators, currency signs or placeholders kept the column from being parsed.",
        "Strip the formatting and cast, turning what does not parse into NULL.",
        """df.withColumn("{column}", F.expr("try_cast(replace(`{column}`, ',', '') AS double)"))""",
        "Fix the type of `{column}` at the source so that serving sees what training saw.",
    ),
    "imbalanced_categorical": Advice(
        "Minority segment blind spot",
        "Overall accuracy says little about the small groups.",
        "A small but important group can be served badly unnoticed.",
        "When one label is nearly everything, averages describe only that label.",
        "Evaluate per group, pool very rare labels, watch the small ones separately.",
        'df.groupBy("{column}").count().orderBy(F.desc("count"))',
        "In `{column}` {metric}; look at the rest on its own.",
    ),
    "too_many_unique_values": Advice(
        "Possible train-time leakage signal",
        "Nearly unique fields can carry the row's identity or its outcome.",
        "Decisions that lean on them do not survive new data.",
        "One value per row behaves like a key or free text; true measurements may be fine.",
        "Decide which of these it is before using it.",
        'features = df.drop("{column}")',
        "`{column}` shows {metric}; harmless for a measurement, risky for anything else.",
    ),
    "suspicious_timestamp_granularity": Advice(
        "Suspicious timestamp granularity",
        "Exact times can encode row order or what happened after the event.",
        "Back-tests look better than live results.",
        "A raw time mostly says when something was logged.",
        "Derive hour, weekday or age known before the outcome, then drop the raw value.",
        'df.withColumn("{column}_hour", F.hour("{column}")).drop("{column}")',
        "`{column}` ({metric}) will never repeat its values in production.",
    ),
    "potential_target_leakage": Advice(
        "Potential target leakage",
        "A field filled in after the outcome hands the answer to the model.",
        "Results collapse once that field is empty at decision time.",
        "The name points to a label or to something recorded afterwards.",
        "Establish when it is written; keep only what exists before the prediction.",
        'features = df.drop("{column}")',
        "Date the writing of `{column}` against the moment of prediction.",
    ),
    "target_quality_risk": Advice(
        "Target quality risk",
        "Rows without a label cannot train or score a supervised model.",
        "Late or lost outcomes hide process gaps.",
        "Label completeness comes before any question about features.",
        "Train on labelled rows only, or repair the labelling.",
        'df.filter(F.col("{column}").isNotNull())',
        "`{column}` is the target, so its gaps ({metric}) come first.",
    ),
    "entity_id_integrity_risk": Advice(
        "Entity ID integrity risk",
        "Joins fan out and one entity lands in several splits.",
        "Customers, assets or accounts are counted more than once.",
        "The configured key promises one row per entity (and time).",
        "Settle the grain, then deduplicate, aggregate or pick another key.",
        'df.groupBy("{column}").count().filter("count > 1")',
        "`{column}` has {metric}; compare that with the table's intended grain.",
    ),
    "target_imbalance_risk": Advice(
        "Target imbalance risk",
        "Always predicting the common class already scores high.",
        "Rare outcomes that matter most are missed.",
        "Plain accuracy no longer tells good models from trivial ones.",
        "Split by class, use class-aware metrics, weigh or resample.",
        'df.groupBy("{column}").count()',
        "For `{column}` the {metric}; choose the metric before the model.",
    ),
    "empty_dataset": Advice(
        "Empty dataset",
        "There is nothing to train on or check.",
        "The export or the load before this step probably failed.",
        "Checks need at least one column and one row.",
        "Check the query, the separator, the encoding and the file.",
        "spark.read.option('header', True).csv(path).count()",
        "Trace the load before anything else.",
    ),
}
_DEFAULT_INSIGHT = "Review this finding for availability at prediction time and for its effect downstream."


def guidance_table(spark: SparkSession) -> DataFrame:
    names = ["issue_type", *(f.name for f in fields(Advice))]
    return spark.createDataFrame([(k, *astuple(a)) for k, a in ADVICE.items()], ", ".join(f"{n} string" for n in names))


def _filled(template: Column) -> Column:
    with_column = F.replace(template, F.lit("{column}"), F.col("column"))
    return F.replace(with_column, F.lit("{metric}"), F.coalesce("metric", F.lit("")))


def enrich(issues: DataFrame) -> DataFrame:
    """Issues with their guidance; an unknown type falls back to its own name and metric. The
    guidance table has a fixed number of rows, so it is broadcast."""
    joined = issues.join(F.broadcast(guidance_table(issues.sparkSession)), "issue_type", "left")
    title = F.initcap(F.replace(F.col("issue_type"), F.lit("_"), F.lit(" ")))
    fallback = F.coalesce("metric", F.lit(""))
    return joined.select(
        *issues.columns, F.coalesce("display_name", title).alias("display_name"),
        *[F.coalesce(c, fallback).alias(c) for c in ("ml_impact", "business_impact", "why_this_matters", "suggested_fix")],
        F.coalesce(_filled(F.col("example_code")), F.lit("# add a cleaning step")).alias("example_code"),
        F.coalesce(_filled(F.col("insight")), F.lit(_DEFAULT_INSIGHT)).alias("insight"),
    )


def _scoring_rules() -> tuple[tuple[str, str, str], ...]:
    """What the score is made of: the condition of each check, each severity it can have, and its issue type."""
    return tuple(
        (" ".join(when.split()), severity, issue_type)
        for _, issue_type, when, severities, *_ in RULES
        for severity in ("critical", "warning", "minor") if f"'{severity}'" in severities
    )


SCORING_RULES = _scoring_rules()


def scoring_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCORING_RULES, "rule string, severity string, issue_type string")


def rules_fired(issues: DataFrame) -> DataFrame:
    """Each scoring rule with the number of issues it raised in a scan."""
    rules = scoring_rules(issues.sparkSession)
    found = issues.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("fired"))
    joined = rules.join(F.broadcast(found), ["issue_type", "severity"], "left")
    return joined.select("rule", "severity", "issue_type", F.coalesce("fired", F.lit(0)).alias("fired"))
