"""Validation contracts derived from a table's facts."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from datavitals.functions.cells import positional
from datavitals.plans.facts import logical_dtype, table_facts
from datavitals.plans.frequency import as_text
from datavitals.plans.options import ScanOptions
from datavitals.roles import Roles

# Fixed values of every contract.
VERSION, MAX_MISSING_RATE, LISTED_VALUES = "0.1", 0.05, 20

CONTRACT = pa.schema([
    ("col_ord", pa.int32()), ("column", pa.string()), ("dtype", pa.string()), ("max_missing_rate", pa.float64()),
    ("nullable", pa.bool_()), ("is_inferred", pa.bool_()), ("min_value", pa.float64()), ("max_value", pa.float64()),
    ("allowed_values", pa.list_(pa.string())), ("unique", pa.bool_()), ("monitor_as_key", pa.bool_()),
])


def data_contract(df: DataFrame, roles=None, options: ScanOptions | None = None) -> DataFrame:
    """One row per column. Values are listed only for columns with 1 to 20 distinct ones, so
    gathering them is bounded by 20 per column."""
    roles, options = Roles.of(roles), options or ScanOptions()
    facts = table_facts(df, roles, options, unique="all", probs=(), fences=False)
    listed = [f for f in facts.fields if 0 < (facts.of(f, "n_unique") or 0) <= LISTED_VALUES]
    values: dict[int, list[str]] = {}
    if listed:
        entries = ", ".join(f"struct({f.ord} AS ord, {as_text(f, f.pos)} AS value)" for f in listed)
        found = (
            positional(df).selectExpr(f"inline(array({entries}))").filter("value is not null")
            .groupBy("ord").agg(F.array_sort(F.collect_set("value")).alias("found"))
        )
        values = {r["ord"]: r["found"] for r in found.collect()}
    rows = []
    for f in facts.fields:
        missing, n_unique = facts.of(f, "missing"), facts.of(f, "n_unique")
        rows.append({
            "col_ord": f.ord, "column": f.name, "dtype": logical_dtype(f, missing, options),
            "max_missing_rate": MAX_MISSING_RATE, "nullable": missing > 0, "is_inferred": True,
            "min_value": facts.of(f, "min") if f.numeric else None,
            "max_value": facts.of(f, "max") if f.numeric else None,
            "allowed_values": values.get(f.ord), "unique": True if f.name == roles.entity_id else None,
            "monitor_as_key": facts.rows > 0 and n_unique == facts.rows,
        })
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=CONTRACT))


def contract_document(contract: DataFrame, roles=None, generated_at: str | None = None) -> DataFrame:
    """The contract as one JSON document (one row, column `contract`)."""
    names = [r["column"] for r in contract.orderBy("col_ord").select("column").collect()]
    header = json.dumps({
        "contract_version": VERSION,
        "generated_at": generated_at or datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "required_columns": names, "roles": Roles.of(roles).as_settings(),
    }, ensure_ascii=False)
    rules = F.struct(
        "dtype", "max_missing_rate", "nullable", "is_inferred", "min_value", "max_value", "allowed_values", "unique"
    )
    ordered = F.array_sort(F.collect_list(F.struct("col_ord", "column", rules.alias("rules"))))
    columns = F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["column"], e["rules"])))
    return contract.agg(
        F.concat(F.lit(header[:-1] + ', "columns": '), F.to_json(columns), F.lit("}")).alias("contract")
    )
