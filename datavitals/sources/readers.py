"""Loading tables: any Spark source, and CSV with null words and type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from datavitals.functions.cells import literal, text_or_null
from datavitals.functions.normalize import normalize_values
from datavitals.session import stage
from datavitals.sources.records import spanning_records, survey

# Cell texts a CSV load reads as missing, as written, before blanks are stripped.
CSV_NULLS = (
    "", " ", "null", "NULL", "NaN", "nan", "N/A", "na", "NA", "None", "n/a", "<NA>", "#N/A", "#N/A N/A", "#NA",
    "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)
_WHOLE = r"^\s*[+-]?\d+\s*$"
_REAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_BOOL = r"^(True|False|TRUE|FALSE|true|false)$"
_CORRUPT = "_unreadable"


def load(spark: SparkSession, source, fmt: str = "parquet", normalize: bool = True, **options) -> DataFrame:
    """Any source Spark reads (parquet, orc, json, jdbc, a table name with fmt="table")."""
    df = spark.table(source) if fmt == "table" else spark.read.format(fmt).options(**options).load(source)
    return normalize_values(df) if normalize else df


def _as(kind: str, c: str) -> str:
    if kind == "boolean":
        return f"CASE WHEN rlike({c}, r'{_BOOL}') THEN CAST(lower({c}) AS boolean) END"
    pattern = _WHOLE if kind == "bigint" else _REAL
    return f"CASE WHEN rlike({c}, r'{pattern}') THEN try_cast(trim({c}) AS {kind}) END"


def read_csv(
    spark: SparkSession, path, schema: T.StructType | str | None = None, strict: bool = True, sep: str = ",",
    staged: bool = False, **options,
) -> DataFrame:
    """Read CSV files, turn null words into NULL, and type each column from its values.

    Types are tried in the order whole number, float, boolean; anything else, dates included,
    stays text. One pass decides all columns, and the result is a lazy projection of the files.
    Records may span lines: files stay split all the same (sources/records.py). With `strict`, an empty source,
    rows with too many fields, files with other headers and bytes that are not UTF-8 raise ValueError; text that rightly holds
    a replacement character is text. An explicit schema replaces inference. With `staged`, the typed table is written
    once as Parquet to the shared folder, so that a scan's passes read only the columns they use
    instead of parsing the text again."""
    given = {"header": True, "sep": sep, "escape": '"', "mode": "PERMISSIVE"} | options
    ours = not {"multiLine", "quote", "escape", "lineSep", "encoding", "charset", "header"} & set(options)
    try:
        seen = survey(spark, path, sep) if ours else {"open": 0, "headers": 1, "broken": None, "split": False}
        names = spark.read.options(**given | ({"multiLine": True} if seen["open"] else {})).csv(path).columns
    except AnalysisException as error:
        raise ValueError(f"the CSV source cannot be read: {error.getCondition()}") from error
    if not names:
        raise ValueError("the CSV source is empty: a header and at least one column are needed")
    if strict and seen["headers"] > 1:
        raise ValueError("the CSV files have different headers")
    if strict and seen["broken"]:
        raise ValueError(f"the CSV source is not valid UTF-8: line {seen['broken']['line']} of {seen['broken']['file']}")
    stored = [f"c{i}" for i in range(len(names))]
    as_text = T.StructType([T.StructField(n, T.StringType()) for n in [*stored, _CORRUPT]])
    if seen["open"] and seen["split"]:
        # some records span lines, and some file has several splits: records are put together first, split by split
        how = {k: str(v) for k, v in given.items() if k != "header"} | {"multiLine": "true", "columnNameOfCorruptRecord": _CORRUPT}
        records = spanning_records(spark, path, sep).where("NOT header")
        raw = records.select(F.from_csv("record", as_text.toDDL(), how).alias("r")).select("r.*")
    else:
        given |= {"multiLine": True} if seen["open"] else {}   # files of one split are one task anyway
        raw = spark.read.options(**given).option("columnNameOfCorruptRecord", _CORRUPT).schema(as_text).csv(path)
    nulls = ", ".join(literal(x) for x in CSV_NULLS)

    def value(c: str) -> str:
        return f"CASE WHEN {c} NOT IN ({nulls}) THEN {text_or_null(c)} END"

    clean = raw.selectExpr(*[f"{value(n)} AS {n}" for n in stored], _CORRUPT)
    # One row per cell, so that the tests are written once however many columns there are. A short row is
    # padded with NULLs, as usual; only surplus fields make a row malformed.
    quoted_rest = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    surplus = f"{_CORRUPT} IS NOT NULL AND size(split({_CORRUPT}, r'{_escaped(sep)}{quoted_rest}')) > {len(stored)}"
    entries = [f"struct({i} AS ord, {n} AS v)" for i, n in enumerate(stored)] + [f"struct(-1 AS ord, CASE WHEN {surplus} THEN 'x' END AS v)"]
    cells = raw.selectExpr(f"inline(array({', '.join(entries)}))").selectExpr("ord", f"{value('v')} AS v")
    found = {r["ord"]: r for r in cells.groupBy("ord").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("present"),
        *[F.expr(f"count({_as(k, 'v')})").alias(k) for k in ("bigint", "double", "boolean")]).collect()}
    if strict and found and found[-1]["present"]:
        raise ValueError(f"the CSV source has {found[-1]['present']} rows with too many fields")
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        typed = [F.col(n).try_cast(f.dataType).alias(n) for n, f in zip(stored, wanted.fields)]
        table = clean.select(*typed).toDF(*wanted.names)
    else:
        table = clean.selectExpr(*[f"{_typed(n, found.get(i))} AS {n}" for i, n in enumerate(stored)]).toDF(*names)
    return stage(table, "csv") if staged else table


def _typed(n: str, found) -> str:
    if found is None or not found["present"]:
        return _as("double", n)
    if found["present"] == found["bigint"]:
        return _as("bigint", n)
    if found["present"] == found["double"]:
        return _as("double", n)
    # A boolean column with gaps stays text: its missing cells have no boolean.
    if found["present"] == found["boolean"] == found["rows"]:
        return _as("boolean", n)
    return n


def _escaped(sep: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)

