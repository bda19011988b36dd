"""Cell-level expressions shared by the loaders, the scan and the fixes.

Expressions that are generated per column are written as SQL text: a table of a thousand columns
then costs a few calls into the JVM instead of tens of thousands."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from datavitals.functions.nested import canonical

# Texts that mean "missing" once stripped and lower-cased.
NULL_WORDS = ("", "null", "nan", "n/a", "na")

# Ways to write a date, by the shape of the text. Where two share a shape, the month comes first unless
# more values can be read the other way round.
_DATE_SHAPES = {
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "M-d-yyyy": r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy": r"\d{1,2}-\d{1,2}-\d{4}",
    "M.d.yyyy": r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy": r"\d{1,2}\.\d{1,2}\.\d{4}",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}", "yyyy.M.d": r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyyMMdd": r"\d{8}",
    "d MMM yyyy": r"\d{1,2} [A-Z][a-z]{2} \d{4}", "MMM d, yyyy": r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "d-MMM-yyyy": r"\d{1,2}-[A-Z][a-z]{2}-\d{4}",
}
_CLOCK_SHAPES = {"": "", " H:mm": r" \d{1,2}:\d{2}", " H:mm:ss": r" \d{1,2}:\d{2}:\d{2}"}
WRITTEN_TIMES = {d + c: f"^{ds}{cs}$" for d, ds in _DATE_SHAPES.items() for c, cs in _CLOCK_SHAPES.items()}

SHORT_TEXT = 64   # bytes; longer texts are grouped by digest

# Unicode white space plus the four ASCII separators that Java's \s leaves out. The look-behind
# keeps long inner runs of blanks linear.
_BLANK = r"[\s\x1c-\x1f]"
_OUTER_BLANKS = rf"(?U)^{_BLANK}+|(?<!{_BLANK}){_BLANK}+$"
_NUMBER_TEXT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"
_ISO_DATE_START = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cell(name: str) -> Column:
    return F.col(quoted(name))


def stripped(c: str) -> str:
    """Text without outer blanks; only a text with a blank at either end is rewritten."""
    ends = f"concat(left({c}, 1), right({c}, 1))"
    return f"CASE WHEN rlike({ends}, r'(?U){_BLANK}') THEN regexp_replace({c}, r'{_OUTER_BLANKS}', '') ELSE {c} END"


def text_or_null(c: str) -> str:
    """Strip a text cell; null-like words become NULL."""
    words = ", ".join(literal(w) for w in NULL_WORDS)
    return f"CASE WHEN lower({stripped(c)}) NOT IN ({words}) THEN {stripped(c)} END"


def number_or_null(clean: str) -> str:
    """Stripped text to double; anything that is not a plain number becomes NULL."""
    return f"CASE WHEN rlike({clean}, r'{_NUMBER_TEXT}') THEN try_cast({clean} AS double) END"


def timestamp_or_null(c: str, formats: tuple[str, ...] = (), written: str = "ISO") -> str:
    """Text to timestamp: as the column is `written` (functions/times.py), then each given pattern, else NULL."""
    clean = stripped(c)
    tries = [written_time(clean, written), *[f"try_to_timestamp({clean}, {literal(fmt)})" for fmt in formats]]
    return f"coalesce({', '.join(tries)})"


def written_time(clean: str, written: str) -> str:
    """Stripped text to timestamp in one way of writing: "ISO", or a pattern of WRITTEN_TIMES."""
    if written == "ISO":
        return f"CASE WHEN rlike({clean}, r'{_ISO_DATE_START}') THEN try_cast({clean} AS timestamp) END"
    return f"CASE WHEN rlike({clean}, r'{WRITTEN_TIMES[written]}') THEN try_to_timestamp({clean}, {literal(written)}) END"


def short_key(c: str) -> str:
    """A text's grouping key: itself when short, else its SHA-256 digest behind a mark that makes the key
    longer than any short text, so that counting distinct documents shuffles 65 bytes per row
    instead of the document and no text equals another's digest."""
    return f"CASE WHEN octet_length({c}) > {SHORT_TEXT} THEN concat('#', sha2({c}, 256)) ELSE {c} END"


def group_key(f: Field) -> str:
    """A positional cell as it is grouped with others of its column: long texts by digest, nested cells in canonical form."""
    if f.kind == "string":
        return short_key(f.pos)
    return canonical(f.type, f.pos) if f.kind == "opaque" else f.pos


def rounded(x: Column, places: int = 4) -> Column:
    """Round on the binary value, halves away from zero. Spark's round() works on the shortest
    decimal text of a double and so lifts 0.00015 read as 9 / 60000, stored just below that."""
    scale = 10.0**places
    near = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(F.abs(x) < 1e11, near).otherwise(x)


@dataclass(frozen=True)
class Field:
    """One user column as the engine sees it."""

    ord: int
    name: str
    kind: str      # integral, floating, string, boolean, temporal, opaque
    dtype: str     # logical name: int64, float64, object, bool, datetime64[ns]
    stored: str    # Spark type name
    type: T.DataType | None = field(default=None, compare=False, repr=False)

    @property
    def pos(self) -> str:
        return f"c{self.ord}"

    @property
    def slot(self) -> str:
        return self.stored if self.kind == "temporal" or self.stored == "decimal" else self.kind

    @property
    def numeric(self) -> bool:
        return self.kind in ("integral", "floating")


_KINDS = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integral", "int64"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "floating", "float64"),
    ((T.StringType, T.CharType, T.VarcharType), "string", "object"),
    ((T.BooleanType,), "boolean", "bool"),
    ((T.DateType, T.TimestampType, T.TimestampNTZType), "temporal", "datetime64[ns]"),
)


def fields_of(df: DataFrame) -> list[Field]:
    result = []
    for i, f in enumerate(df.schema.fields):
        kind, dtype = next(
            ((kind, dtype) for classes, kind, dtype in _KINDS if isinstance(f.dataType, classes)), ("opaque", "object")
        )
        result.append(Field(i, f.name, kind, dtype, f.dataType.typeName(), f.dataType))
    return result


def positional(df: DataFrame, text=None) -> DataFrame:
    """Rename columns to c0..cN (names may clash in case or hold dots) and turn NaN into NULL;
    `text` maps a text cell to its expression.

    Being a projection, it costs nothing and still prunes to the columns later steps use."""
    out = []
    for f in fields_of(df):
        if f.stored in ("float", "double"):
            out.append(f"CASE WHEN NOT isnan({f.pos}) THEN {f.pos} END AS {f.pos}")
        elif text is not None and f.kind == "string":
            out.append(f"{text(f.pos)} AS {f.pos}")
        else:
            out.append(f.pos)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).selectExpr(*out)
