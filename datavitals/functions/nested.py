"""A form of any cell that Spark can hash, sort and group, equal for equal cells.

Maps, whose entries have no order and which Spark refuses to group, become arrays of entries sorted by key and value.
Inside arrays, maps and structs, at every depth, NaN counts as missing and minus zero as zero, as they do in plain columns;
a missing cell stays missing and differs from an empty one. Types that have no order of their own are compared as text."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.CharType, T.VarcharType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType,
)


def canonical(kind: T.DataType, value: str, depth: int = 0) -> str:
    """SQL for the canonical form of `value`, a SQL expression of this type."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN NOT isnan({value}) THEN {value} + CAST(0 AS {kind.simpleString()}) END"
    if isinstance(kind, T.ArrayType):
        x = f"x{depth}"
        inner = canonical(kind.elementType, x, depth + 1)
        return value if inner == x else f"transform({value}, {x} -> {inner})"
    if isinstance(kind, T.MapType):
        x = f"x{depth}"
        key, held = canonical(kind.keyType, f"{x}.key", depth + 1), canonical(kind.valueType, f"{x}.value", depth + 1)
        return f"array_sort(transform(map_entries({value}), {x} -> struct({key} AS key, {held} AS value)))"
    if isinstance(kind, T.StructType):
        fields = [canonical(f.dataType, f"{value}.`{f.name.replace('`', '``')}`", depth) for f in kind.fields]
        named = ", ".join(f"{c} AS f{i}" for i, c in enumerate(fields))
        return f"CASE WHEN {value} IS NOT NULL THEN {f'struct({named})' if fields else 'true'} END"
    if isinstance(kind, T.VariantType):
        return f"to_json({value})"
    if isinstance(kind, _PLAIN):
        return value
    return f"CAST({value} AS string)"
