from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanOptions:
    """How a scan works; none of these changes what it finds, but for the name of a type.

    dtype_mode     "spark" keeps integers with nulls as int64; "pandas" reports them as float64.
    walk_limit     most rows of one column that a single task may sort to find a quantile;
                   larger columns are narrowed first (plans/quantiles.py).
    chunk          columns per aggregation job, to stay below codegen's method size limit.
    sketch_k       size parameter of the sketches that propose where a quantile lies.
    timestamp_formats  extra text patterns tried after ISO when parsing timestamps.
    """

    dtype_mode: str = "spark"
    walk_limit: int = 50_000
    chunk: int = 60
    sketch_k: int = 4096
    timestamp_formats: tuple[str, ...] = ()
