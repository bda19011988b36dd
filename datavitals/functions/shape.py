"""The shape of text values: which look like numbers, tokens or prose.

A value's shape is a small bit set, its length and its number if it parses as one. A column's
shape is those, weighted by how often each value occurs."""

from __future__ import annotations

from datavitals.functions.cells import number_or_null

SHAPE = {"bits": "int", "length": "int", "number": "double"}
# The patterns that decide feature types.
_TESTS = {
    "numeric_like_rate": (r"(?U)^-?[\d,]+(\.\d+)?$",),
    "spaced_rate": (r"(?U)[\s\x1c-\x1f]",),
    "mixed_rate": ("[A-Za-z]", r"(?U)\d"),
    "sep_rate": ("[-_]",),
    "uuid_rate": ("^[0-9a-fA-F]{8}-[0-9a-fA-F-]{13,}$",),
}
BARS = (8, 30)   # median lengths that mark tokens and prose


def shape_of(text: str) -> dict[str, str]:
    """Shape of a stripped text, as SQL."""
    bits = []
    for i, patterns in enumerate(_TESTS.values()):
        test = " AND ".join(f"rlike({text}, r'{p}')" for p in patterns)
        bits.append(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END")
    return {
        "bits": f"CASE WHEN {text} IS NOT NULL THEN {' + '.join(bits)} END",
        "length": f"length({text})",
        "number": number_or_null(text),
    }


def shape_totals(n: str, prefix: str = "") -> dict[str, str]:
    """Weighted totals of the shape columns; every one is a map-side sum, min or max.

    Whether a median length reaches a bar needs no sort: it follows from how many lengths are
    below the bar and the two lengths next to it (an even count averages them)."""
    bits, length, number = (prefix + name for name in SHAPE)
    out = {"texts": f"sum(CASE WHEN {bits} IS NOT NULL THEN {n} END)"}
    for i, name in enumerate(_TESTS):
        out[name] = f"sum(CASE WHEN {bits} & {1 << i} <> 0 THEN {n} ELSE 0 END)"
    for bar in BARS:
        out[f"below_{bar}"] = f"sum(CASE WHEN {length} < {bar} THEN {n} ELSE 0 END)"
        out[f"under_{bar}"] = f"max(CASE WHEN {length} < {bar} THEN {length} END)"
        out[f"over_{bar}"] = f"min(CASE WHEN {length} >= {bar} THEN {length} END)"
    out |= {
        "num_present": f"sum(CASE WHEN {number} IS NOT NULL THEN {n} END)",
        "num_min": f"min({number})", "num_max": f"max({number})",
    }
    return out


def read_shape(row: dict) -> dict:
    """A column's shape facts from its totals."""
    n = row.get("texts") or 0
    if not n:
        return {}
    out = {name: row[name] / n for name in _TESTS}
    del out["spaced_rate"]
    out["compact_rate"] = (n - row["spaced_rate"]) / n
    for bar in BARS:
        below = row[f"below_{bar}"]
        if n % 2 == 0 and below == n // 2:
            out[f"median_ge{bar}"] = (row[f"under_{bar}"] + row[f"over_{bar}"]) / 2 >= bar
        else:
            out[f"median_ge{bar}"] = below <= (n - 1) // 2
    count = row["num_present"] or 0
    out["num_present"] = count
    if count:
        out |= {"num_min": row["num_min"], "num_max": row["num_max"]}
    return out
