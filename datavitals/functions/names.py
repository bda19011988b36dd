"""Column-name rules: normalised names and the meaning a name suggests."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Name fragments that decide feature types and leakage checks.
# A fragment matches anywhere in the lower-cased name, so "width" does contain "id".
CONTINUOUS_FRAGMENTS = (
    "price", "volume", "temperature", "temp", "sensor", "reading", "return", "returns",
    "amount", "value", "rate", "ratio", "score", "measurement",
)
IDENTIFIER_FRAGMENTS = ("id", "uuid", "guid", "key", "identifier")
TIME_FRAGMENTS = ("date", "time", "timestamp", "created", "updated")
LEAKAGE_FRAGMENTS = (
    "target", "label", "outcome", "churned", "converted", "conversion", "defaulted",
    "fraud", "post_", "after_",
)
# File-name prefixes dropped when naming a monitor.
MONITOR_PREFIXES = ("baseline_", "broken_", "new_", "production_", "prod_")


def pattern(fragments: tuple[str, ...]) -> str:
    return "|".join(fragments)


def name_has(name: str, fragments: tuple[str, ...]) -> bool:
    """The rules' name test at plan time, for deciding which aggregates a column needs."""
    return re.search(pattern(fragments), name.lower()) is not None


def normalized_names(names: list[str]) -> list[str]:
    """Trim and lower-case; the second "a" becomes "a__1", the third "a__2"."""
    repeats: dict[str, int] = {}
    result = []
    for raw in names:
        name = str(raw).strip().lower()
        nth = repeats.get(name, -1) + 1
        repeats[name] = nth
        result.append(f"{name}__{nth}" if nth else name)
    return result


def monitor_name(path: Column) -> Column:
    """Monitor name of a file path: no folder, no extension, at most one known prefix."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    # A leading dot belongs to the name (".profile" has no extension).
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    return F.regexp_replace(stem, "^(" + "|".join(MONITOR_PREFIXES) + ")", "")
