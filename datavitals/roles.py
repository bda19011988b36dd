"""Column roles that change which checks apply (target, time, entity, protected)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    target: str = ""
    timestamp: str = ""
    entity_id: str = ""
    protected: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    @classmethod
    def of(cls, value: "Roles | Mapping | None") -> "Roles":
        """Accept a Roles object, a settings mapping with missing entries, or nothing."""
        if isinstance(value, Roles):
            return value
        given = value or {}
        return cls(
            target=given.get("target_column") or "",
            timestamp=given.get("timestamp_column") or "",
            entity_id=given.get("entity_id_column") or "",
            protected=tuple(given.get("protected_columns") or ()),
            excluded=tuple(given.get("exclude_ml_columns") or ()),
        )

    @property
    def ml_excluded(self) -> frozenset[str]:
        """Columns left out of feature checks; the target stays in."""
        named = {*self.protected, *self.excluded, self.timestamp, self.entity_id}
        return frozenset(named - {""})

    def as_settings(self) -> dict:
        return {
            "target_column": self.target or None,
            "timestamp_column": self.timestamp or None,
            "entity_id_column": self.entity_id or None,
            "protected_columns": list(self.protected),
            "excluded_from_ml_checks": list(self.excluded),
        }
