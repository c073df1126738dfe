"""Schema contracts: differences, policy and what a table's business columns are."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql.types import StructType

AUDIT = ("created_at", "updated_at", "pipeline_name", "batch_id")


class ContractError(ValueError):
    """A batch whose schema the policy rejects."""


#: The reasons that decisions give.
RETYPED, REMOVED, APPROVED = "Data type changes detected.", "Columns have been removed.", "Schema approved."


@dataclass(frozen=True)
class Difference:
    new_columns: tuple[str, ...] = ()
    removed_columns: tuple[str, ...] = ()
    type_changes: tuple[tuple[str, str, str], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.new_columns or self.removed_columns or self.type_changes)

    def as_dict(self) -> dict:
        changes = [dict(zip(("column", "old_type", "new_type"), c, strict=True)) for c in self.type_changes]
        return {"new_columns": list(self.new_columns), "removed_columns": list(self.removed_columns), "type_changes": changes}

    def report(self) -> list[str]:
        return (
            [f"new column: {c}" for c in self.new_columns]
            + [f"removed column: {c}" for c in self.removed_columns]
            + [f"type of {c}: {a} became {b}" for c, a, b in self.type_changes]
        )


@dataclass(frozen=True)
class Decision:
    approved: bool
    reason: str


def business(schema: StructType, audit: Iterable[str] = AUDIT) -> StructType:
    return StructType([f for f in schema.fields if f.name not in set(audit)])


def difference(existing: StructType, incoming: StructType) -> Difference:
    """Names are compared as they are, types by their text; nullability isn't part of a contract."""
    old, new = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (existing, incoming))
    return Difference(
        tuple(sorted(new.keys() - old.keys())),
        tuple(sorted(old.keys() - new.keys())),
        tuple((c, old[c], new[c]) for c in sorted(old.keys() & new.keys()) if old[c] != new[c]),
    )


def decide(diff: Difference, optional: Iterable[str] = ()) -> Decision:
    """Changed types, then removed columns (but optional ones), are rejected; new columns are approved."""
    if diff.type_changes:
        return Decision(False, RETYPED)
    if set(diff.removed_columns) - set(optional):
        return Decision(False, REMOVED)
    return Decision(True, APPROVED)


def enforce(existing: StructType | None, incoming: StructType, optional: Iterable[str] = ()) -> Difference:
    diff = difference(business(existing), business(incoming)) if existing is not None else Difference()
    decision = decide(diff, optional)
    if not decision.approved:
        raise ContractError(f"{decision.reason} {'; '.join(diff.report())}")
    return diff
