"""What has been done: batches by layer, the processed list, the file watermark and schema changes.

One JSON document, replaced as a whole, beside the tables, so that any driver finds it. A document that can't be read
is an error; it is never taken for an empty one.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from strata.plans.files import SharedFiles, _written

LAYERS = ("bronze", "silver", "gold")
PENDING, SUCCESS, FAILED = "PENDING", "SUCCESS", "FAILED"


class Ledger:
    """files: the file system that the document is on; without it the path is a local one."""

    def __init__(self, path: str | Path, files: SharedFiles | None = None):
        self.path, self.files = str(path), files

    def _load(self) -> dict:
        if self.files is None:
            text = Path(self.path).read_text() if Path(self.path).exists() else None
        else:
            text = self.files.read_text(self.path) if self.files.exists(self.path) else None
        return {"batches": {}, "processed": [], "watermark": None, "schema_changes": []} if text is None else json.loads(text)

    def _save(self, state: dict) -> None:
        text = json.dumps(state, indent=2, sort_keys=True)
        if self.files is not None:
            self.files.replace(self.path, text)
            return
        folder = Path(self.path).parent
        folder.mkdir(parents=True, exist_ok=True)
        os.replace(_written(folder, text), self.path)

    @staticmethod
    def _now() -> str:
        return datetime.now(UTC).isoformat()

    def start(self, batch: str) -> None:
        """Layers of a new batch are pending; a known batch stays as it is."""
        state = self._load()
        if batch not in state["batches"]:
            state["batches"][batch] = dict.fromkeys(LAYERS, PENDING) | {"updated_at": self._now()}
            self._save(state)

    def mark(self, batch: str, layer: str, status: str) -> None:
        if layer not in LAYERS or status not in (PENDING, SUCCESS, FAILED):
            raise ValueError(f"no such layer or status: {layer}, {status}")
        state = self._load()
        entry = state["batches"].setdefault(batch, dict.fromkeys(LAYERS, PENDING))
        entry |= {layer: status, "updated_at": self._now()}
        self._save(state)

    def status(self, batch: str, layer: str) -> str:
        return self._load()["batches"].get(batch, {}).get(layer, PENDING)

    def done(self, batch: str, layer: str) -> bool:
        return self.status(batch, layer) == SUCCESS

    def complete(self, batch: str) -> bool:
        return all(self.done(batch, layer) for layer in LAYERS)

    def processed(self) -> list[str]:
        return self._load()["processed"]

    def finish(self, batch: str, processed_at: str | None = None) -> None:
        """Register a batch as processed and move the watermark, in one replacement of the document."""
        state = self._load()
        if batch not in state["processed"]:
            state["processed"].append(batch)
        state["watermark"] = {"last_processed_file": batch, "processed_at": processed_at or self._now()}
        self._save(state)

    def watermark(self) -> dict | None:
        return self._load()["watermark"]

    def schema_changed(self, change: dict) -> None:
        state = self._load()
        state["schema_changes"].append(change | {"registered_at": self._now()})
        self._save(state)

    def schema_changes(self) -> list[dict]:
        return self._load()["schema_changes"]
