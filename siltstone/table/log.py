"""A versioned commit log: one JSON document per version, published by creating its file.

The storage refuses to create a file that exists, so exactly one writer publishes a
version, and a torn file is never seen. The newest version is the highest one listed.
"""

from __future__ import annotations

import json
import re

from siltstone.table.storage import Storage, open_storage

_NAME = re.compile(r"(\d{20})\.json")


class CommitLog:
    """The log of a table or of some other state, in the folder ``_log`` of a storage (or of a local path)."""

    def __init__(self, storage: Storage | str):
        self.storage = storage if isinstance(storage, Storage) else open_storage(storage)

    @property
    def folder(self) -> str:
        return self.storage.uri("_log").removeprefix("file://")

    @staticmethod
    def _name(version: int) -> str:
        return f"_log/{version:020d}.json"

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.storage.names("_log") if (m := _NAME.fullmatch(n)))

    def read(self, version: int) -> dict:
        return json.loads(self.storage.read(self._name(version)))

    def latest(self) -> tuple[int, dict | None]:
        """(version, document) of the newest version; (-1, None) if there is none. An unreadable one raises."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (-1, None)

    def publish(self, version: int, document: dict) -> None:
        """Create ``version``; :class:`~siltstone.table.errors.CommitConflict` if it exists."""
        self.storage.create(self._name(version), json.dumps(document).encode())

    def trim(self, keep: int, versions: list[int] | None = None) -> None:
        """Remove all but the newest ``keep`` versions (of those listed, or of ``versions``)."""
        for v in (self.versions() if versions is None else versions)[: -max(1, keep)]:
            self.storage.delete(self._name(v))
