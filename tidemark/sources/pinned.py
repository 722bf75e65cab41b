"""A view of a store that stays on one version until it is told to reload."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.commits import Store


class Unavailable(RuntimeError):
    """The store holds no version to read."""


class Pinned:
    """Tables of a :class:`~tidemark.streaming.commits.Store` as of one version: every read agrees with every other, whatever is committed meanwhile.

    The version is taken at the first read. A store without one is unavailable, and is tried again at the next read.
    """

    def __init__(self, store: Store) -> None:
        self.store = store
        self.version: int | None = None

    def table(self, name: str, schema: str) -> DataFrame:
        if self.version is None:
            self.reload()
        return self.store.table(name, schema, self.version)

    def reload(self) -> int:
        """Move on to the newest version."""
        known = self.store.versions()
        if not known:
            raise Unavailable(f"{self.store.root} holds no version")
        self.version = known[-1]
        return self.version

    def stale(self) -> bool:
        """Whether a newer version has been published."""
        return self.version is not None and self.store.versions()[-1] > self.version
