"""Source registry and the rule that picks a live table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableDef:
    """A declared table: DDL columns with comments, key, defaults, expected rows."""

    name: str
    ddl: str
    key: tuple[str, ...] = ()
    comment: str = ""
    defaults: Mapping[str, object] = field(default_factory=dict)
    generated_key: str | None = None
    expected_rows: int | None = None
    #: (column, lower, upper, partitions) by which a database's table is read in parallel.
    split: tuple[str, str, str, int] | None = None


@dataclass(frozen=True)
class SourceDef:
    """A source. ``access`` is "files" (read by Spark) or "query" (sent to a database)."""

    key: str
    label: str
    access: str
    tables: tuple[TableDef, ...]

    def table(self, name: str) -> TableDef:
        return next(t for t in self.tables if t.name == name)


class SourceError(RuntimeError):
    """A table of a source that is on could not be loaded."""


class Sources:
    """Tables by ``source.table`` name, some of whose sources may be off.

    Only a source named in ``off`` is absent. A table of any other that cannot
    be loaded (a wrong path, no permission, no driver, no connection) fails the
    job that asks for it: a summary of the rest would be wrong without a word.
    """

    def __init__(
        self, loaders: Mapping[str, Callable[[], DataFrame]], off: Collection[str] = ()
    ) -> None:
        self._loaders = {n: f for n, f in loaders.items() if n.split(".")[0] not in off}
        self._loaded: dict[str, DataFrame] = {}
        self.absent = sorted(set(loaders) - set(self._loaders))

    def without(self, *off: str) -> Sources:
        return Sources(self._loaders, off)

    def names(self) -> list[str]:
        return list(self._loaders)

    def find(self, name: str) -> DataFrame | None:
        """The table, or None if its source is off."""
        if name not in self._loaders:
            return None
        if name not in self._loaded:
            try:
                self._loaded[name] = self._loaders[name]()
            except Exception as error:
                raise SourceError(f"{name}: {error}") from error
        return self._loaded[name]

    def has(self, *alternatives: str) -> bool:
        """Whether the source of any of the tables is on; nothing is loaded."""
        return any(name in self._loaders for name in alternatives)

    def first(self, *alternatives: str) -> DataFrame:
        """The first alternative whose source is on."""
        for name in alternatives:
            frame = self.find(name)
            if frame is not None:
                return frame
        raise LookupError(f"no live source among {', '.join(alternatives)}")

    def live(self, *names: str) -> list[DataFrame]:
        """Those of the named tables whose sources are on."""
        return [f for f in map(self.find, names) if f is not None]
