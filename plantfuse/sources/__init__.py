"""Where tables come from: readers, declared schemas and the source registry."""

from plantfuse.sources.readers import TableSource, rows_frame, values_frame
from plantfuse.sources.registry import SourceDef, SourceError, Sources, TableDef

__all__ = [
    "SourceDef",
    "SourceError",
    "Sources",
    "TableDef",
    "TableSource",
    "rows_frame",
    "values_frame",
]
