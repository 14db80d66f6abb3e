"""Per-entity analytics over tables that live in several sources, on PySpark."""
