"""Readers: published tables, SQL, CSV and extract files."""

from layerflow.sources.tables import (
    first_rows,
    limit_rows,
    read_csv,
    read_dataset,
    read_extract,
    read_sql,
    sample_groups,
    sample_rows,
    scan,
)

__all__ = [
    "first_rows", "limit_rows", "read_csv", "read_dataset", "read_extract", "read_sql", "sample_groups", "sample_rows", "scan",
]
