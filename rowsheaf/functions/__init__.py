"""Column functions: text cleaning, file names, sizes, time shift, match predicates."""

from rowsheaf.functions.predicates import match
from rowsheaf.functions.scalars import (
    clean_column_name,
    clean_filename,
    clean_value,
    format_file_size,
    local_timestamp,
    normalised_text,
)

__all__ = [
    "clean_column_name",
    "clean_filename",
    "clean_value",
    "format_file_size",
    "local_timestamp",
    "match",
    "normalised_text",
]
