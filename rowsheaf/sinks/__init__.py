"""Writers."""

from rowsheaf.sinks.csv import csv_line, header_text, read_export, write_csv

__all__ = ["csv_line", "header_text", "read_export", "write_csv"]
