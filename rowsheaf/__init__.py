"""Bulk work on delimited files and event tables, as Spark jobs."""

from rowsheaf.operators.extract import ExtractResult, count_matches, extract, extract_to_csv
from rowsheaf.operators.merge import (
    MergeResult,
    merge_lines,
    merge_manifest,
    merge_ordered,
    merge_tables,
    write_merged_lines,
    write_merged_table,
)
from rowsheaf.operators.profile import column_profile, describe_columns, name_mapping
from rowsheaf.operators.sampling import sample_values
from rowsheaf.operators.split import (
    Split,
    SplitResult,
    manifest,
    read_parts,
    split_file,
    split_lines,
    split_table,
    split_table_to_csv,
    write_parts,
)
from rowsheaf.plans.files import drop_scratch
from rowsheaf.session import build_session
from rowsheaf.sinks.csv import read_export, write_csv
from rowsheaf.sources.encoding import encoding_profile, group_by_encoding, scan_encoded
from rowsheaf.sources.inventory import file_inventory, numbered_inventory, total_size
from rowsheaf.sources.lines import count_lines, scan_lines
from rowsheaf.sources.records import scan_csv_records, scan_records
from rowsheaf.sources.tables import count_rows, infer_types, preview, scan_csv

__all__ = [
    "ExtractResult",
    "MergeResult",
    "Split",
    "SplitResult",
    "build_session",
    "column_profile",
    "count_lines",
    "count_matches",
    "count_rows",
    "describe_columns",
    "drop_scratch",
    "encoding_profile",
    "extract",
    "extract_to_csv",
    "file_inventory",
    "group_by_encoding",
    "infer_types",
    "manifest",
    "merge_lines",
    "merge_manifest",
    "merge_ordered",
    "merge_tables",
    "name_mapping",
    "numbered_inventory",
    "preview",
    "read_export",
    "read_parts",
    "sample_values",
    "scan_csv",
    "scan_csv_records",
    "scan_encoded",
    "scan_lines",
    "scan_records",
    "split_file",
    "split_lines",
    "split_table",
    "split_table_to_csv",
    "total_size",
    "write_csv",
    "write_merged_lines",
    "write_merged_table",
    "write_parts",
]
