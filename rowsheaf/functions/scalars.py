"""Scalar column functions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
FILENAME_ILLEGAL = '<>:"/\\|?*'
FILENAME_EMPTY = "output"
FILENAME_LENGTH = 200
EMPTY_COLUMN_NAME = "列_"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
SIZE_STEP = 1024.0
LOCAL_OFFSET_HOURS = 8
# Characters that a searched or shown value never has.
DROPPED = "\t\r\n"

# Unicode white space and the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_value(c: str | Column) -> Column:
    """Text without tabs and line ends, stripped; NULL becomes the empty text."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return _strip(F.translate(text, DROPPED, ""))


def normalised_text(c: str | Column) -> Column:
    """The stored side of a text match: tabs and line feeds dropped, spaces trimmed."""
    return F.trim(F.translate(_col(c).cast("string"), "\t\n", ""))


def clean_column_name(name: str | Column, position: str | Column) -> Column:
    """Name without quotes and white space; an empty one is named after its 1-based position."""
    bare = F.regexp_replace(F.regexp_replace(_col(name), "[\"']", ""), f"(?U){_SPACE}+", "")
    return (
        F.when(bare.isNull(), "")
        .when(bare == "", F.concat(F.lit(EMPTY_COLUMN_NAME), _col(position).cast("string")))
        .otherwise(bare)
    )


def clean_filename(c: str | Column) -> Column:
    """A name every file system takes."""
    safe = F.translate(_col(c), FILENAME_ILLEGAL, "_" * len(FILENAME_ILLEGAL))
    safe = F.regexp_replace(_strip(safe), r"^\.+|\.+$", "")
    return F.substring(F.when(safe == "", FILENAME_EMPTY).otherwise(safe), 1, FILENAME_LENGTH)


def format_file_size(c: str | Column) -> Column:
    """Bytes as ``1.5 MB``: steps of 1024, one decimal, ties to even."""
    size = _col(c).cast("double")
    text = None
    for power, unit in enumerate(SIZE_UNITS):
        scaled = size / F.lit(SIZE_STEP**power)
        shown = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        if text is None:
            text = F.when(scaled < SIZE_STEP, shown)
        elif unit != SIZE_UNITS[-1]:
            text = text.when(scaled < SIZE_STEP, shown)
        else:
            text = text.otherwise(shown)
    return F.when(size.isNotNull(), text)


def local_timestamp(c: str | Column, hours: int = LOCAL_OFFSET_HOURS) -> Column:
    """UTC instant shown on a clock ``hours`` ahead."""
    return _col(c) + F.expr(f"INTERVAL '{hours}' HOUR")
