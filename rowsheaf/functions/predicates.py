"""Type-aware match of one column against one searched value.

==================  =====================  ==========================================
searched value      column type            rows that match
==================  =====================  ==========================================
blank               number                 NULL or zero
blank               anything else          NULL or blank text
a number            FLOAT, DOUBLE          closer than 0.000001, in 32-bit floats
a number            anything else          equal as a 32-bit float ("007" matches 7)
other text          number                 printed number equals the text
other text          anything else          normalised text equals the text
==================  =====================  ==========================================
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.functions.scalars import DROPPED, normalised_text

# Fixed values
TOLERANCE = 0.000001

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_DIGITS = r"\d+(?:_\d+)*"
# What counts as a number in a text column; digits may be grouped with single underscores.
NUMBER_TEXT = rf"^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"


def clean_search_value(value: object) -> str:
    """The searched value without :data:`DROPPED`, and without white space at its ends; ``None`` is blank."""
    if value is None:
        return ""
    kept = (c for c in str(value) if c not in DROPPED)
    return "".join(kept).strip()


def parse_number(text: str) -> float | None:
    """``text`` as a finite number, else ``None``; ``nan`` and ``inf`` are text."""
    try:
        number = float(text)
    except ValueError:
        return None
    return number if math.isfinite(number) else None


def _as_number(c: Column, dtype: T.DataType, to: str) -> Column:
    """``c`` as a number, NULL where it is none."""
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMBER_TEXT), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast(to))
    if isinstance(dtype, (*_INTEGERS, *_FLOATS, T.DecimalType, T.BooleanType)):
        return c.try_cast(to)
    return F.lit(None).cast(to)


def _as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, _FLOATS):
        infinite = F.lit(float("inf"))
        special = F.when(F.isnan(c), "nan").when(c == infinite, "inf").when(c == -infinite, "-inf")
        return special.otherwise(c.cast("string"))
    return c.cast("string")


def _float32_neighbours(number: float, margin: float) -> tuple[float, float] | None:
    """Bounds that hold every double which, rounded to 32 bits, may match ``number``."""
    with np.errstate(over="ignore"):
        low, high = np.float32(number - margin), np.float32(number + margin)
        low, high = np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))
    return (float(low), float(high)) if np.isfinite(low) and np.isfinite(high) else None


def _pushable_range(c: Column, dtype: T.DataType, number: float) -> Column | None:
    """A range implied by the exact test, which file scans can use on their statistics."""
    bounds = _float32_neighbours(number, 2 * TOLERANCE if isinstance(dtype, _FLOATS) else 0.0)
    if bounds is None:
        return None
    low, high = bounds
    if isinstance(dtype, _INTEGERS):
        limit = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(dtype)]
        low, high = max(math.floor(low), -(2**limit)), min(math.ceil(high), 2**limit - 1)
        if low > high:
            return F.lit(False)
        return c.between(F.lit(low).cast(dtype), F.lit(high).cast(dtype))
    if isinstance(dtype, _FLOATS):
        return c.between(F.lit(low).cast(dtype), F.lit(high).cast(dtype))
    return None


def _text_match(c: Column, dtype: T.DataType, text: str) -> Column:
    """Normalised text equals ``text`` (NULL counts as blank), behind a plain test that scans can use.

    Normalising changes only values with a tab, a line feed or a space at an end; all others have to
    be ``text`` as they are. Most rows fail this first, before their text is rewritten.
    """
    exact = normalised_text(c) == text
    as_it_is = (c == text) | c.contains("\t") | c.contains("\n") | c.startswith(" ") | c.endswith(" ")
    if text == "":
        exact, as_it_is = c.isNull() | exact, c.isNull() | as_it_is
    return as_it_is & exact if isinstance(dtype, T.StringType) else exact


def match(c: Column, dtype: T.DataType, value: object, precision: str = "float32") -> Column:
    """Predicate for rows of ``c`` that match ``value``.

    ``precision="double"`` compares numbers in 64 bits, where 16777216 and 16777217 differ.
    """
    if precision not in ("float32", "double"):
        raise ValueError(f"unknown precision: {precision}")
    text = clean_search_value(value)
    numeric = isinstance(dtype, (*_INTEGERS, *_FLOATS))
    if text == "":
        return (c.isNull() | (c == 0)) if numeric else _text_match(c, dtype, "")
    number = parse_number(text)
    if number is None:
        return _as_text(c, dtype) == text if numeric else _text_match(c, dtype, text)
    single = precision == "float32" and abs(number) <= float(np.finfo(np.float32).max)
    to = "float" if single else "double"
    stored, wanted = _as_number(c, dtype, to), F.lit(number).cast(to)
    if isinstance(dtype, _FLOATS):
        exact = F.abs(stored - wanted) < F.lit(TOLERANCE).cast(to)
    else:
        exact = stored == wanted
    implied = _pushable_range(c, dtype, number)
    return exact if implied is None else implied & exact


def match_column(df: DataFrame, column: str, value: object, precision: str = "float32") -> Column:
    """:func:`match` with the type looked up in ``df``."""
    field = next((f for f in df.schema.fields if f.name == column), None)
    if field is None:
        raise KeyError(column)
    return match(df[f"`{column.replace('`', '``')}`"], field.dataType, value, precision)
