"""Timestamp text and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch.schemas import JSON_OPTIONS

# The accepted timestamp layout, with either separator between date and time.  Anything
# after the seconds is ignored.
_LAYOUT = "yyyy-MM-dd HH:mm:ss"
_SEPARATORS = (" ", "T")


def signal_timestamp(text: Column) -> Column:
    """Whole-second timestamp from signal text; null where the layout does not fit."""
    # One pattern for both separators, so that a text is parsed once.
    plain = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8))
    fits = F.substring(text, 11, 1).isin(*_SEPARATORS)
    return F.when(fits, F.try_to_timestamp(plain, F.lit(_LAYOUT)))


def json_text(*columns: Column | str) -> Column:
    """One JSON object of the given columns."""
    return F.to_json(F.struct(*columns), JSON_OPTIONS)


def json_map(text: Column, values: T.DataType | None = None) -> Column:
    """JSON object text as a map of text keys."""
    return F.from_json(text, T.MapType(T.StringType(), values or T.StringType()))
