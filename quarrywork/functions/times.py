"""Times of flights: the one that counts, and the hours between two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_of

#: The texts of the errors.
NO_TIME = "Flight has no estimated or scheduled datetime."
BACKWARDS = "Departure occurs before arrival."


def effective(estimated: Column, scheduled: Column, strict: bool = False) -> Column:
    """The estimated time, or the scheduled one where that is null or empty. strict: an error where both are."""
    text = first_of(estimated.cast("string"), scheduled.cast("string"))
    found = F.to_timestamp_ntz(F.regexp_replace(text, "T", " "))
    return F.when(found.isNull(), F.raise_error(F.lit(NO_TIME))).otherwise(found) if strict else found


def hours_between(arrival: Column, departure: Column, strict: bool = False) -> Column:
    """Hours with two digits; null, or with strict an error, where the departure comes first."""
    seconds = F.timestamp_diff("SECOND", arrival, departure)
    back = F.raise_error(F.lit(BACKWARDS)) if strict else F.lit(None).cast("double")
    return F.when(seconds < 0, back).otherwise(F.round(seconds / F.lit(3600.0), 2))


def valid_date(text: Column) -> Column:
    """yyyy-MM-dd as a date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
