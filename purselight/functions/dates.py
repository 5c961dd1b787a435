"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from purselight.schema import PERIODS, WEEKDAYS

# Month names of the churn export's time stamps; an unknown name counts as January.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def parse(text: Column) -> Column:
    """A time stamp; null where the text is none."""
    return F.try_to_timestamp(text)


def parse_churn(text: Column) -> Column:
    """A time stamp from text like 21OCT17:13:08:28, else as parse()."""
    pattern = r"^(\d{2})([A-Z]{3})(\d{2}):(\d{2}:\d{2}:\d{2})$"
    day, month, year, time = (F.regexp_extract(text, pattern, k) for k in range(1, 5))
    number = F.lit("01")
    for k, name in enumerate(MONTHS, 1):
        number = F.when(month == name, f"{k:02d}").otherwise(number)
    iso = F.concat(F.lit("20"), year, F.lit("-"), number, F.lit("-"), day, F.lit(" "), time)
    return F.when(text.rlike(pattern), F.try_to_timestamp(iso)).otherwise(F.try_to_timestamp(text))


def hour(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(0))


def weekday(ts: Column) -> Column:
    """Monday is 0; 0 for null."""
    return F.coalesce(F.weekday(ts), F.lit(0))


def day_number(ts: Column) -> Column:
    """Days since 2000-01-01; 0 for null."""
    return F.coalesce(F.datediff(ts, F.lit("2000-01-01").cast("date")), F.lit(0))


def weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), number + 1)


def period_of_day(hours: Column) -> Column:
    morning, day, evening, night = PERIODS
    return F.when(hours.between(6, 11), morning).when(hours.between(12, 17), day).when(hours.between(18, 23), evening).otherwise(night)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
