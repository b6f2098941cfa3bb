"""Business-day arithmetic as plain Spark expressions.

Every business day gets a running index, so a count is a subtraction of two indexes and
an offset is an index lookup in the other direction:

* with ``t`` the day number counted from a Monday, ``n`` allowed weekdays and
  ``before[w]`` allowed weekdays before weekday ``w``, the number of allowed weekdays
  before a day is ``t // 7 * n + before[t % 7]``;
* subtracting the holidays before that day gives the index;
* the inverse adds back the holidays passed on the way and turns the weekday number
  into a date.

No Python runs per row. Holidays are bits of a literal table, so a count is two array reads
and the bits of one word, however long the holiday list is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = Column | str | date | datetime
# Monday to Friday are business days unless a mask says otherwise.
DEFAULT_MASK = (True, True, True, True, True, False, False)
# 1970-01-01 was a Thursday, three days after a Monday.
_EPOCH_SHIFT = 3
# Days of a block of the lookup tables.
_BLOCK = 64


def week_mask(mask: Iterable[bool] | None) -> tuple[bool, ...]:
    """Validate a Monday-first mask of seven booleans."""
    if mask is None:
        return DEFAULT_MASK
    days = tuple(mask)
    if len(days) != 7:
        raise ValueError(f"A week mask has seven Monday-first entries, got {len(days)}.")
    if any(type(day) is not bool for day in days):
        raise TypeError("A week mask holds booleans only.")
    if not any(days):
        raise ValueError("A week mask needs at least one business day.")
    return days


def holiday_dates(holidays: Iterable[date | datetime | str] | None) -> tuple[date, ...]:
    """Validate holidays: dates, datetimes or ISO text; sorted, without duplicates."""
    days = set()
    for item in holidays or ():
        if isinstance(item, str):
            days.add(date.fromisoformat(item))
        elif isinstance(item, datetime):
            days.add(item.date())
        elif isinstance(item, date):
            days.add(item)
        else:
            raise TypeError(f"A holiday is a date, a datetime or ISO text, got {item!r}.")
    return tuple(sorted(days))


def as_date(value: DateLike) -> Column:
    """A column, column name or Python date as a date column."""
    if isinstance(value, str):
        value = F.col(value)
    elif not isinstance(value, Column):
        value = F.lit(value)
    return value.cast("date")


def _literal_ints(values: list[int], kind: str = "int") -> Column:
    # Folded by the optimizer into one array literal.
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _count_at_most(values: list[int], bound: Column) -> Column:
    """How many of the sorted ``values`` are <= ``bound``.

    A bitmap with one 64-bit word per block of days, and the number of bits before each word: the
    count is that number and the bits of the word up to the bound. Blocks outside the list are an
    empty word at either end, so nothing is conditional and Spark computes what is shared once,
    however often the expression is pasted into another.
    """
    if not values:
        return F.lit(0)
    different = sorted(set(values))
    low = different[0] // _BLOCK
    words = [0] * (different[-1] // _BLOCK - low + 3)
    for value in different:
        block, bit = divmod(value, _BLOCK)
        words[block - low + 1] |= 1 << bit
    before = [0]
    for word in words[:-1]:
        before.append(before[-1] + word.bit_count())
    signed = [word - (1 << 64) if word >> 63 else word for word in words]
    block = F.floor(bound / _BLOCK) - (low - 1)
    place = F.greatest(F.lit(0), F.least(F.lit(len(words) - 1), block)).cast("int")
    after = F.lit(_BLOCK - 1) - F.pmod(bound, F.lit(_BLOCK)).cast("int")
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), after)
    found = F.bit_count(F.get(_literal_ints(signed, "bigint"), place).bitwiseAND(upto))
    rank = F.get(_literal_ints(before), place) + found
    if len(different) == len(values):
        return rank
    # Equal values are one bit each; how many there are up to it stands in a second table.
    upto_bit = [0, *(bisect_right(values, value) for value in different)]
    return F.get(_literal_ints(upto_bit), rank)


class BusinessCalendar:
    """One week mask plus one holiday list, applied to columns."""

    def __init__(self, mask: Iterable[bool] | None = None, holidays=None) -> None:
        self.mask = week_mask(mask)
        self.holidays = holiday_dates(holidays)
        self._weekdays = [day for day, allowed in enumerate(self.mask) if allowed]
        self._before = [sum(self.mask[:day]) for day in range(7)]
        epoch = date(1970, 1, 1)
        # Only holidays that would otherwise be business days change a count.
        self._closed = [
            (day - epoch).days for day in self.holidays if self.mask[day.weekday()]
        ]

    def _weekday_count(self, day: int) -> int:
        weeks, weekday = divmod(day + _EPOCH_SHIFT, 7)
        return weeks * len(self._weekdays) + self._before[weekday]

    def _index(self, day: Column) -> Column:
        """Business days strictly before the day number ``day``."""
        shifted = day + _EPOCH_SHIFT
        weekday = F.pmod(shifted, F.lit(7))
        allowed = F.floor(shifted / 7) * len(self._weekdays) + F.get(
            _literal_ints(self._before), weekday
        )
        return allowed - _count_at_most(self._closed, day - 1)

    def _day_at(self, index: Column) -> Column:
        """The date of the business day with this index."""
        # Holiday i shifts every index from (weekdays before it) - i onwards by one.
        thresholds = [self._weekday_count(day) - i for i, day in enumerate(self._closed)]
        number = index + _count_at_most(thresholds, index)
        size = len(self._weekdays)
        slot = F.pmod(number, F.lit(size)).cast("int")
        day = F.floor(number / size) * 7 + F.get(_literal_ints(self._weekdays), slot)
        return F.date_from_unix_date((day - _EPOCH_SHIFT).cast("int"))

    def is_business_day(self, day: DateLike) -> Column:
        number = F.unix_date(as_date(day))
        weekday = F.pmod(number + _EPOCH_SHIFT, F.lit(7))
        allowed = F.get(F.array(*[F.lit(flag) for flag in self.mask]), weekday)
        return allowed & ~number.isin(self._closed) if self._closed else allowed

    # The index of the day after a day counts that day in, the index of the day itself does
    # not. Choosing between the two with a 0/1 shift covers both directions of a span or an
    # offset in one expression, small enough for the JVM to compile; nulls pass through.

    def networkdays(
        self, start: DateLike, end: DateLike, *, count_first_day: bool = False
    ) -> Column:
        """Signed count of business days, both ends included."""
        start, end = as_date(start), as_date(end)
        forward = (start <= end).cast("int")
        size = self._index(F.unix_date(end) + forward) - self._index(
            F.unix_date(start) + 1 - forward
        )
        if count_first_day:
            size = size + F.when(self.is_business_day(start), 0).otherwise(2 * forward - 1)
        return size.cast("bigint")

    def workday(
        self, start: DateLike, days: Column | str | int, *, count_first_day: bool = False
    ) -> Column:
        """The date ``days`` business days away from ``start``."""
        start = as_date(start)
        if isinstance(days, str):
            days = F.col(days)
        elif not isinstance(days, Column):
            days = F.lit(days)
        days = days.cast("bigint")
        forward = (days > 0).cast("int")
        here = self._index(F.unix_date(start) + forward)
        if not count_first_day:
            return self._day_at(here + days - forward)
        # The start is day one, on a closed day too, so every move is one shorter.
        moved = self._day_at(here + days + 1 - 3 * forward)
        # Not a choice of one or the other, which would keep what is shared from being shared.
        way = F.datediff(moved, start) * (F.abs(days) > 1).cast("int")
        return F.date_add(start, way)

    def next_business_day(self, day: DateLike) -> Column:
        """The day itself when it is a business day, else the next one."""
        return self._day_at(self._index(F.unix_date(as_date(day))))

    def previous_business_day(self, day: DateLike) -> Column:
        """The day itself when it is a business day, else the one before."""
        return self._day_at(self._index(F.unix_date(as_date(day)) + 1) - 1)


def networkdays(start, end, *, holidays=None, count_first_day=False, mask=None) -> Column:
    """Signed inclusive business-day count between two dates, as ``bigint``."""
    return BusinessCalendar(mask, holidays).networkdays(
        start, end, count_first_day=count_first_day
    )


def workday(start, days, *, holidays=None, count_first_day=False, mask=None) -> Column:
    """The date a signed number of business days away from ``start``."""
    return BusinessCalendar(mask, holidays).workday(start, days, count_first_day=count_first_day)


def is_business_day(day, *, holidays=None, mask=None) -> Column:
    return BusinessCalendar(mask, holidays).is_business_day(day)


def next_business_day(day, *, holidays=None, mask=None) -> Column:
    return BusinessCalendar(mask, holidays).next_business_day(day)


def previous_business_day(day, *, holidays=None, mask=None) -> Column:
    return BusinessCalendar(mask, holidays).previous_business_day(day)
