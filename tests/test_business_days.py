import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import business_days as bd

SUNDAY_TO_THURSDAY = (True, True, True, True, False, False, True)


def april(day):
    return date(2026, 4, day)


def counts(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "start date, end date")
    return [r[0] for r in df.select(bd.networkdays("start", "end", **options)).collect()]


def offsets(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "start date, days int")
    return [r[0] for r in df.select(bd.workday("start", "days", **options)).collect()]


def test_counts_both_ends_and_negates_reversed_spans(spark):
    spans = [(april(13), april(14)), (april(11), april(13)), (april(14), april(13))]
    assert counts(spark, spans) == [2, 1, -2]


@pytest.mark.parametrize(
    "holidays",
    [[april(14)], ["2026-04-14", april(14), datetime(2026, 4, 14, 9)]],
    ids=["one", "three spellings"],
)
def test_holidays_are_left_out_once(spark, holidays):
    assert counts(spark, [(april(13), april(15))], holidays=holidays) == [2]


def test_first_day_can_be_forced(spark):
    spans = [(april(11), april(13)), (april(13), april(15)), (april(15), april(13))]
    assert counts(spark, spans, holidays=[april(13)]) == [0, 2, -2]
    assert counts(spark, spans, holidays=[april(13)], count_first_day=True) == [1, 3, -2]


def test_mask(spark):
    assert counts(spark, [(april(13), april(19))], mask=SUNDAY_TO_THURSDAY) == [5]
    assert offsets(spark, [(april(17), 1)], mask=SUNDAY_TO_THURSDAY) == [april(19)]


def test_null_ends_give_null(spark):
    spans = [(None, april(13)), (april(13), None), (april(13), april(13))]
    assert counts(spark, spans) == [None, None, 1]
    assert offsets(spark, [(None, 1), (april(13), None)]) == [None, None]


def test_timestamps_count_by_date(spark):
    df = spark.createDataFrame(
        [(datetime(2026, 4, 13, 23, 59), datetime(2026, 4, 15, 0, 1))], "a timestamp, b timestamp"
    )
    assert df.select(bd.networkdays("a", "b", holidays=["2026-04-14"])).first()[0] == 2
    scalar = bd.networkdays(datetime(2026, 4, 13, 8, 30), F.col("b"))
    assert df.select(scalar).first()[0] == 3


def test_offsets(spark):
    moves = [(april(13), 1), (april(11), 1), (april(13), -1), (april(11), 0)]
    assert offsets(spark, moves) == [april(14), april(13), april(10), april(13)]
    assert offsets(spark, [(april(13), 2)], holidays=[april(14)]) == [april(16)]


def test_offsets_with_the_start_as_day_one(spark):
    moves = [(april(13), 1), (april(11), 1), (april(13), 2)]
    plain = offsets(spark, moves, holidays=[april(13)])
    forced = offsets(spark, moves, holidays=[april(13)], count_first_day=True)
    assert plain == [april(14), april(14), april(15)]
    assert forced == [april(13), april(11), april(14)]


def test_no_offset_from_a_closed_day_rolls_forward(spark):
    closed = (False, True, True, True, True, False, False)
    assert offsets(spark, [(date(2015, 8, 23), 0)], mask=closed) == [date(2015, 8, 25)]


@pytest.mark.parametrize(
    "mask, error",
    [((True,) * 6, ValueError), ((1,) * 7, TypeError), ((False,) * 7, ValueError)],
)
def test_invalid_masks(mask, error):
    with pytest.raises(error):
        bd.BusinessCalendar(mask)


@pytest.mark.parametrize("holiday, error", [(20260414, TypeError), ("14 April", ValueError)])
def test_invalid_holidays(holiday, error):
    with pytest.raises(error):
        bd.BusinessCalendar(holidays=[holiday])


@pytest.mark.parametrize("seed", range(4))
def test_against_numpy(spark, seed, monkeypatch):
    random.seed(seed)
    mask = [random.random() < 0.6 for _ in range(7)]
    mask[random.randrange(7)] = True
    first = date(1960, 1, 1)

    def some_day():
        return first + timedelta(days=random.randrange(8000))

    holidays = [some_day() for _ in range(200)]
    rows = [(some_day(), some_day(), random.randint(-40, 40)) for _ in range(600)]
    calendar = bd.BusinessCalendar(mask, holidays)
    got = spark.createDataFrame(rows, "s date, e date, m int").select(
        "s", "e", "m",
        calendar.networkdays("s", "e").alias("count"),
        calendar.workday("s", "m").alias("plain"),
        calendar.workday("s", "m", count_first_day=True).alias("forced"),
        calendar.is_business_day("s").alias("open"),
        calendar.next_business_day("s").alias("next"),
        calendar.previous_business_day("s").alias("previous"),
    ).collect()
    numpy_calendar = np.busdaycalendar([int(day) for day in mask], holidays)

    def move(day, size, roll="forward"):
        return np.busday_offset(day, size, roll=roll, busdaycal=numpy_calendar).astype(object)

    for row in got:
        low, high = sorted((row.s, row.e))
        size = np.busday_count(low, high + timedelta(days=1), busdaycal=numpy_calendar)
        assert row["count"] == (size if row.s <= row.e else -size)
        opened = bool(np.is_busday(row.s, busdaycal=numpy_calendar))
        ahead, back = move(row.s, 0), move(row.s, 0, "backward")
        assert (row.open, row.next, row.previous) == (opened, ahead, back)
        if opened or row.m == 0:
            assert row.plain == move(row.s, row.m)
        else:
            assert row.plain == (move(ahead, row.m - 1) if row.m > 0 else move(back, row.m + 1))
        # The n-th day counted, the start being the first one whatever day it is.
        if row.m == 0 or (abs(row.m) == 1):
            assert row.forced == row.s
        elif row.m > 0:
            assert row.forced == (move(row.s, row.m - 1) if opened else move(ahead, row.m - 2))
        else:
            assert row.forced == (move(row.s, row.m + 1) if opened else move(back, row.m + 2))
