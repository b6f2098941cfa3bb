"""Vertical concatenation, strict and with common column types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sortkeys import quoted

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_REAL = [T.FloatType(), T.DoubleType()]


def _common(left: T.DataType, right: T.DataType) -> T.DataType:
    if left == right or isinstance(right, T.NullType):
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        return T.StringType()
    kinds = [left, right]
    numbers = [k for k in kinds if isinstance(k, T.NumericType)]
    if len(numbers) == 1 and any(isinstance(k, T.BooleanType) for k in kinds):
        return numbers[0]
    if len(numbers) == 2:
        if any(k in _REAL for k in kinds):
            # Four-byte reals cannot hold every four-byte whole number.
            small = (T.ByteType(), T.ShortType(), T.FloatType())
            return T.FloatType() if all(k in small for k in kinds) else T.DoubleType()
        if all(k in _WHOLE for k in kinds):
            return max(kinds, key=_WHOLE.index)
        digits = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
        exact = [
            k if isinstance(k, T.DecimalType) else T.DecimalType(digits[k], 0) for k in kinds
        ]
        scale = max(k.scale for k in exact)
        whole = max(k.precision - k.scale for k in exact)
        return T.DecimalType(min(38, whole + scale), scale)
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if all(isinstance(k, moments) for k in kinds):
        stamps = [k for k in kinds if not isinstance(k, T.DateType)]
        if len(stamps) == 1:
            return stamps[0]
    raise TypeError(f"No common type for {left.simpleString()} and {right.simpleString()}.")


def common_type(types: Iterable[T.DataType]) -> T.DataType:
    """The narrowest type that holds all of them; text wins over everything else."""
    return reduce(_common, types)


def _same_columns(frames: Sequence[DataFrame]) -> list[str]:
    if not frames:
        raise ValueError("Nothing to concatenate.")
    names = frames[0].columns
    for frame in frames[1:]:
        if frame.columns != names:
            raise ValueError(f"Frames differ in their columns: {names} and {frame.columns}")
    return names


def concat_strict(*frames: DataFrame) -> DataFrame:
    """Stack frames that have the same columns with the same types."""
    _same_columns(frames)
    for frame in frames[1:]:
        for first, other in zip(frames[0].schema, frame.schema):
            if first.dataType != other.dataType:
                raise TypeError(f"Column {first.name} has different types.")
    return reduce(lambda a, b: a.unionByName(b), frames)


def concat_relaxed(*frames: DataFrame) -> DataFrame:
    """Stack frames that have the same columns, cast to a common type per column."""
    names = _same_columns(frames)
    types = {name: common_type(frame.schema[name].dataType for frame in frames) for name in names}
    cast = [
        frame.select(*[F.col(quoted(n)).cast(types[n]).alias(n) for n in names])
        for frame in frames
    ]
    return reduce(lambda a, b: a.unionByName(b), cast)
