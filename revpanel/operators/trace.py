"""Computations written for pandas, traced into Spark expressions.

A function of a window is called once with a symbolic frame. What it does with it, arithmetic on columns, aggregates, numpy
functions, is written down as an expression, which Catalyst then plans like any other. A function that asks for what has no
expression (a length, a branch on a value, another library) stops the trace and is run in Python instead; the results are the same.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Untraceable(Exception):
    """The function does something that has no expression."""


_INF, _NAN = float("inf"), float("nan")


def _divide(a: Column, b: Column) -> Column:
    """As floating-point numbers are divided, by zero too."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF)).when(a.isNotNull(), F.lit(_NAN))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, zero)


_UFUNCS: dict[Any, Callable[..., Column]] = {
    np.log: lambda x: F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)), np.log1p: lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-_INF)).when(x < -1, F.lit(_NAN)),
    np.exp: F.exp, np.expm1: F.expm1, np.sqrt: lambda x: F.when(x >= 0, F.sqrt(x)).when(x < 0, F.lit(_NAN)), np.abs: F.abs, np.floor: lambda x: F.floor(x).cast("double"), np.ceil: lambda x: F.ceil(x).cast("double"), np.sign: F.signum,
    np.square: lambda x: x * x, np.negative: lambda x: -x, np.add: lambda a, b: a + b, np.subtract: lambda a, b: a - b, np.multiply: lambda a, b: a * b, np.true_divide: _divide,
    np.maximum: lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), np.minimum: lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
}


def _stops(*_: Any, **__: Any) -> Any:
    raise Untraceable


class _Value:
    """A symbolic value: numbers of the rows of a window, or with ``aggregated`` one number of it."""

    def __init__(self, column: Column, aggregated: bool, over: Callable[[Column], Column]):
        self.column, self.aggregated, self.over = column, aggregated, over

    def _with(self, f: Callable[..., Column], *others: Any) -> _Value:
        columns, aggregated = [self.column], self.aggregated
        for o in others:
            if isinstance(o, _Value):
                if o.aggregated != aggregated:
                    # A row beside an aggregate would need a window within the window.
                    raise Untraceable
                columns.append(o.column)
            elif isinstance(o, (bool, int, float, np.number)):
                columns.append(F.lit(o.item() if isinstance(o, np.generic) else o))
            else:
                raise Untraceable
        return _Value(f(*columns), aggregated, self.over)

    def __array_ufunc__(self, ufunc: Any, method: str, *inputs: Any, **kw: Any) -> _Value:
        if method != "__call__" or kw or ufunc not in _UFUNCS:
            raise Untraceable
        first = inputs[0] if isinstance(inputs[0], _Value) else next(x for x in inputs if isinstance(x, _Value))
        given = [x if isinstance(x, _Value) else _Value(F.lit(x.item() if isinstance(x, np.generic) else x), first.aggregated, first.over) for x in inputs]
        return given[0]._with(_UFUNCS[ufunc], *given[1:])

    def __add__(self, o: Any) -> _Value:
        return self._with(lambda a, b: a + b, o)

    def __sub__(self, o: Any) -> _Value:
        return self._with(lambda a, b: a - b, o)

    def __rsub__(self, o: Any) -> _Value:
        return self._with(lambda a, b: b - a, o)

    def __mul__(self, o: Any) -> _Value:
        return self._with(lambda a, b: a * b, o)

    def __truediv__(self, o: Any) -> _Value:
        return self._with(_divide, o)

    def __rtruediv__(self, o: Any) -> _Value:
        return self._with(lambda a, b: _divide(b, a), o)

    def __neg__(self) -> _Value:
        return self._with(lambda a: -a)

    def __abs__(self) -> _Value:
        return self._with(F.abs)

    __radd__, __rmul__ = __add__, __mul__
    __bool__ = __len__ = __iter__ = __float__ = __int__ = __index__ = __array__ = __getattr__ = __getitem__ = _stops

    def _compared(self, op: Callable[[Column, Column], Column], o: Any) -> _Value:
        found = _Value(self.column, self.aggregated, self.over)._with(lambda a, b: F.coalesce(op(a, b), F.lit(False)).cast("int"), o)
        return found if self.aggregated else _Flags(found.column, False, self.over)

    def __gt__(self, o: Any) -> _Value:
        return self._compared(operator.gt, o)

    def __ge__(self, o: Any) -> _Value:
        return self._compared(operator.ge, o)

    def __lt__(self, o: Any) -> _Value:
        return self._compared(operator.lt, o)

    def __le__(self, o: Any) -> _Value:
        return self._compared(operator.le, o)

    __hash__ = None


class _Flags(_Value):
    """Whether rows of the window meet a condition. A missing slot does not, so shares of slots have no expression; numbers have."""

    def sum(self) -> _Value:
        return _Value(F.coalesce(self.over(F.sum(self.column)), F.lit(0)), True, self.over)

    def any(self) -> _Value:
        return _Value(F.coalesce(self.over(F.max(self.column)), F.lit(0)).cast("boolean"), True, self.over)

    _with = _stops


class _Rows(_Value):
    """A column of the window, with the aggregates of a pandas series; missing values are left out."""

    def __init__(self, column: Column, over: Callable[[Column], Column]):
        super().__init__(column, False, over)

    def _with(self, f: Callable[..., Column], *others: Any) -> _Value:
        return _Rows(super()._with(f, *others).column, self.over)

    def _made(self, aggregate: Column) -> _Value:
        return _Value(self.over(aggregate), True, self.over)

    def _numbers(self) -> Column:
        return self.column.cast("double")

    def sum(self) -> _Value:
        return _Value(F.coalesce(self.over(F.sum(self.column)), F.lit(0)), True, self.over)

    def mean(self) -> _Value:
        return self._made(F.avg(self._numbers()))

    def min(self) -> _Value:
        return self._made(F.min(self.column))

    def max(self) -> _Value:
        return self._made(F.max(self.column))

    def count(self) -> _Value:
        return self._made(F.count(self.column))

    def std(self) -> _Value:
        return self._made(F.stddev_samp(self._numbers()))

    def var(self) -> _Value:
        return self._made(F.var_samp(self._numbers()))

    def median(self) -> _Value:
        return self._made(F.percentile(self._numbers(), F.lit(0.5)))

    def quantile(self, q: float = 0.5) -> _Value:
        if not isinstance(q, (int, float)):
            raise Untraceable
        return self._made(F.percentile(self._numbers(), F.lit(float(q))))


class _Frame:
    """The window: its columns by name."""

    def __init__(self, schema: T.StructType, over: Callable[[Column], Column]):
        self._schema, self._over = schema, over

    def __getitem__(self, name: Any) -> _Rows:
        if not isinstance(name, str) or name not in self._schema.names:
            raise Untraceable
        kind = self._schema[name].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType)) or isinstance(kind, T.DecimalType):
            raise Untraceable
        x = F.col(f"`{name}`")
        return _Rows(F.nanvl(x, F.lit(None)) if isinstance(kind, (T.DoubleType, T.FloatType)) else x.cast("double") if isinstance(kind, T.BooleanType) else x, self._over)

    def __getattr__(self, name: str) -> _Rows:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    __len__ = __iter__ = __bool__ = _stops


def _result(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, _Value):
        if not value.aggregated:
            raise Untraceable
        c = value.column
        # Missing and NaN are one in what comes back from Python.
        number = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        return number.cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.cast(kind)
    if value is None or isinstance(value, (bool, int, float, str, dt.date, Decimal)):
        return F.lit(value).cast(kind)
    raise Untraceable


def traced(f: Callable, df: DataFrame, schema: str, new_name: str, over: Callable[[Column], Column], *more: Any) -> dict[str, Column] | None:
    """The columns {name: Column} that ``f(window, *more)`` stands for, or None where it has to run in Python.

    ``schema`` is that of the result: one type, or the fields of a dict. ``over`` puts an aggregate over the window.
    """
    kind = T._parse_datatype_string(schema)
    try:
        got = f(_Frame(df.schema, over), *more)
        if isinstance(kind, T.StructType):
            if not isinstance(got, dict) or set(got) != set(kind.names):
                return None
            return {x.name: _result(got[x.name], x.dataType) for x in kind.fields}
        return {new_name: _result(got, kind)}
    except Exception:
        # Whatever stops the function on symbols does not say that it fails on data.
        return None
