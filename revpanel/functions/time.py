"""Time types, step arithmetic and durations. A step is a day, a week, a month or 1."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days (or units) of a step, unit letters and unit names by time type.
STEP = {"day": 1, "week": 7, "yearmonth": 1, "integer": 1}
LETTER = {"day": "d", "week": "w", "yearmonth": "m"}
UNIT = {"day": "day", "week": "week", "yearmonth": "month", "integer": "time step"}
INF = math.inf


class PanelError(ValueError):
    """Arguments or data that break a rule of panels or logs."""


def check_time_type(time_type: str) -> None:
    if time_type not in STEP:
        raise PanelError(f"no step arithmetic for time type {time_type!r}")


def index(t: Column | str, time_type: str) -> Column:
    """Time as an integer number of days, months or units, in which RANGE frames can be ordered."""
    t = F.col(t) if isinstance(t, str) else t
    check_time_type(time_type)
    if time_type in ("day", "week"):
        return F.unix_date(t).cast("long")
    if time_type == "yearmonth":
        return (F.year(t) * 12 + F.month(t)).cast("long")
    return t.cast("long")


def from_index(i: Column, time_type: str) -> Column:
    if time_type in ("day", "week"):
        return F.date_from_unix_date(i.cast("int"))
    if time_type == "yearmonth":
        return F.make_date(F.floor((i - 1) / 12).cast("int"), (F.pmod(i - 1, F.lit(12)) + 1).cast("int"), F.lit(1))
    return i


def plus_steps(t: Column, n: Column | int, time_type: str) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    check_time_type(time_type)
    if time_type in ("day", "week"):
        return F.date_add(t, (n * STEP[time_type]).cast("int"))
    if time_type == "yearmonth":
        return F.add_months(t, n.cast("int"))
    return t + n


def minus_steps(t: Column, n: Column | int, time_type: str) -> Column:
    return plus_steps(t, -n, time_type)


def steps_between(a: Column, b: Column, time_type: str) -> Column:
    """a - b in steps."""
    return ((index(a, time_type) - index(b, time_type)) / STEP[time_type]).cast("long")


def shift(value, n: int, time_type: str):
    """plus_steps for a Python date or integer."""
    check_time_type(time_type)
    if time_type in ("day", "week"):
        return value + dt.timedelta(days=STEP[time_type] * n)
    if time_type == "yearmonth":
        at = value.year * 12 + value.month - 1 + n
        return dt.date(at // 12, at % 12 + 1, 1)
    return value + n


def py_index(value, time_type: str) -> int:
    if time_type in ("day", "week"):
        return (value - dt.date(1970, 1, 1)).days
    if time_type == "yearmonth":
        return value.year * 12 + value.month
    return int(value)


def to_steps(delta, time_type: str) -> int | float:
    """Duration (timedelta, integer steps or inf) as a number of steps; a part of a step is an error."""
    check_time_type(time_type)
    if isinstance(delta, dt.timedelta):
        if time_type not in ("day", "week"):
            raise PanelError(f"time type {time_type!r} takes whole numbers, not durations")
        n = delta / dt.timedelta(days=STEP[time_type])
    else:
        n = delta
    if isinstance(n, float) and math.isinf(n):
        return n
    if isinstance(n, bool) or n != int(n):
        raise PanelError(f"{delta!r} is not a whole number of steps of type {time_type!r}")
    return int(n)


def from_steps(n: int, time_type: str):
    """Steps as a duration: a timedelta for days and weeks, else the number."""
    return dt.timedelta(days=STEP[time_type] * n) if time_type in ("day", "week") else n


def ceiling_steps(delta: dt.timedelta, time_type: str) -> int:
    """Smallest number of steps that lasts about as long or longer; a month counts 30 days."""
    days = {"day": 1, "week": 7, "yearmonth": 30}.get(time_type)
    if days is None:
        raise PanelError(f"no duration of a step of type {time_type!r}")
    return math.ceil(delta / dt.timedelta(days=days))


def approximate_duration(n: int, time_type: str) -> dt.timedelta:
    days = {"day": 1, "week": 7, "yearmonth": 30}.get(time_type)
    if days is None:
        raise PanelError(f"no duration of a step of type {time_type!r}")
    return dt.timedelta(days=days * n)


def unit_letter(time_type: str) -> str:
    if time_type not in LETTER:
        raise PanelError(f"time type {time_type!r} has no unit letter; name the new columns")
    return LETTER[time_type]


def format_steps(n: int, time_type: str) -> str:
    return f"{n} {UNIT[time_type]}{'' if n == 1 else 's'}"


def window_steps(size, time_type: str) -> int | float:
    """A window size as steps: day takes integers or durations, week only durations in weeks, others integers."""
    check_time_type(time_type)
    if isinstance(size, float) and math.isinf(size) and size > 0:
        return INF
    if isinstance(size, dt.timedelta):
        n = to_steps(size, time_type)
    elif time_type == "week":
        raise PanelError("windows over weeks are given as a timedelta of whole weeks")
    elif isinstance(size, int) and not isinstance(size, bool) or isinstance(size, float) and size == int(size):
        n = int(size)
    else:
        raise PanelError(f"window size {size!r} is not a whole number of steps")
    if n < 1:
        raise PanelError("a window has at least one step")
    return n


def before_after(n: int | float, align: str) -> tuple[int | float, int]:
    """Steps before and after the reference time."""
    if n == INF:
        if align != "right":
            raise PanelError("an unbounded window is aligned right")
        return INF, 0
    n = int(n)
    if align == "right":
        return n - 1, 0
    if align == "center":
        return n // 2, n - n // 2 - 1
    if align == "left":
        return 0, n - 1
    raise PanelError(f"align must be right, center or left, not {align!r}")


def guess_period(times: Iterable) -> int:
    """Largest period that divides all gaps between distinct times (days for dates, months for none)."""
    values = sorted(set(times))
    if len(values) < 2:
        raise PanelError("a period needs two distinct times")
    if isinstance(values[0], dt.datetime):
        values = [int(v.timestamp()) for v in values]
    elif isinstance(values[0], dt.date):
        values = [v.toordinal() for v in values]
    return math.gcd(*(int(b - a) for a, b in zip(values, values[1:])))


def full_seq(times: Iterable, period: int) -> list:
    """All times from the first to the last in steps of ``period`` (days for dates); others than these are an error."""
    values = sorted(set(times))
    step = dt.timedelta(days=period) if isinstance(values[0], dt.date) else period
    out = [values[0]]
    while out[-1] < values[-1]:
        out.append(out[-1] + step)
    if not set(values) <= set(out):
        raise PanelError(f"the times are not {period} apart")
    return out
