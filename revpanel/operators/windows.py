"""Rolling and running windows over time.

The reference frame of a window is a dense grid of steps, so a window holds ``size`` slots and a slot without a row is missing.
No grid is built: missing slots matter only through the count of present values, so each result is an aggregate over
a RANGE frame with a guard on that count. Columns of one call share one window.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import INF, STEP, PanelError, before_after, index, py_index, unit_letter, window_steps
from revpanel.meta import check_unique
from revpanel.operators.order import sliding_quantiles
from revpanel.operators.scan import running
from revpanel.operators.trace import Untraceable, traced
from revpanel.panel import Panel

#: Name stems; those of logical columns differ.
STEMS = {"mean": "av", "sum": "sum", "prod": "prod", "min": "min", "max": "max", "all": "all", "any": "any", "median": "slide"}
#: Slots of a window from which on a median is kept sorted; below, each window is sorted by itself within Spark's codegen.
WIDE = 64
LOGICAL_STEMS = {"mean": "prop", "sum": "count"}
_ALIGN = {"right": "", "center": "c", "left": "l"}


def _check_groups(panel: Panel) -> None:
    if panel.groups and set(panel.groups) != set(panel.meta.series):
        raise PanelError(f"slides need an ungrouped panel or one grouped by {panel.meta.series}")


def _ref_times(panel: Panel, ref_times: Sequence | None, check: bool) -> list | None:
    if ref_times is None:
        return None
    times = list(ref_times)
    if len(set(times)) != len(times):
        raise PanelError("reference times repeat")
    if check:
        have = {r[0] for r in panel.df.where(F.col("time_value").isin(times)).select("time_value").distinct().collect()}
        if strange := set(times) - have:
            raise PanelError(f"reference times that do not occur: {sorted(strange)}")
    return times


def _frame(panel: Panel, size, align: str, split: int | None = None) -> tuple[WindowSpec, Column | int, int | float, tuple]:
    """The window, its number of slots, its size in steps, and the (before, after)."""
    tt = panel.meta.time_type
    n = window_steps(size, tt)
    before, after = before_after(n, align)
    base = Window.partitionBy(*panel.meta.series, *(["__c"] if split else [])).orderBy("__t")
    if split is not None and split < 1:
        raise PanelError("a series is split into chunks of at least one step")
    if n == INF:
        # The running window starts at the first time of the whole panel.
        first = panel.df.agg(F.min(index("time_value", tt))).first()[0] or 0
        slots = ((F.col("__t") - first) / STEP[tt] + 1).cast("long")
        return base.rangeBetween(Window.unboundedPreceding, 0), slots, n, (before, after)
    return base.rangeBetween(-int(before) * STEP[tt], int(after) * STEP[tt]), F.lit(n), n, (before, after)


def guarded(f: str, c: Column, w: WindowSpec, slots: Column, logical: bool, skip_nulls: bool) -> Column:
    """One rolling function: missing slots poison the result unless ``skip_nulls``."""
    x = c.cast("int") if logical and f in ("mean", "sum", "prod", "min", "max", "median") else c
    k = F.count(x).over(w)
    if f in ("all", "any"):
        b = c.cast("boolean")
        got = (F.bool_and(b) if f == "all" else F.bool_or(b)).over(w)
        empty = F.lit(f == "all")
        if skip_nulls:
            return F.coalesce(got, empty)
        decided = ~got if f == "all" else got
        return F.when(decided, F.lit(f == "any")).when(k == slots, empty)
    got = {"mean": F.avg, "sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "median": lambda v: F.percentile(v, F.lit(0.5))}[f](x).over(w)
    if not skip_nulls:
        return F.when(k == slots, got)
    nothing = {"mean": float("nan"), "sum": 0, "prod": 1.0, "min": float("inf"), "max": float("-inf"), "median": None}[f]
    if nothing is None:
        return got
    return F.coalesce(got.cast("double") if f in ("min", "max", "mean", "prod") else got, F.lit(nothing))


def _running_split(df: DataFrame, panel: Panel, f: str, columns: Sequence[str], names: Sequence[str], slots: Column, logical: dict[str, bool], skip_nulls: bool, split: int) -> DataFrame:
    """Running functions of a series cut into chunks of ``split`` steps: states of chunks before it and rows of its own, as in ``guarded``."""
    if f == "median":
        raise PanelError("a running median has no state that merges; it is not split")
    states = {}
    for i, c in enumerate(columns):
        x = F.col(c).cast("int") if logical[c] and f not in ("all", "any") else F.col(c)
        states[f"__k{i}"] = ("count", x)
        kind = {"mean": "sum", "sum": "sum", "prod": "product", "min": "min", "max": "max"}.get(f, f)
        states[f"__x{i}"] = (kind, F.col(c).cast("boolean") if f in ("all", "any") else x)
    step = STEP[panel.meta.time_type]
    out = running(df, panel.meta.series, ["__t"], F.floor(F.col("__t") / (split * step)), states)
    made = []
    for i, (c, name) in enumerate(zip(columns, names)):
        k, got = F.col(f"__k{i}"), F.col(f"__x{i}")
        if f in ("all", "any"):
            empty = F.lit(f == "all")
            decided = ~got if f == "all" else got
            value = F.coalesce(got, empty) if skip_nulls else F.when(decided, F.lit(f == "any")).when(k == slots, empty)
        else:
            value = got / F.when(k > 0, k) if f == "mean" else got
            if not skip_nulls:
                value = F.when(k == slots, value)
            else:
                nothing = {"mean": float("nan"), "sum": 0, "prod": 1.0, "min": float("inf"), "max": float("-inf")}[f]
                value = F.coalesce(value.cast("double") if f in ("min", "max", "mean", "prod") else value, F.lit(nothing))
        made.append(value.alias(name))
    return out.select(*df.columns, *made)


def _order_statistics(df: DataFrame, panel: Panel, columns: Sequence[str], names: Sequence[str], n: int, before: int, after: int, logical: dict[str, bool], skip_nulls: bool, split: int | None) -> DataFrame:
    """Rolling medians of wide windows, by a sorted list that rows enter and leave, in chunks of a series."""
    tt, series = panel.meta.time_type, panel.meta.series
    wanted = {f"__m{i}": (F.col(c).cast("int") if logical[c] else F.col(c)).cast("double") for i, c in enumerate(columns)}
    out = sliding_quantiles(df.withColumns(wanted), series, "__t", list(wanted), [0.5], int(before) * STEP[tt], int(after) * STEP[tt], (split or 0) * STEP[tt])
    made = []
    for i, name in enumerate(names):
        value = F.col(f"__m{i}_q")[0]
        made.append((value if skip_nulls else F.when(F.col(f"__m{i}_n") == n, value)).alias(name))
    return out.select(*df.columns, *made)


def default_names(panel: Panel, columns: Sequence[str], f: str, n: int | float, align: str, prefix: str | None = None, suffix: str | None = None) -> list[str]:
    """prefix + column + suffix, in which {n}, {unit}, {align} and {f} stand for the parts of the default suffix."""
    if prefix is None and suffix is None:
        suffix = "_{n}{unit}{align}{f}"
    out = []
    for c in columns:
        logical = isinstance(panel.df.schema[c].dataType, T.BooleanType)
        stem = LOGICAL_STEMS.get(f, STEMS.get(f, "slide")) if logical else STEMS.get(f, "slide")
        if n == INF:
            parts = {"n": "running_", "unit": "", "align": "", "f": stem}
        else:
            template = (prefix or "") + (suffix or "")
            unit = unit_letter(panel.meta.time_type) if "{unit}" in template else ""
            parts = {"n": n, "unit": unit, "align": _ALIGN[align], "f": stem}
        out.append((prefix or "").format(**parts) + c + (suffix or "").format(**parts))
    return out


def _finish(panel: Panel, df: DataFrame, new: list[str], times: list | None, all_rows: bool) -> Panel:
    if "__own" in df.columns:
        df = df.where("__own").drop("__own", "__c")
    df = df.drop("__t")
    if times is not None:
        at = F.col("time_value").isin(times)
        df = df.withColumns({c: F.when(at, F.col(c)) for c in new}) if all_rows else df.where(at)
    out = Panel(df, panel.meta, panel.groups)
    return out.canonical_columns()


def _near(panel: Panel, times: list | None, before, after, all_rows: bool, split: int | None = None) -> DataFrame:
    """Rows that a result can need: filters on time do not pass through a window by themselves.

    With ``split`` a row goes to every chunk of that many steps whose reference times can see it, so that one long
    series is worked on by many tasks; _finish keeps the row of its own chunk.
    """
    tt = panel.meta.time_type
    df = panel.df.withColumn("__t", index("time_value", tt))
    if times and not all_rows and before != INF:
        at = [py_index(t, tt) for t in times]
        df = df.where(F.col("__t").between(min(at) - int(before) * STEP[tt], max(at) + int(after) * STEP[tt]))
    if split:
        length = split * STEP[tt]
        chunk = lambda t: F.floor(t / length)
        first, last = chunk(F.col("__t") - int(after) * STEP[tt]), chunk(F.col("__t") + int(before) * STEP[tt])
        df = df.withColumn("__c", F.explode(F.sequence(first, last))).withColumn("__own", chunk(F.col("__t")) == F.col("__c"))
    return df


def roll(panel: Panel, columns: str | Sequence[str], f: str = "mean", size=None, align: str = "right", skip_nulls: bool = False, prefix: str | None = None, suffix: str | None = None, new_names: Sequence[str] | None = None, ref_times: Sequence | None = None, all_rows: bool = False, validate: bool = True, split: int | None = None) -> Panel:
    """Rolling (or, with size=inf, running) mean, sum, prod, min, max, all, any or median of columns.

    ``split`` deals each series out in chunks of that many steps, for few and very long series: overlapping ones for a rolling
    window, while a running one adds the states of the chunks before to the rows of its own (not for a median). A median
    over more than WIDE slots keeps a sorted list of the window instead of sorting each window anew.
    """
    if f not in STEMS:
        raise PanelError(f"no rolling function {f!r}; use slide() or slide_python()")
    if size is None:
        raise PanelError("a window size is needed")
    _check_groups(panel)
    columns = [columns] if isinstance(columns, str) else list(columns)
    missing = [c for c in columns if c not in panel.df.columns]
    if missing:
        raise PanelError(f"no such columns: {missing}")
    if validate:
        if panel.df.limit(1).isEmpty():
            raise PanelError("rolling windows need at least one row")
        check_unique(panel.df, panel.meta.keys)
    times = _ref_times(panel, ref_times, validate)
    w, slots, n, (before, after) = _frame(panel, size, align, split)
    if new_names is not None and (prefix is not None or suffix is not None):
        raise PanelError("give either new_names or prefix and suffix")
    names = list(new_names) if new_names is not None else default_names(panel, columns, f, n, align, prefix, suffix)
    if len(names) != len(columns):
        raise PanelError("one new name is needed for each column")
    if clash := set(names) & set(panel.df.columns):
        raise PanelError(f"new columns exist already: {sorted(clash)}")
    if len(set(names)) != len(names):
        raise PanelError("new column names repeat")
    logical = {c: isinstance(panel.df.schema[c].dataType, T.BooleanType) for c in columns}
    if split and n == INF:
        df = _running_split(_near(panel, times, before, after, all_rows), panel, f, columns, names, slots, logical, skip_nulls, split)
        return _finish(panel, df, names, times, all_rows)
    if f == "median" and WIDE < n < INF:
        df = _order_statistics(_near(panel, times, before, after, all_rows), panel, columns, names, int(n), before, after, logical, skip_nulls, split)
        return _finish(panel, df, names, times, all_rows)
    df = _near(panel, times, before, after, all_rows, split)
    df = df.select("*", *[guarded(f, F.col(c), w, slots, logical[c], skip_nulls).alias(name) for c, name in zip(columns, names)])
    return _finish(panel, df, names, times, all_rows)


def as_expressions(exprs: dict[str, Column | str | None]) -> dict[str, Column | None]:
    """Named aggregates, given as columns or in SQL."""
    return {k: F.expr(v) if isinstance(v, str) else v for k, v in exprs.items()}


def slide(panel: Panel, exprs: dict[str, Column | str | None], size=None, align: str = "right", ref_times: Sequence | None = None, all_rows: bool = False, pack_as: str | None = None, split: int | None = None) -> Panel:
    """Named aggregate expressions, columns or SQL, over each window (nulls skipped); None deletes an earlier output.

    With ``pack_as`` the outputs are one struct column. An empty panel is returned as it is, with null columns.
    """
    if size is None:
        raise PanelError("a window size is needed")
    _check_groups(panel)
    times = _ref_times(panel, ref_times, True)
    w, _, n, (before, after) = _frame(panel, size, align, split)
    if split and n == INF:
        raise PanelError("only the running functions of roll() merge over chunks; an aggregate over all of a series is not split")
    kept = {k: v for k, v in as_expressions(exprs).items() if v is not None}
    if not kept:
        raise PanelError("no new column is made")
    if clash := set([pack_as] if pack_as else kept) & set(panel.df.columns):
        raise PanelError(f"new columns exist already: {sorted(clash)}")
    df = _near(panel, times, before, after, all_rows, split).select("*", *[v.over(w).alias(k) for k, v in kept.items()])
    new = list(kept)
    if pack_as:
        df = df.withColumn(pack_as, F.struct(*new)).drop(*new)
        new = [pack_as]
    return _finish(panel, df, new, times, all_rows)


def check_arity(f: Callable, n: int, what: str) -> None:
    """``f`` must take ``n`` positional arguments."""
    try:
        params = list(inspect.signature(f).parameters.values())
    except (TypeError, ValueError):
        return
    if any(p.kind is p.VAR_POSITIONAL for p in params):
        return
    if sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in params) < n:
        raise PanelError(f"{what} must take {n} positional arguments")


class _Symbol:
    """Stands for the key and the time of a window: a function that looks at it runs in Python."""

    def _stops(self, *_, **__):
        raise Untraceable

    __getattr__ = __getitem__ = __iter__ = __len__ = __bool__ = __eq__ = __lt__ = __gt__ = __le__ = __ge__ = __add__ = __sub__ = __hash__ = __float__ = __int__ = __str__ = _stops


def slide_function(panel: Panel, f: Callable, schema: str, size=None, align: str = "right", new_name: str = "slide_value", ref_times: Sequence | None = None, all_rows: bool = False, **more) -> Panel:
    """slide_python(), without Python where the function can be traced: f(window, key, ref_time) of columns, aggregates and numpy functions.

    ``lambda w, k, t: np.log(w.cases.sum() / w.deaths.sum())`` is planned as two sums over one window. A function that looks at the
    key, the time, a length or a single value is run by slide_python.
    """
    check_arity(f, 3, "the window function")
    if size is None:
        raise PanelError("a window size is needed")
    _check_groups(panel)
    w, _, _, (before, after) = _frame(panel, size, align)
    exprs = None if more else traced(f, panel.df, schema, new_name, lambda a: a.over(w), _Symbol(), _Symbol())
    if exprs is None:
        return slide_python(panel, f, schema, size, align, new_name, ref_times, all_rows, **more)
    if clash := set(exprs) & set(panel.df.columns):
        raise PanelError(f"new columns exist already: {sorted(clash)}")
    times = _ref_times(panel, ref_times, True)
    df = _near(panel, times, before, after, all_rows).select("*", *[v.alias(k) for k, v in exprs.items()])
    return _finish(panel, df, list(exprs), times, all_rows)


def slide_python(panel: Panel, f: Callable, schema: str, size=None, align: str = "right", new_name: str = "slide_value", ref_times: Sequence | None = None, all_rows: bool = False, **more) -> Panel:
    """f(window, key, ref_time, **more) -> a scalar, or a dict for a struct ``schema``, for each reference time.

    ``window`` is a pandas frame with the key columns and one row per slot: slots without a row hold nulls. A scalar
    becomes the column ``new_name``; the fields of a struct become columns, or one packed column if new_name is given.
    Each series is one Arrow group.
    """
    check_arity(f, 3, "the window function")
    if size is None:
        raise PanelError("a window size is needed")
    _check_groups(panel)
    times = _ref_times(panel, ref_times, True)
    tt, step = panel.meta.time_type, STEP[panel.meta.time_type]
    n = window_steps(size, tt)
    before, after = before_after(n, align)
    first = (panel.df.agg(F.min(index("time_value", tt))).first()[0] or 0) if n == INF else None
    kind = T._parse_datatype_string(schema)
    packed = isinstance(kind, T.StructType)
    value = kind if packed else T.StructType([T.StructField(new_name, kind)])
    if clash := {x.name for x in value.fields} & set(panel.df.columns):
        raise PanelError(f"new columns exist already: {sorted(clash)}")
    columns, keys = panel.df.columns, panel.meta.series
    wanted = None if times is None else {py_index(t, tt) for t in times}
    df = _near(panel, times, before, after, all_rows)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t").reset_index(drop=True)
        t = pdf["__t"].to_numpy()
        lo = first if before == INF else t[0] - int(before) * step
        grid = np.arange(lo, t[-1] + int(after) * step + 1, step)
        # A weekly grid is anchored at the rows themselves.
        at = np.searchsorted(grid, t)
        dense = pdf[columns].set_axis(at).reindex(range(len(grid)))
        for k, v in zip(keys, key):
            dense[k] = v
        out = []
        for i, (x, pos) in enumerate(zip(t, at)):
            if wanted is not None and int(x) not in wanted:
                out.append({x.name: None for x in value.fields})
                continue
            start = 0 if before == INF else pos - int(before)
            got = f(dense.iloc[start : pos + int(after) + 1], key, pdf["time_value"].iloc[i], **more)
            out.append(dict(got) if packed else {new_name: got})
        return pd.concat([pdf, pd.DataFrame(out, columns=[x.name for x in value.fields])], axis=1)

    result = df.groupBy(*keys).applyInPandas(run, T.StructType([*df.schema.fields, *value.fields]))
    return _finish(panel, result, [x.name for x in value.fields], times, all_rows)
