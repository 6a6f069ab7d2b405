"""Column helpers for windowed statistics and alert text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value.cast("double")))


def latest_if(cond: Column, value: Column, ts: Column) -> Column:
    """The non-null value with the largest ts. Both buffers are primitives, which
    keeps the surrounding aggregate hash-based."""
    return F.max_by(value.cast("double"), F.when(cond & value.isNotNull(), ts))


def slope_if(cond: Column, y: Column, x: Column) -> Column:
    return F.regr_slope(F.when(cond, y.cast("double")), x)


def slope_and_corr_if(cond: Column, y: Column, x: Column) -> tuple[Column, Column]:
    """Regression slope and Pearson correlation from the same three moments.

    The correlation is null when either side is constant; the built-in corr
    raises a division error there while ANSI mode is on.
    """
    y = F.when(cond, y.cast("double"))
    x = F.when(y.isNotNull(), x)
    together, var_x, var_y = F.covar_pop(y, x), F.var_pop(x), F.var_pop(y)
    return F.try_divide(together, var_x), F.try_divide(together, F.sqrt(var_x) * F.sqrt(var_y))


def _fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even. A negative value that
    rounds to zero keeps its sign, as in C and Python formatting. Null stays null
    (the formatter would cut the word "null" to that many letters)."""
    rounded = F.bround(value, digits)
    text = F.when(value.isNotNull(), F.format_string(f"%.{digits}f", rounded))
    return F.when((value < 0) & (rounded == 0), F.concat(F.lit("-"), text)).otherwise(text)


def whole(value: Column) -> Column:
    return _fixed(value, 0)


def tenth(value: Column) -> Column:
    return _fixed(value, 1)


def hundredth(value: Column) -> Column:
    return _fixed(value, 2)


def severity_rank(severity: Column) -> Column:
    """Sort position of a severity: P1 first, unknown last."""
    return (F.when(severity == "P1", 0).when(severity == "P2", 1)
            .when(severity == "P3", 2).otherwise(9))
