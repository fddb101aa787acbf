"""Numbers, keys and the text form of values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def as_column(c) -> Column:
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def to_double(c) -> Column:
    """Number or null; NaN counts as null."""
    x = F.trim(as_column(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def lenient_number(c, default: float = 0.0) -> Column:
    """Null, blank, 'nan', 'none' and unreadable text give ``default``."""
    return F.coalesce(to_double(c), F.lit(float(default)))


def safe_log1p(c) -> Column:
    x = as_column(c).cast("double")
    return F.when(x > -1, F.log1p(x))


def safe_sqrt(c) -> Column:
    x = as_column(c).cast("double")
    return F.when(x >= 0, F.sqrt(x))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that hold both values; null when a side is constant.

    The built-in aggregate divides by zero there, which is an error under ANSI rules.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def feature_key(c) -> Column:
    """Lower-case key without ``cat__`` / ``num__`` prefixes, blanks, slashes and dots."""
    lowered = F.lower(as_column(c))
    bare = F.replace(F.replace(lowered, F.lit("cat__"), F.lit("")), F.lit("num__"), F.lit(""))
    return F.translate(bare, " /.", "")


def condition_key(c) -> Column:
    """The query side of :func:`feature_key`: prefixes stay."""
    return F.translate(F.lower(as_column(c)), " /.", "")


def alnum_key(c) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(as_column(c), r"[^\p{L}\p{N}]", ""))


def plain_text(c, dtype: T.DataType) -> Column:
    """Value as text; floats as 10000000.0 instead of 1.0E7, NaN as null."""
    x = as_column(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        size = F.abs(x)
        whole = F.concat(x.try_cast("bigint").cast("string"), F.lit(".0"))
        fraction = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"0+\z", "")
        small_int = (size < 1e16) & (x == F.floor(x))
        # -0.0 must keep its sign, which the integer cast would lose
        return (
            F.when(F.isnan(x), F.lit(None).cast("string"))
            .when(small_int & (size > 0), whole)
            .when((size >= 1e-4) & (size < 1e16), fraction)
            .otherwise(x.cast("string"))
        )
    if isinstance(dtype, T.BooleanType):
        return F.initcap(x.cast("string"))
    return x.cast("string")
