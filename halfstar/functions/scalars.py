"""Column functions. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATING_SCALE = (0.5, 5.0)


def parse_num_cores(cores: Column) -> Column:
    """Cores in a ``local[n]`` master; 1 without one, NULL for ``local[*]``."""
    inside = F.regexp_extract(cores, r"local\[([^\]]*)\]", 1)
    return F.when(cores.contains("local["), inside.try_cast("int")).otherwise(F.lit(1))


def model_label(model: Column, num_cores: Column) -> Column:
    """``SVD``, or ``ALS-4c`` for ALS on four cores."""
    return F.when(model == "SVD", "SVD").otherwise(F.concat(F.lit("ALS-"), num_cores.cast("string"), F.lit("c")))


def metric_label(metric: Column) -> Column:
    return F.replace(metric, F.lit("_"), F.lit("@"))


def metric_default(metric: Column) -> Column:
    return F.coalesce(metric.cast("double"), F.lit(0.0))


def clip_rating(value: Column, low: float = RATING_SCALE[0], high: float = RATING_SCALE[1]) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL on a zero denominator, also in ANSI mode."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent_of_total(part: Column, total: Column, digits: int = 1) -> Column:
    return F.round(ratio(part * F.lit(100.0), total), digits)


def log_discount(pos: Column) -> Column:
    """DCG discount of a 1-based position."""
    return F.lit(1.0) / F.log2(pos + F.lit(1))


def popularity_weight(count: Column) -> Column:
    return F.log1p(count)


def error_propagation(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def fixed(value: Column, digits: int = 4) -> Column:
    """Fixed-decimals text, rounded half up first so that the text does not depend on the formatter."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))


def format_metric_line(label: str, value: Column, spread: Column | None = None, unit: str = "") -> Column:
    """``label: value ± spread unit``; a missing spread prints as zero."""
    parts = [F.lit(f"{label}: "), fixed(value)]
    if spread is not None:
        parts += [F.lit(" ± "), fixed(F.coalesce(spread, F.lit(0.0)))]
    return F.concat(*parts, F.lit(unit))


def linear_verdict(max_speedup: Column, max_cores: Column) -> Column:
    return F.when(max_speedup < max_cores * F.lit(0.8), "No").otherwise("Partial")


def degradation_verdict(min_efficiency: Column) -> Column:
    return F.when(min_efficiency < F.lit(0.5), "Yes").otherwise("Minimal")


def accuracy_winner(svd_rmse: Column, als_rmse: Column) -> Column:
    """A missing error counts as infinite."""
    worst = F.lit(float("inf"))
    return F.when(F.coalesce(svd_rmse, worst) < F.coalesce(als_rmse, worst), "SVD").otherwise("Spark ALS")
