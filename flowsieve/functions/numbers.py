"""Numeric cleaning expressions: infinity/NaN policies, report-number parsing, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.util import as_col
from flowsieve.schema import INF_SENTINEL

_INF = float("inf")


def inf_to_sentinel(c, sentinel: float = INF_SENTINEL) -> Column:
    """+inf -> +sentinel, -inf -> -sentinel; everything else unchanged."""
    c = as_col(c)
    return (F.when(c == F.lit(_INF), F.lit(sentinel))
            .when(c == F.lit(-_INF), F.lit(-sentinel)).otherwise(c))


def inf_to_zero(c) -> Column:
    """+/-inf, NaN and null all become 0.0."""
    c = as_col(c).cast("double")
    bad = c.isNull() | F.isnan(c) | c.isin(_INF, -_INF)
    return F.when(bad, F.lit(0.0)).otherwise(c)


inf_to_null_zero = inf_to_zero


def clean_number(c) -> Column:
    """Parse a report number: strip '%', en dash -> minus; a single ``d,d`` comma with no
    dot is a decimal comma, any other comma is a thousands separator. Unparseable -> null."""
    s = F.translate(F.trim(as_col(c).cast("string")), "–%", "-")
    s = F.regexp_replace(s, r"^(-?[0-9]+),([0-9]+)$", "$1.$2")
    return F.trim(F.translate(s, ",", "")).try_cast("double")


def split_stem(c) -> Column:
    """File stem split once on '_' or '-' -> array(model, attack?)."""
    return F.split(as_col(c), "[_-]", 2)


def binary_threshold(c, threshold: float = 0.5) -> Column:
    return (as_col(c) > F.lit(threshold)).cast("int")


def flag_contains(c, flag: str = "SYN") -> Column:
    """1 if the flag text contains ``flag`` else 0 (null text counts as empty)."""
    return F.coalesce(F.instr(as_col(c), flag) > 0, F.lit(False)).cast("int")


def error_range_adjust(c, delta: float) -> Column:
    return as_col(c) - F.lit(delta)
