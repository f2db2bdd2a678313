"""Score-array expressions built from Spark higher-order functions (JVM side, no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.util import as_col
from flowsieve.schema import VOTE_WEIGHTS


def assemble(cols) -> Column:
    """Columns -> array<double> in the given order."""
    return F.array(*[as_col(c).cast("double") for c in cols])


def pad_to_square(arr, n: int) -> Column:
    """Zero-pad an n-element array to the next perfect square ceil(sqrt(n))**2."""
    side = math.ceil(math.sqrt(n)) if n > 0 else 0
    pad = side * side - n
    a = as_col(arr)
    return F.concat(a, F.array_repeat(F.lit(0.0), pad)) if pad else a


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row: what a lambda mentions of the outside is computed anew
    for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(arr) -> Column:
    """Numerically stable softmax: exp(x - max) / sum(exp(x - max))."""
    def shares(e):
        return _once(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total))

    def exps(a):
        return _once(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return _once(as_col(arr).cast("array<double>"), lambda a: _once(exps(a), shares))


def argmax(arr) -> Column:
    """0-based index of the first maximum (numpy tie rule)."""
    a = as_col(arr)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def topk_scores(arr, k: int = 3) -> Column:
    """The k largest values, descending, padded with 0.0 when the array is shorter."""
    return _once(F.slice(F.sort_array(as_col(arr).cast("array<double>"), asc=False), 1, k),
                 lambda a: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at(a, i), F.lit(0.0))))


def weighted_vote(a, b, weights=VOTE_WEIGHTS) -> Column:
    """Element-wise w_a*a + w_b*b (the combined score vector)."""
    wa, wb = weights
    return F.zip_with(as_col(a).cast("array<double>"), as_col(b).cast("array<double>"),
                      lambda x, y: F.lit(wa) * x + F.lit(wb) * y)


def weighted_vote_class(a, b, weights=VOTE_WEIGHTS, on: str = "logit") -> Column:
    """Class of the weighted sum; ``on='probability'`` softmaxes each side first."""
    if on == "probability":
        a, b = softmax(a), softmax(b)
    return argmax(weighted_vote(a, b, weights))
