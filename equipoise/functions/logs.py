"""Logarithms of factorials, and signed log-sum-exp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of walks go no further.
MOST = 2000


def lnfact(k: Column) -> Column:
    """ln k! for integers 0 <= k <= MOST, from one folded table."""
    table = F.split(F.lit(",".join(repr(math.lgamma(i + 1)) for i in range(MOST + 1))), ",").cast("array<double>")
    return F.element_at(table, k + 1)


def log_sum_exp(logs: Column, signs: Column) -> Column:
    """Signed log-sum-exp of two parallel arrays: struct(la, sg); (-inf, 0) for an empty or cancelling sum."""
    top = F.array_max(F.filter(logs, lambda x: x > float("-inf")))
    total = F.aggregate(F.zip_with(logs, signs, lambda l, s: F.coalesce(s * F.exp(l - top), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.when(total == 0, F.lit(float("-inf"))).otherwise(F.coalesce(top + F.log(F.abs(total)), F.lit(float("-inf")))).alias("la"), F.coalesce(F.signum(total), F.lit(0.0)).alias("sg"))
