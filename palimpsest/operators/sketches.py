"""Tables of sketches: one row per run and group holds what is needed to count distinct things and take quantiles over any set of runs later.

Rows are summed up once, where they lie; afterwards any range of runs is a merge of small states. Distinct things are kept as theta
sketches, which can be intersected and subtracted, and as HLL sketches, which are smaller; numbers as KLL sketches.

Error, one standard deviation: theta 1/sqrt(2**theta_bits), exact up to that many things; HLL about 0.8/sqrt(2**hll_bits); a KLL quantile's rank
is off by about 1.7 % at 99 % confidence with the default k, exact up to k numbers. Null things and numbers are left out. exact() tells
whether a theta sketch still holds all its things; groups where it does not can be counted from their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THETA_BITS, HLL_BITS, KLL_K = 14, 14, 400


def sketched(rows: DataFrame, by: list[str], thing: str, number: str) -> DataFrame:
    """by, rows, and the states theta and hll of `thing` and kll of `number`; combined before anything is exchanged."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.theta_sketch_agg(thing, THETA_BITS).alias("theta"), F.hll_sketch_agg(thing, HLL_BITS).alias("hll"), F.kll_sketch_agg_double(F.col(number).cast("double"), KLL_K).alias("kll")
    )


def combined(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same columns for coarser groups, or (by empty) for all."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.theta_union_agg("theta", THETA_BITS).alias("theta"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def distinct(theta: str | Column) -> Column:
    return F.theta_sketch_estimate(theta)


def exact(theta: str | Column) -> Column:
    """Whether the sketch has left nothing out: one that has says more than it has room for. True of null."""
    return F.coalesce(F.theta_sketch_estimate(theta) <= 2**THETA_BITS, F.lit(True))


def distinct_small(hll: str | Column) -> Column:
    return F.hll_sketch_estimate(hll)


def only(theta: str | Column, other: str | Column) -> Column:
    """How many things are in the first and not in the second."""
    return F.theta_sketch_estimate(F.theta_difference(theta, other))


def both(theta: str | Column, other: str | Column) -> Column:
    return F.theta_sketch_estimate(F.theta_intersection(theta, other))


def quantile(kll: str | Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(kll, F.lit(q))
