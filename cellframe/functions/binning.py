"""Right-closed bins ``(a, b]``: the lowest edge and anything outside give NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Break points of the three terrain summaries (the elevation sequence by 200
# towards 3700 ends at 3600).
ELEVATION_BREAKS = [2600.0, 2800.0, 3000.0, 3200.0, 3400.0, 3600.0]
SLOPE_BREAKS = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
COS_ASPECT_BREAKS = [-1.0, -0.5, 0.0, 0.5, 1.0]


def _edges_below(v: Column, breaks: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [(v > b).cast("int") for b in breaks])


def bin_index(v: Column, breaks: Sequence[float | Column]) -> Column:
    """1-based bin number against a short ascending list of breaks.

    A sum of comparisons, so it compiles into the generated loop; no division is involved
    and the edges are exact."""
    edges = [b if isinstance(b, Column) else F.lit(float(b)) for b in breaks]
    n = _edges_below(v, edges)
    return F.when((n > 0) & (n < len(edges)), n)


# ``get`` below, not ``element_at``: with ANSI mode on, the latter (Spark 4.1) takes an array
# of non-NULL elements to give a non-NULL result and returns the last one for a NULL index.


def _text(b: float) -> str:
    return f"{b:.10g}"


def bin_label(v: Column, breaks: Sequence[float]) -> Column:
    """Label such as ``(2600,2800]`` of the bin that holds ``v``."""
    index = bin_index(v, breaks)
    labels = [f"({_text(a)},{_text(b)}]" for a, b in zip(breaks, breaks[1:])]
    return F.get(F.array(*[F.lit(s) for s in labels]), index - 1)


def bin_lower(v: Column, breaks: Sequence[float | Column]) -> Column:
    """Lower edge of the bin that holds ``v``."""
    edges = [b if isinstance(b, Column) else F.lit(float(b)) for b in breaks]
    return F.get(F.array(*edges), bin_index(v, edges) - 1)


def equal_breaks(lo: Column, hi: Column, n: int) -> list[Column]:
    """``n`` equally spaced breaks from lo to hi; the last one is hi itself."""
    step = (hi - lo) / F.lit(float(n - 1))
    return [lo] + [lo + F.lit(float(i)) * step for i in range(1, n - 1)] + [hi]


def step_index(v: Column, lo: Column, hi: Column, step: float) -> Column:
    """1-based right-closed bin against the breaks ``lo, lo+step, ...`` up to ``hi``.

    For long break sequences: constant work per value, with the rounding of the division
    checked against the breaks themselves."""
    s = F.lit(float(step))
    guess = F.ceil((v - lo) / s)
    k = (
        F.when(v > lo + guess * s, guess + 1)
        .when(v <= lo + (guess - 1) * s, guess - 1)
        .otherwise(guess)
    )
    last = F.floor((hi - lo) / s + F.lit(1e-10))
    return F.when((k >= 1) & (k <= last), k)
