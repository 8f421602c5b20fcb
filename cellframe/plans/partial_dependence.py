"""Partial-dependence surfaces and prevalence tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.algebra import variation
from cellframe.functions.binning import bin_lower, equal_breaks
from cellframe.operators.forest_table import Cuts, bin_vectors, forest_trees, grid_sums, replicate_vectors
from cellframe.operators.stack import union_all
from cellframe.operators.tables import grouped_count, with_sqrt_share

# Grid points per variable, bins per axis of the prevalence tables.
GRID_POINTS = 5
PREVALENCE_BREAKS = 10
#: Vectors of bins that a task walks the trees with at a time.
WALK_ROWS = 200_000

# The variables of each surface.
SURFACES = {
    "damage_survey": ["diploid_fraction", "elevation", "trait_cwc"],
    "damage_lidar": ["diploid_fraction", "elevation", "trait_cwc"],
    "damage_survey_clipped": ["diploid_fraction", "elevation", "trait_cwc"],
    "diploid_fraction": ["elevation", "cos_aspect"],
    "trait_cwc": ["diploid_fraction", "cos_aspect", "height"],
    "trait_d13c": ["diploid_fraction", "cos_aspect", "height"],
    "trait_n": ["diploid_fraction", "cos_aspect", "height"],
}


def _grid_value(limits: Column, var: str, i: Column, points: int) -> Column:
    lo, hi = limits.getField(var).getField("lo"), limits.getField(var).getField("hi")
    return F.when(i == points - 1, hi).otherwise(lo + i * (hi - lo) / F.lit(float(points - 1)))


def _limits(rows: DataFrame, variables: Sequence[str]) -> Column:
    return rows.agg(
        F.struct(
            *[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v) for v in variables]
        ).alias("l")
    ).scalar()


def with_grid(rows: DataFrame, variables: Sequence[str], points: int = GRID_POINTS, train: DataFrame | None = None) -> DataFrame:
    """Every row once per grid point, its own values of ``variables`` replaced.

    ``points`` equally spaced values span each variable's range in ``train`` (the rows themselves). The number of
    grid points is fixed, so this is linear in the rows; it is generated row by row right
    in front of the model and aggregated right behind it."""
    df = rows.withColumn("_l", _limits(rows if train is None else train, variables))
    for v in variables:
        df = df.withColumn(f"i_{v}", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return df.withColumns({v: _grid_value(F.col("_l"), v, F.col(f"i_{v}"), points) for v in variables}).drop("_l")


def _scored(model: Model, xvars: Sequence[str], train: DataFrame, variables: Sequence[str], points: int, cuts: Cuts | None) -> DataFrame:
    """(i_<var>..., <var>..., prediction, _k): predictions at every grid point, for every row or every vector of bins."""
    train = train.select(*dict.fromkeys([*xvars, *variables]))
    rows = train.withColumn("_k", F.lit(1)) if cuts is None else bin_vectors(train, [x for x in xvars if x not in variables], cuts)
    df = with_grid(rows, variables, points, train)
    scored = model.transform(VectorAssembler(inputCols=list(xvars), outputCol="features").transform(df))
    return scored.select(*[f"i_{v}" for v in variables], *variables, "prediction", "_k")


def _surface(scored: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    mean = F.sum(F.col("prediction") * F.col("_k")) / F.sum("_k")
    return scored.groupBy(*by, *[f"i_{v}" for v in variables]).agg(*[F.first(v).alias(v) for v in variables], mean.alias("yhat"))


def partial_dependence(
    model: Model, xvars: Sequence[str], train: DataFrame, variables: Sequence[str], points: int = GRID_POINTS, cuts: Cuts | None = None
) -> DataFrame:
    """Mean prediction (i_<var>..., <var>..., yhat) over all training rows at each grid point.

    With ``cuts``, the forest's split points by variable, rows are counted by the bins of the other variables first and
    the forest sees each vector of bins once: the same mean, however many rows there are."""
    return _surface(_scored(model, xvars, train, variables, points, cuts), variables)


def replicate_surfaces(
    models: Mapping[int, Model],
    xvars: Sequence[str],
    train: DataFrame,
    variables: Sequence[str],
    points: int = GRID_POINTS,
    cuts: Mapping[int, Cuts] | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Surfaces of several models over the same rows, told apart by ``replicate``; one shuffle for all.

    With ``nodes``, the saved nodes of the models by ``run_id``, and their ``cuts``, every tree is walked once with the
    vectors of bins and all grid points together, in place of one prediction per vector and grid point: the same means."""
    if nodes is not None and cuts is not None:
        return _walked_surfaces(list(models), xvars, train, variables, points, cuts, nodes)
    scored = [
        _scored(m, xvars, train, variables, points, None if cuts is None else cuts[k]).withColumn("replicate", F.lit(k))
        for k, m in models.items()
    ]
    return _surface(union_all(scored), variables, ["replicate"])


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= WALK_ROWS:
            yield pd.concat(held)
            held, size = [], 0
    if size:
        yield pd.concat(held)


def _walked_surfaces(
    runs: Sequence[int], xvars: Sequence[str], train: DataFrame, variables: Sequence[str], points: int, cuts: Mapping[int, Cuts], nodes: DataFrame
) -> DataFrame:
    """(replicate, i_<var>..., <var>..., yhat) of ``runs``, from the nodes of their trees."""
    train = train.select(*dict.fromkeys([*xvars, *variables]))
    others = [x for x in xvars if x not in variables]
    place = {x: k for k, x in enumerate(xvars)}
    trees = forest_trees(nodes, runs)
    cells = np.indices([points] * len(variables)).reshape(len(variables), -1)
    ends = [F.col("_l")[v][e].cast("double").alias(f"_{e}_{v}") for v in variables for e in ("lo", "hi")]
    vectors = replicate_vectors(train, others, {k: cuts[k] for k in runs})
    vectors = vectors.withColumn("_l", _limits(train, variables)).select("replicate", *others, "_k", *ends)
    steps, values = [f"i_{v}" for v in variables], list(variables)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            grid = {}
            for v, i in zip(values, cells):
                lo, hi = chunk[f"_lo_{v}"].iat[0], chunk[f"_hi_{v}"].iat[0]
                grid[v] = np.where(i == points - 1, hi, lo + i * (hi - lo) / float(points - 1))
            for k, rows in chunk.groupby("replicate"):
                numbers = {place[x]: rows[x].to_numpy() for x in others}
                weights = rows["_k"].to_numpy()
                own = {place[x]: cuts[k].get(x, ()) for x in others}
                at = {place.get(v, v): g for v, g in grid.items()}
                sums = sum(grid_sums(t, numbers, weights, at, own) for t in trees[k]) / len(trees[k])
                yield pd.DataFrame({"replicate": k, **dict(zip(steps, cells)), **grid, "_s": sums, "_k": weights.sum()})

    schema = ", ".join(["replicate int", *[f"{i} int" for i in steps], *[f"{v} double" for v in values], "_s double", "_k long"])
    sums = vectors.mapInPandas(walk, schema)
    mean = F.sum("_s") / F.sum("_k")
    return sums.groupBy("replicate", *steps).agg(*[F.first(v).alias(v) for v in values], mean.alias("yhat"))


def summarize_surfaces(surfaces: DataFrame, keys: Sequence[str], cytotype: str | None = "diploid_fraction") -> DataFrame:
    """Mean, sd and coefficient of variation over replicates at each grid point.

    Where cytotype is one of the variables only its pure values are kept and labelled."""
    df = surfaces
    if cytotype and cytotype in keys:
        df = df.filter(F.col(cytotype).isin(0.0, 1.0))
    out = df.groupBy(*keys).agg(F.avg("yhat").alias("yhat_mean"), F.stddev_samp("yhat").alias("yhat_sd"))
    out = out.withColumn("cv", variation(F.col("yhat_sd"), F.col("yhat_mean")))
    if cytotype and cytotype in keys:
        out = out.withColumn("cytotype", F.when(F.col(cytotype) == 0, "triploid").otherwise("diploid"))
    return out


def prevalence(
    table: DataFrame,
    trimmed: DataFrame,
    x: str,
    y: str,
    by: Sequence[str | Column] = (),
    n_breaks: int = PREVALENCE_BREAKS,
) -> DataFrame:
    """Counts of rows in equal bins of two variables, with the square root of their share.

    Breaks span the trimmed frame; bins are reported by their lower edge and rows outside
    form NULL bins. The share is of the whole table."""
    s = trimmed.agg(
        F.struct(
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
        ).alias("s")
    ).scalar()
    df = table.withColumn("_s", s)
    xb = equal_breaks(F.col("_s.x0"), F.col("_s.x1"), n_breaks)
    yb = equal_breaks(F.col("_s.y0"), F.col("_s.y1"), n_breaks)
    binned = df.select(
        *by, bin_lower(F.col(x), xb).alias(f"{x}_bin"), bin_lower(F.col(y), yb).alias(f"{y}_bin")
    )
    names = binned.columns
    return with_sqrt_share(grouped_count(binned, names))
