"""Random-forest experiments over the modelling table."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators.confusion import threshold_stats
from cellframe.operators.quantiles import trim_by_quantiles
from cellframe.operators.sampling import sample_balanced
from cellframe.operators.spatial_blocks import complete_columns, split_blocks, with_block_ids
from cellframe.spark import settle

# Predictor groups and their columns, forest size, split and filters.
PREDICTOR_GROUPS = {
    "cyto": ["diploid_fraction"],
    "topo": ["elevation", "cos_aspect", "slope"],
    "trait": ["trait_n", "trait_d13c", "trait_cwc"],
    "height": ["height"],
}
TREES = 1000
DEPTH = 10
TRAIN_FRACTION = 0.8
COVER_THRESHOLD = 0.5
BLOCK_METRES = 100.0
REPLICATES = 5

#: Columns whose extreme percents are cut off before partial dependence and break points.
TRIM = ["trait_cwc", "trait_d13c", "trait_n", "elevation", "cos_aspect", "slope", "height"]


def training_frame(frame: DataFrame, threshold: float = COVER_THRESHOLD, reread: bool = False) -> DataFrame:
    """The rows that partial dependence and break points are taken over: enough cover, complete in every column but the
    two unclipped damage ones, and within the 1 % and 99 % quantiles of all TRIM columns."""
    clipped = F.when(F.col("damage_lidar").isNotNull(), F.col("damage_survey"))
    df = frame.filter(F.col("cover_fraction") > threshold).withColumn("damage_survey_clipped", clipped).drop("damage_survey", "damage_lidar")
    return trim_by_quantiles(df, TRIM, complete=["diploid_fraction", "damage_survey_clipped", *TRIM], reread=reread)


def modelling_frame(table: DataFrame, block: float = BLOCK_METRES, threshold: float = COVER_THRESHOLD) -> DataFrame:
    """Modelling rows with block ids, enough cover, and the survey response clipped to the
    cells that also have height change. Blocks are numbered before the cover filter.

    The table is settled first: its extent, its blocks and its rows are read separately."""
    df = with_block_ids(settle(table), block).filter(F.col("cover_fraction") > threshold)
    return df.withColumn("damage_survey_clipped", F.when(F.col("damage_lidar").isNotNull(), F.col("damage_survey")))


def predictor_sets(groups: Sequence[str] = tuple(PREDICTOR_GROUPS), without: Sequence[str] = ()) -> list[str]:
    """All non-empty combinations, smallest first, joined by ``+``; ``without`` drops the
    ones that mention a group."""
    names = ["+".join(s) for k in range(1, len(groups) + 1) for s in itertools.combinations(groups, k)]
    return [n for n in names if not any(w in n for w in without)]


def predictors(xvartype: str) -> list[str]:
    """Columns of a combination such as ``cyto+topo``."""
    return [c for g, cols in PREDICTOR_GROUPS.items() if g in xvartype for c in cols]


def parameter_grid(
    sizes: DataFrame, xvartypes: Sequence[str], iters: Sequence[int], yvars: Sequence[str]
) -> DataFrame:
    """One row per planned fit; the first factor varies fastest. ``sizes`` is the one-row
    table with the sample size ``np``."""

    def level(values, name):
        return F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{name}", name)

    grid = (
        sizes.select("np", level(yvars, "yvar"))
        .select("*", level(iters, "iter"))
        .select("*", level(xvartypes, "xvartype"))
    )
    run = F.col("_yvar") * len(iters) * len(xvartypes) + F.col("_iter") * len(xvartypes) + F.col("_xvartype") + 1
    return grid.select(run.alias("run_id"), "xvartype", "iter", "yvar", "np")


@dataclass
class Fit:
    """A fitted forest with its held-out predictions."""

    model: Model
    xvars: list[str]
    yvar: str
    train: DataFrame
    scored: DataFrame

    def importance(self) -> dict[str, float]:
        return dict(zip(self.xvars, (float(v) for v in self.model.featureImportances.toArray())))


def _assemble(df: DataFrame, xvars: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(xvars), outputCol="features").transform(df)


def split_frame(
    frame: DataFrame, xvars: Sequence[str], yvar: str, seed: int | str, fraction: float = TRAIN_FRACTION
) -> tuple[DataFrame, DataFrame]:
    """Block-wise split, then only the needed columns and complete rows."""
    train, test = split_blocks(frame, fraction, seed)
    columns = list(dict.fromkeys([*xvars, yvar]))
    return complete_columns(train, columns), complete_columns(test, columns)


def _mtry(xvars: Sequence[str]) -> str:
    return str(max(1, int(len(xvars) ** 0.5)))


def fit_regression(
    train: DataFrame, test: DataFrame, xvars: Sequence[str], yvar: str, seed: int, trees: int = TREES, depth: int = DEPTH
) -> Fit:
    """Regression forest trained on ``train`` and applied to ``test``."""
    forest = RandomForestRegressor(
        labelCol=yvar,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy=_mtry(xvars),
        seed=seed,
        maxMemoryInMB=512,
    )
    model = forest.fit(_assemble(train, xvars))
    return Fit(model, list(xvars), yvar, train, model.transform(_assemble(test, xvars)).drop("features"))


def fit_probability(
    train: DataFrame, test: DataFrame, xvars: Sequence[str], label: str, seed: int, trees: int = TREES, depth: int = DEPTH
) -> Fit:
    """Probability forest over a 0/1 label; adds ``p0``, the probability of class 0."""
    forest = RandomForestClassifier(
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy=_mtry(xvars),
        seed=seed,
        maxMemoryInMB=512,
    )
    model = forest.fit(_assemble(train, xvars))
    scored = model.transform(_assemble(test, xvars)).withColumn("p0", vector_to_array("probability")[0])
    return Fit(model, list(xvars), label, train, scored.drop("features", "rawPrediction", "probability"))


def class_stats(fit: Fit) -> DataFrame:
    """By-class rates at the 0.5 threshold; the first class (0) counts as positive."""
    return threshold_stats(fit.scored, F.col(fit.yvar) == 0, F.col("p0") >= 0.5)


def run_class_experiment(
    frame: DataFrame, label: str, xvars: Sequence[str], seed: int = 1, trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """Class-balanced sample, block split, probability forest, by-class rates."""
    frame = settle(frame)
    sampled = sample_balanced(frame, "cell_id", label, seed, divide_by=2)
    train, test = split_frame(sampled, xvars, label, seed)
    return class_stats(fit_probability(train, test, xvars, label, seed, trees, depth))
