"""Confusion tables in long form and the rates derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.text import strip_prefix

# Class order of the nine-class cover matrix.
COVER_CLASSES = [
    "aspen",
    "built environment",
    "conifer",
    "dry meadow",
    "mesic meadow",
    "misc bare",
    "snow",
    "water",
    "woody riparian",
]


def from_pairs(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """(observed, predicted, value) counts of labelled rows."""
    return (
        df.select(F.col(observed).alias("observed"), F.col(predicted).alias("predicted"))
        .dropna()
        .groupBy("observed", "predicted")
        .agg(F.count(F.lit(1)).alias("value"))
    )


def tidy_crosstab(matrix: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Cross table with predicted labels in a column and observed labels as headings."""
    return matrix.unpivot([label], list(columns), "observed", "value").select(
        strip_prefix(F.col("observed"), "observed").alias("observed"),
        strip_prefix(F.col(label), "predicted").alias("predicted"),
        "value",
    )


def tidy_square(matrix: DataFrame, observed: str, classes: Sequence[str]) -> DataFrame:
    """Square matrix whose rows carry the observed label."""
    return matrix.unpivot([observed], list(classes), "predicted", "value").select(
        F.col(observed).alias("observed"), "predicted", "value"
    )


def one_vs_rest(table: DataFrame, target: Column | str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """tp, tn, fp, fn of one class against all others, in a single pass."""
    target = F.lit(target) if isinstance(target, str) else target
    hit, said = F.col("observed") == target, F.col("predicted") == target

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0))

    return table.groupBy(*by).agg(
        total(said & hit).alias("tp"),
        total(~said & ~hit).alias("tn"),
        total(said & ~hit).alias("fp"),
        total(~said & hit).alias("fn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """All by-class rates of (tp, tn, fp, fn); a zero denominator gives NULL."""
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b)

    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.withColumns(
        {
            "sensitivity": sens,
            "specificity": spec,
            "pos_pred_value": ratio(tp, tp + fp),
            "neg_pred_value": ratio(tn, tn + fn),
            "precision": ratio(tp, tp + fp),
            "recall": sens,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "prevalence": ratio(tp + fn, n),
            "detection_rate": ratio(tp, n),
            "detection_prevalence": ratio(tp + fp, n),
            "balanced_accuracy": (sens + spec) / 2,
            "accuracy": ratio(tp + tn, n),
        }
    )


def threshold_stats(
    df: DataFrame, observed: Column, predicted: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Rates straight from boolean observed / predicted columns in one aggregation."""
    counts = df.groupBy(*by).agg(
        F.count_if(predicted & observed).alias("tp"),
        F.count_if(~predicted & ~observed).alias("tn"),
        F.count_if(predicted & ~observed).alias("fp"),
        F.count_if(~predicted & observed).alias("fn"),
    )
    return rates(counts)


def regression_stats(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE and R2 as the squared correlation of observed and predicted."""
    return df.groupBy(*by).agg(
        F.sqrt(F.avg((F.col(y) - F.col(prediction)) ** 2)).alias("rmse"),
        (F.corr(y, prediction) ** 2).alias("r2"),
    )
