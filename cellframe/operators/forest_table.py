"""A saved forest as a table of nodes, and what can be read off it: importance, split points, bins.

A saved ensemble is a parquet folder with one row per node, so these are ordinary aggregations: no tree is walked on the
driver. Predictions depend on a row only through the side of every split it is on, so a variable may be replaced by the
number of split points below it, and rows with the same numbers by one row with a count."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Cuts = Mapping[str, Sequence[float]]
#: Columns of a tree's nodes in the order of their numbers, the root first: variable (-1: leaf), threshold, left, right, prediction.
Tree = dict[str, np.ndarray]


def saved_nodes(spark: SparkSession, path: str, xvars: Sequence[str] | None = None) -> DataFrame:
    """(tree, node, variable, threshold, gain, rows, impurity, prediction, left, right) of a saved forest; leaves have no
    variable and no children.

    With ``<path>/run_id=<n>`` folders below ``path`` all of them are read, and ``run_id`` tells them apart. ``variable``
    is the number of the predictor, or its name where ``xvars`` are given."""
    if xvars is None:
        data, by = spark.read.option("basePath", path).parquet(f"{path}/run_id=*/data"), ["run_id"]
    else:
        data, by = spark.read.parquet(f"{path}/data"), []
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    variable: Column = n["split"]["featureIndex"]
    if xvars is not None:
        variable = F.element_at(F.array(*[F.lit(x) for x in xvars]), variable + 1)
    return data.select(
        *by,
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(inner, variable).alias("variable"),
        F.when(inner, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, n["gain"]).alias("gain"),
        n["rawCount"].alias("rows"),
        n["impurity"].alias("impurity"),
        n["prediction"].alias("prediction"),
        F.when(inner, n["leftChild"]).alias("left"),
        F.when(inner, n["rightChild"]).alias("right"),
    )


def raw_importance(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, importance): decrease of impurity times rows, summed over a tree's splits and averaged over trees.

    Variables without a split have no row."""
    trees = nodes.groupBy(*by).agg((F.max("tree") + 1).alias("_trees"))
    sums = nodes.filter("variable is not null").groupBy(*by, "variable").agg(F.sum(F.col("gain") * F.col("rows")).alias("_s"))
    sums = sums.join(trees, list(by)) if by else sums.withColumn("_trees", trees.scalar())
    return sums.select(*by, "variable", (F.col("_s") / F.col("_trees")).alias("importance"))


def normalized_importance(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, importance): each tree's shares, averaged and brought to the sum 1."""
    tree = nodes.filter("variable is not null").groupBy(*by, "tree", "variable").agg(F.sum(F.col("gain") * F.col("rows")).alias("_s"))
    whole = tree.groupBy(*by, "tree").agg(F.sum("_s").alias("_t")).filter("_t > 0")
    shares = tree.join(whole, [*by, "tree"]).groupBy(*by, "variable").agg(F.sum(F.col("_s") / F.col("_t")).alias("_s"))
    total = shares.groupBy(*by).agg(F.sum("_s").alias("_t"))
    shares = shares.join(total, list(by)) if by else shares.withColumn("_t", total.scalar())
    return shares.select(*by, "variable", (F.col("_s") / F.col("_t")).alias("importance"))


def split_points(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, cuts): sorted distinct thresholds, fewer than the forest's bins for every variable."""
    cuts = nodes.filter("variable is not null").groupBy(*by, "variable")
    return cuts.agg(F.array_sort(F.collect_set("threshold")).alias("cuts"))


def _doubles(values: Sequence[float]) -> Column:
    """An array of constants, made in one call."""
    return F.expr(f"array({', '.join(f"double('{float(v)!r}')" for v in values)})")


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(_doubles(cuts), lambda t: t < value))


def _inside(number: Column, cuts: Sequence[float]) -> Column:
    """A value of bin ``number``: a split sends values up to its threshold to the left."""
    if not cuts:
        return F.lit(0.0)
    top = float(cuts[-1])
    ends = [*map(float, cuts), top + max(1.0, abs(top))]
    return F.element_at(_doubles(ends), number + 1)


def bin_vectors(df: DataFrame, xvars: Sequence[str], cuts: Cuts) -> DataFrame:
    """(xvars..., _k): distinct vectors of bins, as values that every split treats like the rows', with their row counts.

    Counting combines before the shuffle; there are at most as many vectors as combinations of bins that occur."""
    if not xvars:
        return df.agg(F.count(F.lit(1)).alias("_k"))
    numbers = df.select(*[_bin(F.col(x), cuts.get(x, ())).alias(x) for x in xvars])
    counted = numbers.groupBy(*xvars).agg(F.count(F.lit(1)).alias("_k"))
    return counted.select(*[_inside(F.col(x), cuts.get(x, ())).alias(x) for x in xvars], "_k")


def replicate_vectors(df: DataFrame, xvars: Sequence[str], cuts: Mapping[int, Cuts]) -> DataFrame:
    """(replicate, xvars..., _k): the distinct vectors of bin numbers of every forest in ``cuts``, with their row counts.

    All forests are one pass over the rows and one shuffle, and counting combines before it."""
    numbers = [F.struct(F.lit(k).alias("replicate"), *[_bin(F.col(x), c.get(x, ())).alias(x) for x in xvars]) for k, c in cuts.items()]
    return df.select(F.inline(F.array(*numbers))).groupBy("replicate", *xvars).agg(F.count(F.lit(1)).alias("_k"))


def forest_trees(nodes: DataFrame, runs: Sequence[int]) -> dict[int, list[Tree]]:
    """The trees of the runs out of ``saved_nodes``, as arrays that tasks walk; they are as large as the models themselves."""
    names = ["variable", "threshold", "left", "right", "prediction"]
    wanted = nodes.filter(F.col("run_id").isin(*map(int, runs))).fillna(-1, ["variable", "left", "right"])
    table = wanted.select("run_id", "tree", "node", *names).toArrow().to_pandas().sort_values(["run_id", "tree", "node"])
    trees = defaultdict(list)
    for (run, _), tree in table.groupby(["run_id", "tree"]):
        trees[int(run)].append({n: tree[n].to_numpy() for n in names})
    return trees


def grid_sums(tree: Tree, numbers: Mapping[int, np.ndarray], weights: np.ndarray, grid: Mapping[int, np.ndarray], cuts: Mapping[int, Sequence[float]]) -> np.ndarray:
    """Sum of a tree's predictions over all rows at every grid cell.

    ``numbers`` are the rows' bins by predictor, ``weights`` their counts, ``grid`` the cells' values of the other
    predictors. Rows and cells go down the tree together: a split on a grid variable parts the cells, one on any other the
    rows. Each node is so met once, with the rows and cells that reach it, and no row is scored again for another cell."""
    limit = np.zeros(len(tree["variable"]), dtype=np.int64)
    for x in numbers:
        here = tree["variable"] == x
        limit[here] = np.searchsorted(cuts[x], tree["threshold"][here])  # at most as many split points lie below a value on the left
    variable, threshold, left, right, prediction, limit = (a.tolist() for a in (*tree.values(), limit))
    out = np.zeros(len(next(iter(grid.values()))))
    todo = [(0, np.arange(len(weights)), np.arange(len(out)))]
    while todo:
        node, rows, cells = todo.pop()
        x = variable[node]
        if x < 0:
            out[cells] += prediction[node] * weights[rows].sum()
        elif x in grid:
            low = grid[x][cells] <= threshold[node]
            todo += [(to, rows, some) for to, some in ((left[node], cells[low]), (right[node], cells[~low])) if len(some)]
        else:
            low = numbers[x][rows] <= limit[node]
            todo += [(to, some, cells) for to, some in ((left[node], rows[low]), (right[node], rows[~low])) if len(some)]
    return out
