"""The experiment: every planned fit as a row with what its split holds, and the fits, kept in a ledger.

The ledger is a folder with one small parquet folder per finished fit, written after the fit's model. A run that is
started again reads it, leaves out what is finished, and goes on; a fit that was broken off has no row."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.operators.confusion import regression_stats

from cellframe.operators.sampling import cut_hash, hash_order, sample_rows
from cellframe.operators.spatial_blocks import complete_columns
from cellframe.operators.stack import union_all
from cellframe.plans import forests as FO
from cellframe.spark import explode_range, settle

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.IntegerType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("xvars", T.StringType()),
        T.StructField("np_train", T.LongType()),
        T.StructField("nv", T.IntegerType()),
        T.StructField("runtime", T.DoubleType()),
        T.StructField("np", T.LongType()),
        T.StructField("iter", T.IntegerType()),
        T.StructField("xvartype", T.StringType()),
        T.StructField("yvar", T.StringType()),
        T.StructField("importance", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

# The responses that are modelled together, and the predictor groups they leave out.
EXPERIMENTS = [
    (["diploid_fraction"], ["cyto", "trait"]),
    (["trait_d13c", "trait_n", "trait_cwc"], ["trait"]),
    (["damage_survey"], []),
    (["damage_lidar"], []),
    (["damage_survey_clipped"], []),
]


def planned_runs(frame: DataFrame, replicates: int = FO.REPLICATES, experiments: Sequence = EXPERIMENTS) -> DataFrame:
    """run_id, xvartype, iter, yvar, np of every fit of all experiments, numbered through."""
    sizes = frame.agg(F.count(F.lit(1)).alias("np"))
    plans, before = [], 0
    for yvars, without in experiments:
        sets = FO.predictor_sets(without=without)
        plan = FO.parameter_grid(sizes, sets, range(1, replicates + 1), yvars)
        plans.append(plan.withColumn("run_id", F.col("run_id") + before))
        before += len(sets) * replicates * len(yvars)
    return union_all(plans)


def run_seed(seed: int | str, run_id: Column) -> Column:
    return F.concat(F.lit(f"{seed}-"), run_id.cast("string"))


def _top(frame: DataFrame, block: str) -> int:
    return frame.agg(F.max(block)).first()[0] or 0


def split_cuts(frame: DataFrame, runs: DataFrame, seed: int | str = 1, fraction: float = FO.TRAIN_FRACTION, block: str = "grid_id") -> DataFrame:
    """(run_id, _cut): a block trains in a run if its hash with the run's seed is at most the cut. All runs at once;
    a run of which no block trains has no row.

    Runs are dealt to as many tasks as there are runs before their blocks are spelled out, and stay there: a task counts
    the digits of a few runs, at most DIGIT of each, however many blocks there are."""
    runs = runs.select("run_id")
    ids = explode_range(runs.repartition(max(1, runs.count()), "run_id"), F.lit(1), F.lit(_top(frame, block)), "_id")
    size = F.floor(F.lit(float(fraction)) * F.col("_n"))
    return cut_hash(ids, "_id", size, run_seed(seed, F.col("run_id")), ["run_id"])


def run_facts(frame: DataFrame, runs: DataFrame, seed: int | str = 1, fraction: float = FO.TRAIN_FRACTION, block: str = "grid_id") -> DataFrame:
    """``runs`` with nv, xvars, cut, np_train and n_test: rows of the split that are complete in the run's columns.

    Complete rows are counted once per block and combination of columns; runs then only sum over blocks. For runs that
    take all rows of the frame (np at least its size)."""
    combos = [(r.xvartype, r.yvar) for r in runs.select("xvartype", "yvar").distinct().orderBy("xvartype", "yvar").collect()]  # a plan's few

    def whole(xvartype: str, yvar: str) -> Column:
        out = F.lit(True)
        for c in dict.fromkeys([*FO.predictors(xvartype), yvar]):
            out = out & F.col(c).isNotNull()
        return out

    counts = frame.groupBy(block).agg(F.array(*[F.count_if(whole(*c)) for c in combos]).alias("_n"))
    counts = settle(counts)
    case_x = F.create_map(*[F.lit(x) for s in {s for s, _ in combos} for x in (s, "*".join(FO.predictors(s)))])
    place = F.create_map(*[F.lit(x) for k, c in enumerate(combos) for x in ("+".join(c), k)])
    numbered = runs.withColumns({"_combo": place[F.concat_ws("+", "xvartype", "yvar")], "xvars": case_x[F.col("xvartype")]})
    numbered = settle(numbered.join(split_cuts(frame, runs, seed, fraction, block), "run_id", "left"), small=True)  # one row a fit
    plan = numbered.agg(F.collect_list(F.struct("run_id", "_combo", "_cut")).alias("_p")).scalar()  # the plan, a few columns
    # blocks are little data, but each meets every run
    counts = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism, block)
    rows = counts.withColumn("_r", F.explode(plan)).select(block, F.col("_r.run_id").alias("run_id"), F.get("_n", F.col("_r._combo")).alias("_k"), F.col("_r._cut").alias("_cut"))
    train = F.coalesce(hash_order(F.col(block), run_seed(seed, F.col("run_id"))) <= F.col("_cut"), F.lit(False))
    sums = rows.groupBy("run_id").agg(F.sum(F.when(train, F.col("_k")).otherwise(0)).alias("np_train"), F.sum(F.when(~train, F.col("_k")).otherwise(0)).alias("n_test"))
    nv = F.size(F.split("xvars", r"\*"))
    return numbered.join(sums, "run_id", "left").withColumns({"nv": nv, "cut": F.col("_cut")}).fillna(0, ["np_train", "n_test"]).drop("_combo", "_cut")


def finished_runs(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows so far; an empty ledger is started where there is none."""
    fields = [f for f in RESULT_SCHEMA if f.name != "run_id"]
    spark.createDataFrame([], T.StructType(fields)).write.mode("ignore").parquet(f"{ledger}/run_id=0")
    return spark.read.schema(RESULT_SCHEMA).parquet(ledger)


def _note(spark: SparkSession, ledger: str, row: tuple) -> None:
    fields = [f for f in RESULT_SCHEMA if f.name != "run_id"]
    spark.createDataFrame([row[1:]], T.StructType(fields)).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/run_id={row[0]}")


def run_experiment(
    frame: DataFrame,
    params: DataFrame,
    trees: int = FO.TREES,
    depth: int = FO.DEPTH,
    seed: int = 1,
    parallelism: int = 1,
    model_path: str | None = None,
    on_fit: Callable[[int, FO.Fit], None] | None = None,
    ledger: str | None = None,
    reread: bool = False,
) -> DataFrame:
    """Fit every row of the plan and return one result row per fit.

    The frame is settled once (unless ``reread`` says that it is stored), so all fits, and any task that is run again,
    read the same rows. Splits and counts of all fits come from one aggregation before the first. Each fit is a Spark job
    over the whole frame; ``parallelism`` fits are in flight. With ``model_path`` every model is saved as
    ``<model_path>/run_id=<n>``; with ``ledger`` finished fits are left out, and their rows returned from there."""
    spark = frame.sparkSession
    frame = frame if reread else settle(frame)
    n_rows = frame.count()
    todo = params if ledger is None else params.join(finished_runs(spark, ledger).select("run_id"), "run_id", "left_anti")
    runs = [] if todo.isEmpty() else run_facts(frame, todo, seed).orderBy("run_id").collect()  # the plan of fits, one short row each

    def one(p) -> tuple:
        started = time.time()
        xvars, run = FO.predictors(p.xvartype), f"{seed}-{p.run_id}"
        if p.np < n_rows:
            train, test = FO.split_frame(sample_rows(frame, "cell_id", p.np, run), xvars, p.yvar, run)
            np_train = train.count()
        else:
            columns = list(dict.fromkeys([*xvars, p.yvar]))
            inside = F.lit(False) if p.cut is None else F.coalesce(hash_order("grid_id", run) <= F.lit(p.cut), F.lit(False))
            train, test = (complete_columns(frame.filter(side), columns) for side in (inside, ~inside))
            np_train = p.np_train
        fit = FO.fit_regression(train, test, xvars, p.yvar, seed * 100_003 + p.run_id, trees, depth)
        stats = regression_stats(fit.scored, p.yvar, "prediction").first()
        if model_path:
            fit.model.write().overwrite().save(f"{model_path}/run_id={p.run_id}")
        if on_fit:
            on_fit(p.run_id, fit)
        out = (
            p.run_id,
            stats.rmse,
            stats.r2,
            p.xvars,
            np_train,
            len(xvars),
            time.time() - started,
            p.np,
            p.iter,
            p.xvartype,
            p.yvar,
            fit.importance(),
        )
        if ledger:
            _note(spark, ledger, out)
        return out

    with ThreadPool(max(1, parallelism)) as pool:
        rows = pool.map(inheritable_thread_target(spark)(one) if parallelism > 1 else one, runs, chunksize=1)
    if ledger:
        return finished_runs(spark, ledger).join(params.select("run_id"), "run_id", "left_semi").select(*RESULT_SCHEMA.names)
    return spark.createDataFrame(rows, RESULT_SCHEMA)
