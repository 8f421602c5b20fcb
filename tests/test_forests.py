import hashlib

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from cellframe.plans import forests as FO
from cellframe.operators import forest_table as FT
from cellframe.operators.confusion import regression_stats
from cellframe.plans import partial_dependence as PD
from cellframe.plans import runs as R
from cellframe.spark import settle


@pytest.fixture(scope="module")
def frame(spark):
    """Cells on a plane of predictors whose response is additive and known."""
    u = lambda k: (F.col("id") * k % 997) / 997.0
    df = spark.range(4000).select(
        F.col("id").alias("cell_id"),
        ((F.col("id") % 80) * 10.0 + 5).alias("x"),
        (F.floor(F.col("id") / 80) * 10.0 + 5).alias("y"),
        F.lit(0.9).alias("cover_fraction"),
        F.when(F.col("id") % 10 != 0, (F.col("id") % 3 == 0).cast("double")).alias("damage_lidar"),
        (F.col("id") % 2).cast("double").alias("diploid_fraction"),
        (2600 + 1000 * u(331)).alias("elevation"),
        (2 * u(577) - 1).alias("cos_aspect"),
        (50 * u(709)).alias("slope"),
        u(211).alias("trait_n"),
        u(409).alias("trait_d13c"),
        u(613).alias("trait_cwc"),
        (20 * u(797)).alias("height"),
    )
    df = df.withColumn("damage_survey", F.col("diploid_fraction") + (F.col("elevation") - 2600) / 500 + 0.3 * F.col("trait_cwc"))
    return settle(FO.modelling_frame(df))


def test_predictor_sets():
    sets = FO.predictor_sets()
    assert len(sets) == 15 and sets[0] == "cyto" and sets[-1] == "cyto+topo+trait+height"
    assert sets[4:7] == ["cyto+topo", "cyto+trait", "cyto+height"]
    assert FO.predictor_sets(without=["cyto", "trait"]) == ["topo", "height", "topo+height"]
    assert len(FO.predictor_sets(without=["trait"])) == 7
    assert FO.predictors("topo+height") == ["elevation", "cos_aspect", "slope", "height"]
    assert len(FO.predictors("cyto+topo+trait+height")) == 8


def test_planned_fits_add_up(spark):
    one = spark.range(1).select(F.lit(100).cast("bigint").alias("np"))
    grids = [
        (FO.predictor_sets(without=["cyto", "trait"]), ["diploid_fraction"]),
        (FO.predictor_sets(without=["trait"]), ["trait_d13c", "trait_n", "trait_cwc"]),
        *[(FO.predictor_sets(), [y]) for y in ("damage_survey", "damage_lidar", "damage_survey_clipped")],
    ]
    plans = [FO.parameter_grid(one, s, range(1, 6), y) for s, y in grids]
    assert [p.count() for p in plans] == [15, 105, 75, 75, 75]
    first = plans[0].orderBy("run_id").limit(4).collect()
    assert [(r.run_id, r.xvartype, r.iter) for r in first] == [(1, "topo", 1), (2, "height", 1), (3, "topo+height", 1), (4, "topo", 2)]


def test_modelling_frame(frame):
    assert frame.filter("damage_lidar IS NULL AND damage_survey_clipped IS NOT NULL").count() == 0
    assert frame.filter("damage_lidar IS NOT NULL AND damage_survey_clipped <> damage_survey").count() == 0
    assert frame.filter("grid_id IS NULL").count() == 0


def test_regression_learns_and_importance_is_shared_out(frame):
    xvars = FO.predictors("cyto+topo+trait+height")
    train, test = FO.split_frame(frame, xvars, "damage_survey", 1)
    fit = FO.fit_regression(train, test, xvars, "damage_survey", 1, trees=15, depth=8)
    assert regression_stats(fit.scored, "damage_survey", "prediction").first().r2 > 0.85
    imp = fit.importance()
    assert abs(sum(imp.values()) - 1) < 1e-9
    assert imp["elevation"] + imp["diploid_fraction"] > 0.7

    surface = PD.partial_dependence(fit.model, xvars, train, ["diploid_fraction", "elevation"])
    rows = {(r.i_diploid_fraction, r.i_elevation): r for r in surface.collect()}
    assert len(rows) == 25
    span = train.agg(F.min("elevation"), F.max("elevation")).first()
    assert rows[(0, 0)].elevation == span[0] and rows[(4, 4)].elevation == span[1]
    assert [rows[(i, 0)].diploid_fraction for i in range(5)] == [0.0, 0.25, 0.5, 0.75, 1.0]
    for i in (0, 4):
        curve = [rows[(i, j)].yhat for j in range(5)]
        assert curve == sorted(curve)
    assert rows[(4, 2)].yhat - rows[(0, 2)].yhat == pytest.approx(1.0, abs=0.35)

    # the surface is the plain mean of predictions with the two columns replaced
    fixed = train.select(*xvars).withColumns({"diploid_fraction": F.lit(1.0), "elevation": F.lit(span[1])})
    brute = fit.model.transform(FO._assemble(fixed, xvars)).agg(F.avg("prediction")).first()[0]
    assert rows[(4, 4)].yhat == pytest.approx(brute, abs=1e-9)


def test_saved_forest_as_a_table(spark, frame, tmp_path):
    """Importance, split points and surfaces read from the nodes agree with the model's own."""
    xvars = FO.predictors("cyto+topo+trait+height")
    train, test = FO.split_frame(frame, xvars, "damage_survey", 1)
    fit = FO.fit_regression(train, test, xvars, "damage_survey", 1, trees=12, depth=6)
    fit.model.write().save(str(tmp_path / "forest"))
    nodes = FT.saved_nodes(spark, str(tmp_path / "forest"), xvars).cache()
    assert nodes.select("tree").distinct().count() == 12 and nodes.count() == fit.model.totalNumNodes
    shares = {r.variable: r.importance for r in FT.normalized_importance(nodes).collect()}
    own = fit.importance()
    assert all(shares.get(x, 0.0) == pytest.approx(own[x], abs=1e-9) for x in xvars)
    raw = {r.variable: r.importance for r in FT.raw_importance(nodes).collect()}
    by_hand = {}
    for r in nodes.filter("variable is not null").collect():
        by_hand[r.variable] = by_hand.get(r.variable, 0.0) + r.gain * r.rows / 12
    assert raw == pytest.approx(by_hand) and sum(raw.values()) > 1.5

    cuts = {r.variable: r.cuts for r in FT.split_points(nodes).collect()}
    assert all(len(c) < 32 and c == sorted(set(c)) for c in cuts.values())
    variables = ["diploid_fraction", "elevation"]
    plain = {tuple(r[:2]): r for r in PD.partial_dependence(fit.model, xvars, train, variables).collect()}
    binned = {tuple(r[:2]): r for r in PD.partial_dependence(fit.model, xvars, train, variables, cuts=cuts).collect()}
    assert plain.keys() == binned.keys()
    for k, r in plain.items():
        assert (binned[k].diploid_fraction, binned[k].elevation) == (r.diploid_fraction, r.elevation)
        assert binned[k].yhat == pytest.approx(r.yhat, abs=1e-12)

    # rows on, below and above split points, and a variable without any
    edge = spark.createDataFrame([(t + d, 1.0) for t in cuts["elevation"] for d in (-1e-9, 0.0, 1e-9)] + [(-9e9, 2.0), (9e9, 3.0)], "elevation double, slope double")
    vectors = FT.bin_vectors(edge, ["elevation", "slope"], {"elevation": cuts["elevation"]}).collect()
    assert sum(r._k for r in vectors) == edge.count() and len(vectors) == len(cuts["elevation"]) + 1
    assert {r.slope for r in vectors} == {0.0}


def test_planned_runs_and_their_splits(spark, frame):
    plan = R.planned_runs(frame)
    facts = {r.run_id: r for r in R.run_facts(frame, plan).collect()}
    assert sorted(facts) == list(range(1, 346))
    for run in (1, 15, 16, 100, 121, 345):
        f = facts[run]
        train, test = FO.split_frame(frame, FO.predictors(f.xvartype), f.yvar, f"1-{run}")
        assert (f.np_train, f.n_test) == (train.count(), test.count())
        assert f.xvars.split("*") == FO.predictors(f.xvartype) and f.nv == len(f.xvars.split("*"))
        assert f.np == frame.count()


def test_an_interrupted_experiment_goes_on(spark, frame, tmp_path):
    params = R.planned_runs(frame).filter("run_id in (2, 3, 17, 130)")
    ledger, models = str(tmp_path / "ledger"), str(tmp_path / "models")
    fitted = []

    def stop(run_id, fit):
        fitted.append(run_id)
        if len(fitted) == 3:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        R.run_experiment(frame, params, 3, 3, model_path=models, ledger=ledger, on_fit=stop)
    assert fitted == [2, 3, 17, 130]  # the others go on
    assert sorted(r.run_id for r in R.finished_runs(spark, ledger).collect()) == [2, 3, 130]
    again = []
    out = R.run_experiment(frame, params, 3, 3, model_path=models, ledger=ledger, on_fit=lambda k, f: again.append(k))
    rows = {r.run_id: r for r in out.collect()}
    assert again == [17] and sorted(rows) == [2, 3, 17, 130]
    straight = {r.run_id: r for r in R.run_experiment(frame, params, 3, 3).collect()}
    for k, r in straight.items():
        assert (rows[k].rmse, rows[k].np_train, rows[k].importance, rows[k].xvars) == (r.rmse, r.np_train, r.importance, r.xvars)
    R.run_experiment(frame, params, 3, 3, ledger=ledger, on_fit=lambda k, f: again.append(k))
    assert again == [17]
    assert FT.saved_nodes(spark, models).select("run_id").distinct().count() == 4


def test_probability_forest(frame):
    labelled = frame.withColumn("label", (F.col("elevation") > 3000).cast("double"))
    stats = FO.run_class_experiment(labelled, "label", ["elevation", "slope"], 1, trees=10, depth=5).first()
    assert stats.sensitivity > 0.95 and stats.specificity > 0.95
    assert 0 < stats.prevalence < 1


def test_experiment_rows_models_and_best_runs(spark, frame, tmp_path):
    params = FO.parameter_grid(frame.agg(F.count("*").alias("np")), ["topo", "cyto+topo"], [1, 2], ["damage_survey"])
    seen = []
    out = R.run_experiment(
        frame, params, trees=5, depth=5, parallelism=2, model_path=str(tmp_path), on_fit=lambda i, f: seen.append(i)
    )
    rows = {r.run_id: r for r in out.collect()}
    assert sorted(rows) == sorted(seen) == [1, 2, 3, 4]
    assert rows[2].xvars == "diploid_fraction*elevation*cos_aspect*slope" and rows[2].nv == 4
    assert rows[2].r2 > rows[1].r2
    assert all(r.np == frame.count() and 0 < r.np_train < r.np and r.runtime > 0 for r in rows.values())
    again = R.run_experiment(frame, params, trees=5, depth=5).collect()
    assert {r.run_id: round(r.r2, 9) for r in again} == {k: round(r.r2, 9) for k, r in rows.items()}

    from cellframe.operators.tables import longest_label_rows

    best = [r.run_id for r in longest_label_rows(out, "xvartype", "np").orderBy("run_id").collect()]
    assert best == [2, 4]
    models = {i: RandomForestRegressionModel.load(f"{tmp_path}/run_id={i}") for i in best}
    surfaces = PD.replicate_surfaces(models, FO.predictors("cyto+topo"), frame, ["diploid_fraction", "elevation"], 3)
    assert surfaces.count() == 18
    s = PD.summarize_surfaces(surfaces, ["diploid_fraction", "i_elevation"])
    assert s.count() == 6 and {r.cytotype for r in s.collect()} == {"triploid", "diploid"}
    assert s.filter("cv < 0 OR yhat_sd IS NULL").count() == 0


def test_surfaces_from_saved_trees_are_the_mean_of_predictions(spark, frame, tmp_path):
    params = FO.parameter_grid(frame.agg(F.count("*").alias("np")), ["cyto+topo"], [1, 2], ["damage_survey"])
    R.run_experiment(frame, params, trees=6, depth=6, model_path=str(tmp_path))
    xvars, variables = FO.predictors("cyto+topo"), ["diploid_fraction", "elevation", "height"]  # the last is no predictor
    nodes = FT.saved_nodes(spark, str(tmp_path))
    cuts = {1: {}, 2: {}}
    for r in FT.split_points(nodes, ["run_id"]).collect():
        cuts[r.run_id][xvars[r.variable]] = r.cuts
    twice = frame.filter("grid_id % 3 = 0").unionAll(frame.filter("grid_id % 6 = 0"))
    # rows on a split point go to its left
    rows = twice.unionAll(twice.limit(1).withColumn("slope", F.explode(F.lit([float(c) for c in cuts[1]["slope"]]))))
    models = {k: RandomForestRegressionModel.load(f"{tmp_path}/run_id={k}") for k in (1, 2)}
    plain = PD.replicate_surfaces(models, xvars, rows, variables, 4)
    walked = PD.replicate_surfaces(dict.fromkeys(models), xvars, rows, variables, 4, cuts, nodes)  # no prediction per grid point
    assert [(f.name, f.dataType) for f in walked.schema] == [(f.name, f.dataType) for f in plain.schema]
    key = lambda r: (r.replicate, r.i_diploid_fraction, r.i_elevation, r.i_height)
    expected, found = ({key(r): r for r in df.collect()} for df in (plain, walked))
    assert found.keys() == expected.keys() and len(found) == 2 * 4**3
    for k, r in expected.items():
        assert all(found[k][v] == r[v] for v in variables) and found[k].yhat == pytest.approx(r.yhat, abs=1e-12)


def test_rows_and_grid_go_down_a_tree_together():
    a = lambda *v: np.array(v)
    tree = {"variable": a(0, -1, 1, -1, -1), "threshold": a(2.0, 0, 5.0, 0, 0), "left": a(1, -1, 3, -1, -1), "right": a(2, -1, 4, -1, -1), "prediction": a(0, 10.0, 0, 20.0, 30.0)}
    # grid 1, 2 and 3 of variable 0: 2 is on the threshold; rows of bins 0 (values up to 5) and 1 of variable 1
    assert FT.grid_sums(tree, {1: a(0, 1)}, a(3, 4), {0: a(1.0, 2.0, 3.0)}, {1: [5.0]}).tolist() == [70.0, 70.0, 180.0]


def test_smaller_samples_are_taken(frame):
    params = FO.parameter_grid(frame.limit(1).select(F.lit(500).cast("bigint").alias("np")), ["topo"], [1], ["height"])
    r = R.run_experiment(frame, params, trees=2, depth=2).first()
    assert r.np == 500 and r.np_train < 500


def test_registered_surfaces_are_all_seven_over_the_replicates(spark):
    from cellframe.catalog import QUERIES

    rows = QUERIES["pdp_surface"](spark, "/root/testdata/sf0.01").collect()
    assert {r.yvar for r in rows} == set(PD.SURFACES)
    for yvar, variables in PD.SURFACES.items():
        some = [r for r in rows if r.yvar == yvar]
        points = [PD.GRID_POINTS if v != "diploid_fraction" else 2 for v in variables]
        assert len({tuple(r[f"i_{v}"] for v in variables) for r in some}) == len(some) <= np.prod(points)
        assert all(r.yhat_sd is not None and r.yhat_mean is not None for r in some)


def test_split_cuts_deal_runs_to_tasks(spark, monkeypatch):
    seen = []
    real = R.cut_hash
    monkeypatch.setattr(R, "cut_hash", lambda df, *a: seen.append(df) or real(df, *a))
    frame = spark.range(1, 41).withColumnRenamed("id", "grid_id")
    cuts = R.split_cuts(frame, R.planned_runs(frame)).collect()
    tasks = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 345 * 40 and max(tasks) <= 345 * 40 // 20
    order = sorted(hashlib.md5(f"{b}:1-7".encode()).hexdigest() for b in range(1, 41))
    assert {r.run_id: r._cut for r in cuts}[7] == order[31] and len(cuts) == 345
