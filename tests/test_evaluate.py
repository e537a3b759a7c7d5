import math

from pyspark.sql import functions as F

from freightloom.operators import evaluate as E
from freightloom.operators import models as M


def test_auc_and_classes(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    assert E.roc_auc(df, "y", "p").first().auc == 0.75
    r = E.classification_metrics(df, "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 0, 1, 2, 1.0, 0.5)
    tied = spark.createDataFrame([(0.5, 0), (0.5, 1)], "p double, y int")
    assert E.roc_auc(tied, "y", "p").first().auc == 0.5


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (0.0, 1.0)], "y double, p double")
    r = E.regression_metrics(df, "y", "p").first()
    assert abs(r.mae - 2 / 3) < 1e-6 and abs(r.rmse - math.sqrt(2 / 3)) < 1e-6 and r.mape == 25.0 and abs(r.r2 - 0.0) < 1e-6
    assert E.regression_metrics(df.where("y > 0").withColumn("p", F.col("y")), "y", "p").first().r2 == 1.0


def test_calibration(spark):
    df = spark.createDataFrame([(0.95, 1), (0.95, 0), (1.0, 1), (0.05, 0)], "p double, y int")
    rows = {r.bin: r for r in E.calibration_ece(df, "y", "p").collect()}
    assert rows[9].n == 3 and abs(rows[0].ece - (3 * abs(2 / 3 - 2.9 / 3) + 0.05) / 4) < 1e-6


def test_folds_expand(spark):
    f = spark.range(1).select(E.folds(F.lit(1000)).alias("f")).first().f
    assert [(x.train_end, x.test_end) for x in f] == [(500, 600), (600, 700), (700, 800), (800, 900), (900, 1000)]


def test_banned_features_are_refused():
    import pytest

    for kind, names in M.FEATURES.items():
        M.check_features(kind, names)
        with pytest.raises(ValueError):
            M.check_features(kind, [*names, next(iter(M.BANNED[kind]))])


def model_rows(spark, kind, n):
    """Rows with the features of a model, a day and a target that follows from the first feature."""
    value = lambda k: (F.abs(F.xxhash64("id", F.lit(k))) % 1000 / 1000).alias(M.FEATURES[kind][k])
    d = spark.range(n).select("id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("order_date"), *[value(k) for k in range(len(M.FEATURES[kind]))])
    return d.withColumn("target", (F.col(M.FEATURES[kind][0]) > 0.4).cast("int"))


def test_models_are_fitted_on_all_rows(spark, monkeypatch):
    """No row is left out, however many there are."""
    import pytest

    class Seen(Exception):
        pass

    def stop(d, name):
        raise Seen(d.count())

    monkeypatch.setattr(M, "written", stop)
    for kind in M.FEATURES:
        with pytest.raises(Seen) as seen:
            M.train(model_rows(spark, kind, 400_000), kind)
        assert seen.value.args == (400_000,)


def test_forest_grown_in_groups_is_one_forest(spark, monkeypatch, tmp_path):
    from pyspark.ml import PipelineModel

    assert M.tree_groups(10, 300) == [300] and M.tree_groups(0, 300) == [300]
    assert sum(M.tree_groups(29_000_000, 300)) == 300 and max(M.tree_groups(29_000_000, 300)) * 29_000_000 <= M.FOREST_CELLS
    monkeypatch.setattr(M, "TREES", 7)
    monkeypatch.setattr(M, "FOREST_CELLS", 6000)
    d = model_rows(spark, "supplier", 2000)
    assert M.tree_groups(2000, 7) == [3, 2, 2]
    M.train(d, "supplier").write().save(f"{tmp_path}/model")
    model = PipelineModel.load(f"{tmp_path}/model")
    trees = model.stages[-1].trees
    assert len(trees) == model.stages[-1].getNumTrees == 7 and len({t.toDebugString.split(":", 1)[1] for t in trees}) == 7
    s = M.predict(model, d, "supplier")
    assert s.where("p < 0 OR p > 1").count() == 0 and s.where((F.col("p") >= 0.5) == (F.col("target") == 1)).count() > 1900
    shares = [r.importance for r in M.importances(model, "supplier", spark).collect()]
    assert abs(sum(shares) - 1) < 1e-9 and max(shares) == shares[0]
