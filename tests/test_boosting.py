"""Boosted trees of all classes against a plain recursive booster."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hazardloom.operators import boosting, models


def plain(x, y, classes, trees, depth, step):
    """Margins and mean gains by trying every split of every node over all its rows."""
    margins, gains = np.zeros((len(x), classes)), {}

    def build(rows, g, h, left):
        total, weight, best = g[rows].sum(), h[rows].sum(), None
        for f in range(x.shape[1] if left else 0):
            for c in boosting.cut_points(x[:, f]):
                low = x[rows, f] <= c
                a, b = g[rows][low].sum(), h[rows][low].sum()
                if b < 1 or weight - b < 1:
                    continue
                gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
                if gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, c)
        if best is None:
            return -total / (weight + 1) * step
        gain, f, c = best
        gains.setdefault(f, []).append(gain)
        low = x[rows, f] <= c
        return f, c, build(rows[low], g, h, left - 1), build(rows[~low], g, h, left - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = boosting.softmax(margins)
        grown = [
            build(np.arange(len(x)), p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16), depth)
            for k in range(classes)
        ]
        margins += np.array([[value(t, row) for t in grown] for row in x])
    mean = np.array([np.mean(gains.get(f, [0.0])) for f in range(x.shape[1])])
    return margins, mean / mean.sum()


def rows_of(seed, n, classes):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 5)), 1)
    x[:, 3], x[:, 4] = x[:, 3] > 0, 7.0  # a flag and a constant
    y = (x[:, 0] + x[:, 1] * x[:, 3] > 0).astype(int) + (x[:, 2] > 0.8)
    return x, np.minimum(y, classes - 1)


@pytest.mark.parametrize("classes, depth, step", [(2, 3, 0.3), (3, 3, 0.3), (3, 6, 0.1), (4, 1, 1.0)])
def test_equals_the_plain_booster(classes, depth, step):
    x, y = rows_of(classes + depth, 120, classes)
    model = boosting.Boosted(classes, 5, boosting.grow(x, y, classes, 6, depth, step))
    margins, mean = plain(x, y, classes, 6, depth, step)
    assert np.abs(model.margins(x) - margins).max() < 1e-9
    assert model.importances == pytest.approx(mean.tolist())
    assert model.importances[4] == 0.0


def test_cut_points():
    assert boosting.cut_points(np.array([2.0, 1.0, 2.0, 4.0])).tolist() == [1.5, 3.0]
    assert boosting.cut_points(np.array([5.0, 5.0])).tolist() == []
    assert boosting.cut_points(np.array([np.nan, 1.0, 3.0])).tolist() == [2.0]
    many = boosting.cut_points(np.arange(1000.0))
    assert len(many) == boosting.MAX_BINS and (np.diff(many) > 0).all()
    # a value that fills most of the rows is one cut, not many
    assert len(boosting.cut_points(np.concatenate([np.zeros(5000), np.arange(100.0)]))) <= boosting.MAX_BINS


def test_missing_values_go_right():
    x = np.array([[1.0], [2.0], [np.nan], [1.0], [2.0], [np.nan]] * 20)
    y = np.array([0, 1, 1] * 40)
    model = boosting.Boosted(2, 1, boosting.grow(x, y, 2, 20, 2, 0.5))
    assert boosting.softmax(model.margins(x)).argmax(1).tolist() == y.tolist()


@pytest.fixture(scope="module")
def labelled(spark):
    x, y = rows_of(11, 900, 3)
    frame = pd.DataFrame({"id": range(900), "x": x.tolist(), "label": y.astype(float), "prediction": -1.0})
    return spark.createDataFrame(frame).withColumn("features", array_to_vector("x")).drop("x")


def test_fit_and_transform(spark, labelled, tmp_path):
    model = boosting.fit(labelled, trees=15, depth=4, step=0.3)
    again = boosting.fit(labelled.repartition(13), trees=15, depth=4, step=0.3)
    pd.testing.assert_frame_equal(model.nodes, again.nodes)  # however the rows arrive
    scored = model.transform(labelled).select("id", "label", "prediction", "probability").toPandas()
    assert len(scored) == 900 and (scored.label == scored.prediction).mean() > 0.95
    assert np.allclose(np.vstack(scored.probability).sum(1), 1)
    model.save(spark, str(tmp_path / "model"))
    loaded = boosting.load(spark, str(tmp_path / "model"))
    back = loaded.transform(labelled).select("id", "prediction").toPandas()
    assert (back.sort_values("id").prediction.to_numpy() == scored.sort_values("id").prediction.to_numpy()).all()


def test_settings_fit_side_by_side(labelled):
    settings = {"a": {"trees": 5, "depth": 3, "step": 0.3}, "b": {"trees": 7, "depth": 2, "step": 0.1}}
    both = boosting.fit_many(labelled, settings)
    for name, options in settings.items():
        one = boosting.fit(labelled, **options)
        pd.testing.assert_frame_equal(both[name].nodes, one.nodes)
    assert both["b"].nodes["round"].max() == 6


def test_sample_is_bounded(labelled):
    assert boosting.bounded_sample(labelled, "features", "label").count() == 900
    assert 200 <= boosting.bounded_sample(labelled, "features", "label", most=250).count() <= 250
    assert boosting.bounded_sample(labelled, "features", "label", cells=500).count() <= 100
    few = boosting.fit(labelled, trees=5, depth=3, step=0.3, most=300)
    assert few.transform(labelled).count() == 900


def test_odd_tables(spark, labelled):
    none = boosting.fit(labelled.where("id < 0"), trees=3)
    assert none.nodes.empty and none.importances == []
    one = boosting.fit(labelled.where("label = 0"), trees=3, depth=2)
    assert set(one.transform(labelled).select("prediction").distinct().toPandas().prediction) == {0.0}
    unlabelled = labelled.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    assert boosting.bounded_sample(unlabelled, "features", "label").count() == 450
    assert boosting.fit(unlabelled, trees=2, depth=2).transform(unlabelled).count() == 900


def test_only_the_sample_is_stored(labelled, monkeypatch):
    kept = []

    def cut(df):
        kept.append(df.count())
        return df

    monkeypatch.setattr(boosting, "cut", cut)
    boosting.bounded_sample(labelled, "features", "label", most=250)
    assert kept and max(kept) <= 250


def wide_rows(n, classes, odd=False):
    """Rows with a slot of many values; with missing values, if odd."""
    x, y = rows_of(n + classes, n, classes)
    x[:, 4] = np.random.default_rng(n).normal(size=n)
    if odd:
        x[::7, 0] = np.nan
    return x, y


def assert_same_model(got, want):
    order = ["round", "class", "node"]
    a, b = (m.nodes.sort_values(order).reset_index(drop=True) for m in (got, want))
    pd.testing.assert_frame_equal(a, b, rtol=1e-7)


def test_many_rows_are_all_fitted(spark):
    x, y = wide_rows(900, 3)
    frame = spark.createDataFrame(pd.DataFrame({"features": x.tolist(), "label": y}), "features array<double>, label int")
    got = models.train_boosted(frame, trees=5, depth=4, step=0.3, most=250)
    want = boosting.Boosted(3, 5, boosting.grow(x, y, 3, 5, 4, 0.3))
    assert_same_model(got, want)
    assert got.importances == pytest.approx(want.importances)


@pytest.mark.parametrize("limits", [{}, {"KEPT_BYTES": 0}, {"PASS_BYTES": 1}, {"CHECKPOINT_ROUNDS": 2}])
def test_settings_share_passes_over_all_rows(spark, monkeypatch, limits):
    """Several settings on spread rows, whatever is kept, summed at once or written between rounds."""
    for name, value in limits.items():
        monkeypatch.setattr(boosting, name, value)
    x, y = wide_rows(700, 3, odd=True)
    frame = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "label": y}), "x array<double>, label int")
    settings = {"a": {"trees": 4, "depth": 4, "step": 0.3}, "b": {"trees": 2, "depth": 1, "step": 0.1}, "c": {"trees": 1, "depth": 0, "step": 0.1}}
    got = boosting.fit_many(frame, settings, "x", most=100)
    for name, options in settings.items():
        assert_same_model(got[name], boosting.Boosted(3, 5, boosting.grow(x, y, 3, **options)))


@pytest.mark.parametrize("classes", [1, 2, 4])
def test_spread_rows_of_other_class_counts(spark, classes):
    x, y = wide_rows(300, classes)
    frame = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "label": y}), "x array<double>, label int")
    unlabelled = frame.unionByName(frame.withColumn("label", F.lit(None).cast("int")))
    got = boosting.fit(unlabelled, "x", trees=3, depth=3, step=0.3, classes=classes, most=50)
    assert_same_model(got, boosting.Boosted(classes, 5, boosting.grow(x, y, classes, 3, 3, 0.3)))


def test_stability_reads_all_rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 12))
    y = (x[:, :6] @ np.arange(1, 7) + 3 * r.normal(size=800) > 0).astype(int)
    frame = spark.createDataFrame(pd.DataFrame({"features": x.tolist(), "label": y}), "features array<double>, label int")
    names = [f"num__{i}" for i in range(12)]
    configs = {"Baseline": {"depth": 4, "step": 0.3, "trees": 4}, "Shallow": {"depth": 2, "step": 0.3, "trees": 4}, "Again": {"depth": 4, "step": 0.3, "trees": 4, "seed": 9}}

    def found(most):
        rows = models.importance_stability(frame, names, configs, top=5, most=most).collect()
        return {r["config"]: (round(r["spearman"], 9), r["top_overlap"]) for r in rows}

    assert found(100) == found(800)
    assert found(100)["Again"] == (1.0, 1.0)
