"""Ordered operators: many buckets must give what one window gives, whatever the skew."""

import random

import pytest
from pyspark.sql import Window, functions as F

from hazardloom.operators import missing, ordered, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' owns a third of the rows; order values repeat; some values are missing."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(200)}" if i % 50 else None
        value = None if rng.random() < 0.4 else float(rng.randrange(20))
        rows.append((group, rng.randrange(40), i, value))
    df = spark.createDataFrame(rows, "g string, t int, id long, v double").repartition(5).cache()
    df.count()
    return df


def window(one_way=True):
    w = Window.partitionBy("g").orderBy("t", "id")
    if one_way:
        return w.rowsBetween(Window.unboundedPreceding, 0)
    return w.rowsBetween(0, Window.unboundedFollowing)


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("size", [17, 250, 10_000])
def test_scans_match_a_plain_window(skewed, size):
    scan = ordered.OrderedRows(skewed, ["g"], ["t", "id"], size)
    got = scan.row_number("n").running_sum(F.coalesce("v", F.lit(0.0)), "s").previous("v", "p").following("v", "f").result()
    want = skewed.select(
        "g", "t", "id", "v",
        F.count(F.lit(1)).over(window()).alias("n"),
        F.sum(F.coalesce("v", F.lit(0.0))).over(window()).alias("s"),
        F.last("v", True).over(window()).alias("p"),
        F.first("v", True).over(window(False)).alias("f"),
    )
    same(got, want)


def test_hot_group_is_cut_into_many_buckets(skewed):
    scan = ordered.OrderedRows(skewed, ["g"], ["t", "id"], 100)
    sizes = scan._base.where("g = 'hot'").groupBy("__path").count().collect()
    assert len(sizes) >= 8
    assert max(r["count"] for r in sizes) <= 100


def test_carry_has_fewer_rows_than_leaves(skewed):
    scan = ordered.OrderedRows(skewed, ["g"], ["t", "id"], 100)
    leaves = scan._base.where("size(__path) > 0").select("__path").distinct().count()
    assert 8 <= scan._carry(F.count(F.lit(1)), F.sum, False).count() < leaves


def test_one_order_value_for_all_rows_is_still_cut(spark):
    rows = spark.range(2000).select(F.lit(1.0).alias("score"), "id")
    scan = ordered.OrderedRows(rows, [], [-F.col("score"), "id"], 100)
    assert scan._base.select("__path").distinct().count() > 10
    got = scan.row_number("n").result()
    assert got.where("n <> id + 1").isEmpty()


def test_rows_equal_in_every_key_are_dealt_out(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id").where("id <> 7")
    scan = ordered.OrderedRows(rows, [], ["k"], 100)
    sizes = [r["count"] for r in scan._base.groupBy("__path").count().collect()]
    assert max(sizes) <= 100 and len(sizes) >= 30
    got = scan.row_number("n").running_sum(F.lit(1), "s").result()
    assert got.count() == got.select("n").distinct().count() == rows.count() and got.where("n <> s").isEmpty()
    first = rows.where("k < 7").count()
    hot = got.where("k = 7").agg(F.min("n"), F.max("n"), F.count("n")).first()
    assert tuple(hot) == (first + 1, first + 1000, 1000)


@pytest.mark.parametrize("kind", ["string", "double", "date", "boolean", "decimal(20,3)", "binary", "bigint"])
def test_keys_of_every_kind(spark, kind):
    rng = random.Random(4)
    if kind == "boolean":
        values = [None, True, False]
    elif kind in ("string", "binary"):
        values = [None, "", "a", "ab", "abc", "ab\u00e9", "ab\U0001f600", "ab\uffee", "b", "common/prefix/x", "common/prefix/xy", "common/prefix/", "Z"]
    elif kind == "date":
        values = [None, *[f"20{rng.randrange(10, 25)}-0{rng.randrange(1, 9)}-11" for _ in range(60)]]
    else:
        values = [None, "0", "-1", "1000000000000", "-99999", *[str(rng.randrange(-50, 50)) for _ in range(40)]]
    rows = [(i, rng.choice(values)) for i in range(1200)]
    df = spark.createDataFrame(rows, f"id long, k {'boolean' if kind == 'boolean' else 'string'}").select("id", F.col("k").cast(kind).alias("k"))
    got = ordered.OrderedRows(df, [], ["k", "id"], 40).row_number("n").result()
    want = df.select("id", F.row_number().over(Window.orderBy("k", "id")).cast("long").alias("n"))
    same(got.select("id", "n"), want)


def test_input_is_run_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 1000, 1, 4).mapInArrow(seen, "id long")
    assert ordered.OrderedRows(rows, [], ["id"], 50).row_number("n").result().count() == 1000
    assert runs.value == 1000
    line = rows.withColumn("v", F.when(F.col("id") % 7 == 0, F.col("id").cast("double")))
    assert missing.interpolate(line, "v", ["id"], [], rows_per_bucket=100).count() == 1000
    assert runs.value == 2000


def test_leaf_size_follows_bytes_and_cores():
    assert ordered.leaf_size(1000, 100.0, 8) == ordered.LEAST_BYTES // 100
    assert ordered.leaf_size(10**12, 100.0, 8) == ordered.MOST_BYTES // 100
    assert ordered.leaf_size(10**7, 100.0, 20) == 10**7 // 40


def test_average_rank_and_competition_rank(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 3.0)], "g string, x double")
    got = sorted((r["g"], r["x"], r["r"]) for r in ordered.average_rank(rows, ["g"], "x", "r").collect())
    assert got == [("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 5.0, 4.0), ("b", 3.0, 1.0)]
    got = sorted((r["g"], r["x"], r["r"]) for r in ordered.competition_rank(rows, ["g"], "x", "r").collect())
    assert got == [("a", 1.0, 4), ("a", 2.0, 2), ("a", 2.0, 2), ("a", 5.0, 1), ("b", 3.0, 1)]


def test_fills_on_the_hand_made_series(spark):
    rows = spark.createDataFrame(list(enumerate([None, 1.0, None, 3.0, None])), "i int, v double")

    def values(df, name):
        return [r[name] for r in df.orderBy("i").collect()]

    assert values(missing.fill_forward(rows, "v", ["i"], []), "v_ffill") == [None, 1, 1, 3, 3]
    assert values(missing.fill_backward(rows, "v", ["i"], []), "v_bfill") == [1, 1, 3, 3, None]
    assert values(missing.interpolate(rows, "v", ["i"], []), "v_linear") == [None, 1, 2, 3, 3]


def test_forward_then_backward_leaves_no_gap(skewed):
    filled = missing.fill_forward(skewed, "v", ["t", "id"], ["g"], "v1", 100)
    filled = missing.fill_backward(filled, "v1", ["t", "id"], ["g"], "v2", 100)
    empty = skewed.groupBy("g").agg(F.count("v").alias("n")).where("n = 0")
    assert filled.where("v2 is null").join(empty, filled["g"].eqNullSafe(empty["g"]), "left_anti").isEmpty()


def test_interpolation_in_buckets(skewed):
    a = missing.interpolate(skewed, "v", ["t", "id"], ["g"], rows_per_bucket=60)
    b = missing.interpolate(skewed, "v", ["t", "id"], ["g"])
    same(a.withColumn("v_linear", F.round("v_linear", 9)), b.withColumn("v_linear", F.round("v_linear", 9)))


@pytest.mark.parametrize("size", [None, 50])
def test_quantiles_are_exact(spark, size):
    import numpy as np

    rng = random.Random(3)
    data = [(rng.gauss(0, 5), float(rng.randrange(4)), None if i % 3 else 1.0) for i in range(4001)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in
           quantiles.exact_quantiles(df, ["a", "b", "c"], probs, size).collect()}
    for i, name in enumerate("abc"):
        column = [row[i] for row in data if row[i] is not None]
        for p in probs:
            assert got[(name, p)] == pytest.approx(float(np.quantile(column, p)))


def test_quantiles_of_the_fixture(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x int")
    got = {r["prob"]: r["value"] for r in quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
    assert got == {0.25: 1.75, 0.5: 2.5, 0.75: 4.75}


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]).collect() == []


def test_quantiles_fall_back_when_a_range_misses(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    stats = {"__n0": 1000, "__q0": [50.0, 51.0]}
    got = quantiles.exact_quantiles(df, ["x"], [0.5], stats=stats).first()["value"]
    assert got == 499.5


def test_quantiles_of_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),)] * 3 + [(1.0,), (float("-inf"),), (float("nan"),)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]).first()["value"] == float("inf")


def test_modes_prefer_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("b", None), ("a", "y"), (None, None)], "p string, q string")
    got = {r["column"]: (r["value"], r["n"]) for r in quantiles.modes(df, ["p", "q"]).collect()}
    assert got == {"p": ("a", 2), "q": ("y", 2)}


def test_value_counts_beyond_one_batch_of_columns(spark):
    wide = spark.range(10).select(*[(F.col("id") % (i % 3 + 1)).alias(f"c{i}") for i in range(70)])
    counts = quantiles.value_counts(wide, wide.columns).groupBy("column").agg(F.sum("n").alias("n"), F.count("value").alias("d"))
    for r in counts.collect():
        assert r["n"] == 10 and r["d"] == int(r["column"][1:]) % 3 + 1


def test_rows_without_a_group_are_kept(spark):
    from hazardloom.operators import pareto, scenarios

    rows = spark.createDataFrame([(None, "a", 1.0), (None, "b", 3.0), ("x", "c", None)], "g string, scenario_id string, s double")
    assert scenarios.min_max(rows, "s", "n", ["g"]).count() == 3
    got = {r["scenario_id"]: r["r"] for r in ordered.competition_rank(rows, ["g"], "s", "r").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}
    shares = {r["scenario_id"]: r["cumulative_percentage"] for r in pareto.running_share(rows, "s", ["g"]).collect()}
    assert shares == {"a": 1.0, "b": 0.75, "c": None}
