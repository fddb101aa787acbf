"""Schema, quality, missing values, roll-ups and sources on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import missing, neighbours, quality, rollup, schema
from hazardloom.sources import files, paged_json


def test_initial_cleaning(spark):
    rows = spark.createDataFrame(
        [(1, None, "a"), (1, None, "a"), (None, None, None), (None, None, "a"), (None, None, "a")], "x int, e string, y string"
    )
    got = quality.clean_initial(rows)
    assert got.columns == ["x", "y"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (None, "a")]


def test_core_columns_last_name_wins(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "`Train  Speed` int, ` train speed` int, other int")
    core, absent = schema.select_core(rows, ["TRAIN SPEED", "Date"])
    assert core.columns == [" train speed"] and absent == ["Date"]


def test_zero_variance(spark):
    rows = spark.createDataFrame([(1, None, 1, None), (1, None, 2, 5)], "a int, b int, c int, d int")
    assert schema.zero_variance_columns(rows) == ["a", "d"]


def test_keep_list_order(spark):
    kept, absent = schema.keep_columns(spark.range(1).selectExpr("id a", "id b"), ["b", "z", "a"])
    assert kept.columns == ["b", "a"] and absent == ["z"]


def test_types(spark):
    rows = spark.range(1).selectExpr("1 a", "'x' b", "true c", "1.5D d", "current_date() e")
    assert schema.split_types(rows) == (["a", "d"], ["b"])


def test_validation(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "p string, q string")
    found = {(r["severity"], r["check"], r["detail"]) for r in quality.validate(rows, ["p", "z"]).collect()}
    assert found == {
        ("issue", "missing_column", "z"), ("warning", "no_numeric_column", ""),
        ("warning", "high_null_column", "q"), ("warning", "duplicate_rows", "1"),
    }
    assert not quality.is_valid(quality.validate(rows, ["z"]))
    assert quality.is_valid(quality.validate(rows, ["p"]))


def test_half_null_is_not_high(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "p string, q int")
    assert quality.validate(rows).isEmpty()


def test_correlation_is_pairwise_complete(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 7.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in quality.correlations(rows).collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(8 / (14 * 42 / 9) ** 0.5)
    assert got[("a", "a")] == pytest.approx(1.0)
    flat = rows.withColumn("c", F.lit(1.0))
    assert {r["corr"] for r in quality.correlations(flat, ["a", "c"]).where("a = 'c'").collect()} == {None}


def test_canonical_tables(spark):
    rows = spark.createDataFrame([("t", "{'a': 1}", "0.5", 1.5)], "`Accident Type` string, evidence_dict string, confidence string, uplift double")
    got = schema.canonical_scenarios(rows).first().asDict()
    assert got == {"accident_type": "t", "evidence": {"a": "1"}, "prob": 0.5, "lift": 1.5, "support_rate": 0.0, "uplift": 1.5}
    imp = schema.canonical_importances(spark.createDataFrame([(" f ", "0.5")], "`Unnamed: 0` string, importance_score string"))
    assert imp.first().asDict() == {"feature_name": "f", "importance_score": 0.5}
    with pytest.raises(ValueError):
        schema.canonical_importances(spark.range(1))
    with pytest.raises(ValueError):
        schema.canonical_scenarios(spark.range(1))


def test_policy_imputation(spark):
    rows = spark.createDataFrame(
        [(None if i == 0 else i, "x" if i > 2 else None, None, None if i < 6 else 1.0) for i in range(20)],
        "n int, t string, e string, h double",
    )
    filled, report = missing.impute_policy(rows)
    assert filled.columns == ["n", "t", "h"]
    assert filled.where("n = 10.0").count() == 2 and filled.where("t = 'UNKNOWN'").count() == 3
    assert filled.where("h is null").count() == 6
    actions = {r["column"]: r["action"] for r in report.collect()}
    assert actions == {"n": "median", "t": "placeholder", "e": "drop", "h": "keep"}


def test_strategies_may_repeat_a_column(spark):
    rows = spark.createDataFrame([(None if i < 3 else "x",) for i in range(10)], "`State Name` string")
    got = [(r["kind"], r["strategy"], r["category"]) for r in missing.suggest_strategies(rows).collect()]
    assert got == [("text", "mode_imputation", None), ("special", "Location_specific", "Location")]
    assert missing.advice(spark).where("strategy = 'drop'").first()["detail"] == "null ratio above 0.95"


def brute_knn(rows, size, k):
    """All pairs, in plain Python."""
    out = {}
    donors = [r for r in rows if r[1] is not None]
    for key, value, *x in rows:
        if value is not None:
            out[key] = float(value)
            continue
        near = []
        for d in donors:
            both = [(a, b) for a, b in zip(x, d[2:]) if a is not None and b is not None]
            if both:
                near.append((sum((a - b) ** 2 for a, b in both) * (size + 1) / len(both), d[0], d[1]))
        near = sorted(near)[:k]
        out[key] = sum(n[2] for n in near) / len(near) if near else sum(d[1] for d in donors) / len(donors)
    return out


@pytest.mark.parametrize("leaf_rows", [None, 1, 8, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_neighbours_against_all_pairs(spark, leaf_rows, seed):
    rng = random.Random(seed)

    def feature(spread):
        return None if rng.random() < 0.15 else float(rng.randrange(spread))

    # a third of the rows share one feature vector
    rows = [
        (i, None if rng.random() < 0.3 else float(rng.randrange(100)), *((5.0, 5.0, 5.0) if i % 3 == 0 else (feature(30), feature(6), feature(900))))
        for i in range(400)
    ]
    rows.append((9999, None, None, None, None))
    df = spark.createDataFrame(rows, "id long, v double, a double, b double, c double")
    got = {r["id"]: r["f"] for r in neighbours.knn_impute(df, "id", "v", ["a", "b", "c"], 5, "f", leaf_rows).collect()}
    want = brute_knn(rows, 3, 5)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_box_bounds_hold_for_boxes_with_missing_coordinates(spark):
    boxes = [
        ("apart", [0.0, 0.0], [1.0, 1.0], [4.0, 0.5], [5.0, 0.7]),
        ("one axis", [0.0, None], [1.0, None], [3.0, 2.0], [5.0, 2.0]),
        ("inside", [0.0, 0.0], [9.0, 9.0], [4.0, 4.0], [5.0, 5.0]),
        ("none", [None, 0.0], [None, 1.0], [2.0, None], [3.0, None]),
    ]
    rows = [(n, n, True, 1, None, a, b, c, d) for n, a, b, c, d in boxes]
    lists = "low array<double>, high array<double>, d_low array<double>, d_high array<double>"
    met = spark.createDataFrame(rows, f"block string, donor_node string, leaf boolean, d_n long, bound double, {lists}")
    got = {r["block"]: (r["near"], r["far"]) for r in neighbours._bounded(met, 2, 2).collect()}
    # squared distances over the common coordinates, scaled to both
    far = {"apart": 5.0**2 + 0.7**2, "one axis": 2 * 5.0**2, "inside": 5.0**2 + 5.0**2}
    near = {"apart": 3.0**2, "one axis": 2 * 2.0**2, "inside": 0.0}
    assert set(got) == set(far)
    for name, (low, high) in got.items():
        assert (low, high) == (pytest.approx(near[name]), pytest.approx(far[name])), name


def test_vectors_with_k_donors_and_more(spark):
    # vectors of 1 to 9 donors, k being 5: the ones above lose their largest keys
    rows = [(100 * a + i, float(i * i), float(a)) for a in range(1, 10) for i in range(a)]
    rows += [(1900 + a, None, float(a)) for a in range(1, 10)] + [(2000 + i, float(i), None) for i in range(7)] + [(3000, None, None)]
    df = spark.createDataFrame(rows, "id long, v double, a double")
    got = {r["id"]: r["f"] for r in neighbours.knn_impute(df, "id", "v", ["a"], 5, "f").collect()}
    want = brute_knn(rows, 1, 5)
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in want)


def test_neighbours_with_fewer_donors_than_k(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (2, 6.0, 2.0), (3, None, 1.5)], "id long, v double, a double")
    got = {r["id"]: r["f"] for r in missing.knn_impute(df, "id", "v", ["a"], 5, "f").collect()}
    assert got == {1: 4.0, 2: 6.0, 3: 5.0}


def test_advanced_imputation_entry_point(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None)], "id long, v double, s string")
    assert missing.advanced_imputation(df, "absent") is df
    assert missing.advanced_imputation(df, "id") is df
    line = missing.advanced_imputation(df, "v", "interpolation", order=["id"])
    assert [r["v"] for r in line.orderBy("id").collect()] == [1.0, 2.0, 3.0] and line.columns == df.columns
    assert missing.advanced_imputation(df, "s", "interpolation", order=["id"]) is df
    text = missing.advanced_imputation(df, "s", "forward_fill", order=["id"])
    assert [r["s"] for r in text.orderBy("id").collect()] == ["a", "b", "b"]
    near = missing.advanced_imputation(df.withColumn("w", F.col("id") * 1.0), "v", "knn", key="id", k=1)
    assert [r["v"] for r in near.orderBy("id").collect()] == [1.0, 1.0, 3.0]
    with pytest.raises(ValueError):
        missing.advanced_imputation(df, "v", "forward_fill")


def test_enrichment(spark):
    target = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    source = spark.createDataFrame([("a", "X"), (None, "N"), ("a", "X"), ("q", "Q")], "k string, state string")
    got = {r["id"]: r["state"] for r in rollup.enrich(target, source, "state", [["k", "day"], ["k"]]).collect()}
    assert got == {1: "X", 2: "N", 3: None}
    clash = spark.createDataFrame([("a", "X"), ("a", "Y")], "k string, state string")
    with pytest.raises(ValueError):
        rollup.enrich(target, clash, "state", [["k"]])
    with pytest.raises(ValueError):
        rollup.enrich(target, source, "absent", [["k"]])
    with pytest.raises(RuntimeError):
        rollup.enrich(target, source, "state", [["day"]])


def test_enrichment_by_position(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, state string")
    source = spark.createDataFrame([(10, "X"), (20, "Y")], "at int, state string")
    got = rollup.enrich(target, source, "state", order_target=["id"], order_source=["at"])
    assert sorted(map(tuple, got.collect())) == [(1, "X"), (2, "Y")]
    with pytest.raises(ValueError):
        rollup.align_by_position(target, source.limit(1), ["id"], ["at"])


def test_crosstab_rows_sum_to_100(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", None), (None, "x")], "r string, c string")
    got = {r["r"]: r.asDict() for r in rollup.percent_crosstab(rows, "r", "c").collect()}
    assert got == {"a": {"r": "a", "x": 33.33, "y": 66.67}}
    full = {r["r"] for r in rollup.percent_crosstab(rows, "r", "c", include_na=True).collect()}
    assert full == {"a", "b", "(Missing)"}


def test_mapping_and_top_groups(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b"), (None, "c")], "code int, name string")
    assert [tuple(r) for r in rollup.code_mapping(rows, "code", "name").collect()] == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in rollup.top_groups(rows, "code", 2).collect()] == [(2, 2), (1, 1)]


def test_file_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'line\nbreak "quoted", comma'), (2, None)], "id int, text string")
    for kind in ("parquet", "csv", "json"):
        path = str(tmp_path / f"t.{kind}")
        files.save_results(rows, path, kind)
        back = files.read_table(spark, path, schema=rows.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        files.read_table(spark, "data.xls")
    with pytest.raises(ValueError):
        files.save_results(rows, str(tmp_path / "x"), "pickle")
    with pytest.raises(ValueError):
        files.load_results(spark, str(tmp_path / "x"), "excel")


def test_safe_save_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "out")
    first = files.safe_save(spark.range(1), path)
    second = files.safe_save(spark.range(2), path)
    assert first == path and second.startswith(path + "_")
    assert spark.read.parquet(first).count() == 1 and spark.read.parquet(second).count() == 2


def test_column_list(spark, tmp_path):
    path = tmp_path / "columns.txt"
    path.write_text("narrative\n\n  time \nclass")
    assert files.read_column_list(spark, str(path)) == ["narrative", "time", "class"]


def test_reports_by_partition(spark, tmp_path):
    root = str(tmp_path / "reports")
    rows = spark.createDataFrame(
        [("CA", "v1", 0.5, 0.5, "A", "t", {"b": "2", "a": "1"}, 0.9), ("TX", "v1", 0.1, 0.9, "A", "t", {"a": "1"}, 0.8)],
        "state string, model_version string, w1 double, w2 double, Class string, accident_type string, evidence map<string,string>, CRI_Score double",
    )
    files.save_class_a(rows, root)
    back = files.load_scenarios(spark, root, "CA")
    row = back.first()
    assert back.count() == 1 and row["scenario_id"] == "t | {'a': '1', 'b': '2'}" and row["w1"] == 0.5
    assert all("state=CA" in f for f in back.inputFiles())
    # a report without scores is skipped, not ranked with nulls
    files.save_class_a(rows.where("state = 'TX'").drop("CRI_Score").withColumn("state", F.lit("NV")), root)
    assert {r["state"] for r in files.load_scenarios(spark, root).select("state").collect()} == {"CA", "TX"}
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        files.load_scenarios(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize("count", [0, 1, 999, 1000, 1001, 5500])
def test_page_count(count):
    provider = paged_json.RecordPages([{"i": i} for i in range(count)])
    assert paged_json.page_count(provider, None, 1000) == -(-count // 1000)


def test_stored_pages_without_a_scheme(spark, tmp_path):
    root = tmp_path / "pages"
    for page in range(3):
        folder = root / "filter=all" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("\n".join(f'{{"i": {page * 10 + j}}}' for j in range(10)))
    found = paged_json.read_pages(spark, paged_json.FolderPages(str(root), 10), "i long", page_size=10)
    assert sorted(r["i"] for r in found.collect()) == list(range(30))
    with pytest.raises(Exception, match="FileNotFound"):
        paged_json.read_pages(spark, paged_json.FolderPages(str(tmp_path / "none"), 10), "i long", page_size=10).count()


def test_paged_source(spark):
    provider = paged_json.RecordPages([{"i": i, "s": "a" if i % 3 else "b"} for i in range(2500)])
    every = paged_json.read_pages(spark, provider, "i long, s string, absent string", page_size=100, partitions=4)
    assert every.count() == 2500 and every.select("i").distinct().count() == 2500
    assert every.rdd.getNumPartitions() == 4
    some = paged_json.read_pages(spark, provider, "i long, s string", where="s='b'")
    assert some.count() == 834
