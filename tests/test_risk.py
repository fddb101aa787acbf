"""Rules, scenarios, rankings, fusion, sequences and models on small frames."""

import bisect
import itertools
import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hazardloom.operators import (
    features,
    fusion,
    models,
    pareto,
    report,
    rules,
    scenarios,
    sequences,
    stability,
)


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(["a", "b", "c"],), (["a", "b", "c"],), (["a", "b"],), (["c"],), ([],)]
    return spark.createDataFrame(rows, "items array<string>")


def as_dict(itemsets):
    return {tuple(r["items"]): r["support"] for r in itemsets.collect()}


def test_item_sets(tiny):
    got = as_dict(rules.frequent_itemsets(tiny, 0.5))
    assert got == {("a",): 0.75, ("b",): 0.75, ("c",): 0.75, ("a", "b"): 0.75, ("a", "c"): 0.5, ("b", "c"): 0.5, ("a", "b", "c"): 0.5}
    assert as_dict(rules.frequent_itemsets(tiny, 0.6, max_len=1)).keys() == {("a",), ("b",), ("c",)}
    assert as_dict(rules.frequent_itemsets(tiny, 0.9)) == {}


def test_rules_of_every_split(tiny):
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): r for r in
           rules.association_rules(rules.frequent_itemsets(tiny, 0.5), 0.0).collect()}
    assert len(got) == 3 * 2 + 6
    r = got[(("a",), ("b", "c"))]
    assert r["confidence"] == pytest.approx(2 / 3) and r["lift"] == pytest.approx(4 / 3)
    assert r["leverage"] == pytest.approx(0.5 - 0.375) and r["conviction"] == pytest.approx(0.5 / (1 / 3))
    assert got[(("a",), ("b",))]["conviction"] == float("inf")


def test_item_sets_against_brute_force(spark):
    rng = random.Random(5)
    data = [[f"i{j}" for j in range(7) if rng.random() < 0.5] for _ in range(200)]
    got = as_dict(rules.frequent_itemsets(spark.createDataFrame([(d,) for d in data], "items array<string>"), 0.1))
    filled = [set(d) for d in data if d]
    want = {}
    for n in range(1, 8):
        for items in itertools.combinations([f"i{j}" for j in range(7)], n):
            share = sum(set(items) <= d for d in filled) / len(filled)
            if share >= 0.1:
                want[items] = share
    assert got == pytest.approx(want)
    for items, share in got.items():
        for part in itertools.combinations(items, len(items) - 1):
            assert not part or got[part] >= share


def test_rules_of_a_long_item_set(spark):
    """13 items, all in every row: each split of each set is a rule of confidence 1."""
    names = [f"i{j:02}" for j in range(13)]
    one = spark.createDataFrame([(names,)], "items array<string>")
    sets = rules.frequent_itemsets(one, 1.0)
    assert sets.count() == 2**13 - 1
    # only the splits whose sides are listed are rules: twelve items against one
    found = rules.association_rules(sets.where("size(items) >= 12 or size(items) = 1"), 0.5)
    assert found.count() == 13 and found.where("size(antecedent) = 12 and confidence = 1").count() == 13


def test_infrequent_items_are_not_extended(spark):
    rows = spark.createDataFrame([([f"c{j}" for j in range(3)] + [f"u{i}_{j}" for j in range(20)],) for i in range(50)], "items array<string>")
    found = rules.frequent_itemsets(rows, 0.5)
    assert found.count() == 7


def test_transactions_skip_blanks(spark):
    rows = spark.createDataFrame([(1, "x", None, 2.0), (2, "", None, None)], "id int, a string, b string, c double")
    got = [tuple(r) for r in rules.transactions(rows, ["id"], ["a", "b", "c"]).collect()]
    assert got == [(1, ["a_x", "c_2.0"])]


def test_one_call_mining(spark):
    rows = spark.createDataFrame([("x", "p")] * 6 + [("y", "q")] * 4, "a string, b string")
    mined = rules.mine_patterns(rows, ["a", "b"])
    summary = mined.summary.first()
    assert summary["total_rules"] == 4 and summary["avg_confidence"] == 1.0
    assert mined.top.first()["antecedent"] == ["a_x"] and mined.itemsets.count() == 6


def test_risk_of_combinations(spark):
    rows = spark.createDataFrame([("x", "bad")] * 3 + [("x", "ok")] * 1 + [("y", "ok")] * 4, "c string, t string")
    got = {(r["accident_type"], r["evidence"]["c"]): r for r in rules.risk_combinations(rows, ["c"], "t").collect()}
    r = got[("bad", "x")]
    assert (r["support_rate"], r["prob"], r["lift"], r["uplift"]) == (0.5, 0.75, 2.0, 0.375)
    assert r["scenario_id"] == "bad | {'c': 'x'}" and ("bad", "y") not in got
    with pytest.raises(ValueError):
        rules.risk_combinations(rows, ["c"], "t", min_support=2.0)


@pytest.fixture(scope="module")
def imp(spark):
    return spark.createDataFrame(
        [("cat__Equipment Type_Freight Train", 0.052), ("num__trainspeed", 0.3), ("cat__tracktype_Main", 0.1),
         ("cat__tracktype_Yard", 0.2), ("raw", 0.7)],
        "feature_name string, importance_score double",
    )


def test_two_tier_lookup_and_details(spark, imp):
    rows = spark.createDataFrame(
        [("s1", {"Equipment Type": "Freight Train", "Train Speed": "fast", "Zone": "7"}), ("s2", {})],
        "scenario_id string, evidence map<string,string>",
    )
    got = {r["scenario_id"]: r for r in scenarios.scenario_importance(rows, imp).collect()}
    assert got["s1"]["s2_2_importance"] == pytest.approx((0.052 + 0.3) / 3)
    assert got["s1"]["matched_details"] == "Equipment Type=Freight Train(Score:0.0520); Train Speed(Score:0.3000); Zone=7(N/A)"
    assert got["s2"]["s2_2_importance"] == 0.0 and got["s2"]["matched_details"] == ""
    rate = scenarios.match_rate(scenarios.lookup_two_tier(scenarios.conditions(rows), imp)).first()
    assert (rate["processed"], rate["matched"], rate["low"]) == (3, 2, False)
    none = scenarios.match_rate(scenarios.lookup_two_tier(scenarios.conditions(rows.where("false")), imp)).first()
    assert none["match_rate"] == 0.0


def test_last_of_equal_keys_counts(spark):
    imp = spark.createDataFrame([("a b", 0.5, 1), ("AB", 0.9, 2)], "feature_name string, importance_score double, at int")
    assert scenarios.importance_lookup(imp, "at").first()["importance"] == 0.9
    assert scenarios.importance_lookup(imp).first()["importance"] == 0.5


def test_three_tier_lookup(spark, imp):
    names = spark.createDataFrame([("raw",), ("Train Speed",), ("Track Type",), ("Track",), ("none",)], "name string")
    got = {r["name"]: r["importance"] for r in scenarios.lookup_three_tier(names, imp).collect()}
    assert got == {"raw": 0.7, "Train Speed": 0.3, "Track Type": 0.2, "Track": 0.0, "none": 0.0}


def test_lookup_joins_are_broadcast_after_measuring(spark, imp):
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"), F.hex("id").alias("v"))
    plan = scenarios.lookup_two_tier(rows, imp)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_min_max(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 6.0), ("b", 1.0)], "g string, x double")
    got = sorted((r["g"], r["x"], r["n"]) for r in scenarios.min_max(rows, "x", "n", ["g"]).collect())
    assert got == [("a", 2.0, 0.0), ("a", 4.0, 0.5), ("a", 6.0, 1.0), ("b", 1.0, None)]
    got = sorted(r["n"] for r in scenarios.min_max(rows, "x", "n").collect())
    assert got == pytest.approx([0.0, 0.2, 0.6, 1.0])


def scored(spark, values, state="s"):
    return spark.createDataFrame([(state, f"id{i}", v) for i, v in enumerate(values)], "state string, scenario_id string, CRI_Score double")


@pytest.mark.parametrize("size", [None, 2])
@pytest.mark.parametrize("values, classes", [([50.0, 30.0, 15.0, 5.0], "AACC"), ([90.0, 10.0], "BC"), ([40.0, 40.0, 10.0, 10.0], "AABC")])
def test_abc_classes(spark, values, classes, size):
    got = pareto.pareto(scored(spark, values), by=["state"], rows_per_bucket=size).orderBy(F.desc("CRI_Score"), "scenario_id").collect()
    assert "".join(r["Class"] for r in got) == classes
    assert got[-1]["cumulative_percentage"] == pytest.approx(1.0)
    counts = pareto.class_counts(pareto.pareto(scored(spark, values)))
    assert sum(r["n"] for r in counts.collect()) == len(values)


def test_negative_scores_can_be_clamped(spark):
    got = pareto.pareto(scored(spark, [3.0, 1.0, -2.0]), clamp=True).collect()
    assert max(r["cumulative_percentage"] for r in got) == pytest.approx(1.0)
    assert min(r["CRI_Score"] for r in got) == 0.0


def test_constant_scores_are_flagged(spark):
    rows = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.3, 0.5)], "scenario_id string, uplift double, s2_2_importance double")
    got = {r["scenario_id"]: r for r in scenarios.cri(rows).collect()}
    assert got["b"]["CRI_Score"] == 0.5 and got["a"]["CRI_Score"] == 0.0 and got["a"]["is_constant"]


def test_spearman(spark):
    rows = spark.createDataFrame([("g", float(i), float(i * i)) for i in range(8)] + [("h", 1.0, 2.0), ("h", 2.0, 2.0)], "g string, a double, b double")
    got = {r["g"]: r["corr"] for r in stability.spearman(rows, "a", "b", ["g"]).collect()}
    assert got["g"] == pytest.approx(1.0) and got["h"] is None
    got = {r["g"]: r["corr"] for r in stability.spearman(rows, "a", "b", ["g"], 5).collect()}
    assert got["h"] == 0.0


def sweep(spark):
    rows = []
    for w1, w2 in scenarios.WEIGHTS:
        for i in range(30):
            rows.append(("s", w1, w2, f"id{i:02}", "t", w1 * i + w2 * ((i * 7) % 30)))
    return spark.createDataFrame(rows, "state string, w1 double, w2 double, scenario_id string, accident_type string, CRI_Score double")


@pytest.mark.parametrize("size", [None, 20])
def test_stability_of_rankings(spark, size):
    got = {r["Rule_Weight"]: r for r in stability.stability(sweep(spark), rows_per_bucket=size).collect()}
    assert len(got) == 5 and got[0.5]["Spearman_Corr"] == pytest.approx(1.0) and got[0.5]["Top20_Overlap"] == 1.0
    assert all(0 <= r["Top20_Overlap"] <= 1 for r in got.values()) and got[0.9]["Spearman_Corr"] < 1
    wide = stability.stability_matrix(stability.stability(sweep(spark)))
    assert wide.count() == 1 and len(wide.columns) == 6


def test_no_baseline_no_rows(spark):
    assert stability.stability(sweep(spark).where("w1 <> 0.5")).isEmpty()


def test_missing_scenarios_get_a_default_rank(spark):
    rows = sweep(spark)
    best = stability.rank_trajectory(rows).where("w1 = 0.5 and Rank = 1").first()["scenario_id"]
    cut = rows.where(~((F.col("w1") == 0.9) & (F.col("scenario_id") == best)))
    got = stability.rank_trajectory(cut).where((F.col("w1") == 0.9) & (F.col("scenario_id") == best)).first()
    assert got["Rank"] == 29 + 5 and got["label"] == "#1: t"
    assert stability.rank_trajectory(rows).count() == 25


def test_narrative(spark):
    rows = spark.createDataFrame(
        [("Derailment", "x1", {"Track Type": "Main", "Equipment Type": "Cut"}, 0.125, "Track Type=Main(Score:0.1000); Equipment Type=Cut(N/A)", 0.9),
         ("Derailment", "x2", {"Equipment Type": "Cut"}, 0.1, "Equipment Type=Cut(N/A)", 0.8),
         ("Derailment", "x3", {"Zone": "1"}, 0.1, "", 0.7)],
        "accident_type string, scenario_id string, evidence map<string,string>, uplift double, matched_details string, CRI_Score double",
    )
    got = [r["narrative"] for r in report.narratives(rows).orderBy("position").collect()]
    assert got[0].split("\n") == [
        report.SCENE % 1, report.PATTERN % (report.CONDITION % ("Equipment Type", "Cut") + report.JOINER + report.CONDITION % ("Track Type", "Main")),
        report.SUPPORT % 12.5, report.CAUSES, report.CAUSE % "Track Type=Main(Score:0.1000)", report.TRACK_ADVICE % "Main",
    ]
    assert got[1].split("\n")[-1] == report.EQUIPMENT_ADVICE % "Cut"
    assert got[2].split("\n")[-1] == report.CAUSES


def test_fusion_methods(spark):
    rows = spark.createDataFrame([("a", 0.0, 10.0), ("b", 1.0, 20.0), ("c", 2.0, 0.0)], "id string, p double, q double")
    weights = {"p": 0.75, "q": 0.25}

    def fused(method):
        return {r["id"]: (r["fused_score"], r["rank"]) for r in fusion.fuse_scores(rows, method=method, weights=weights).collect()}

    assert fused("weighted_average") == {"a": (0.125, 3), "b": (0.625, 2), "c": (0.75, 1)}
    assert fused("max") == {"a": (0.5, 3), "b": (1.0, 1), "c": (1.0, 1)}
    assert fused("min") == {"a": (0.0, 2), "b": (0.5, 1), "c": (0.0, 2)}
    assert fused("ensemble")["b"][0] == pytest.approx((0.625 + 1.0 + 0.5) / 3)
    with pytest.raises(ValueError):
        fusion.fuse_scores(rows, method="median", weights=weights)
    with pytest.raises(ValueError):
        fusion.rank_priority(rows.withColumn("fused_score", F.lit(0.5)), "other")


def test_levels(spark):
    rows = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.1,)], "fused_score double")
    got = [r[0] for r in rows.select(fusion.risk_level("fused_score")).collect()]
    assert got == ["high", "medium", "medium", "low"]


@pytest.fixture(scope="module")
def small_scenarios(spark):
    return spark.createDataFrame(
        [("s1", "t", {"b": "2", "a": "1"}, 0.5, 2.0, 0.1, 0.2), ("s2", "t", {"a": "1"}, 0.25, 1.0, 0.3, -2.0)],
        "scenario_id string, accident_type string, evidence map<string,string>, prob double, lift double, support_rate double, uplift double",
    )


def test_sequences_are_padded_and_cut(spark, small_scenarios):
    imp = spark.createDataFrame([("a", 0.5)], "feature_name string, importance_score double")
    vocab = sequences.vocabulary(sequences.token_rows(small_scenarios))
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "AccidentType=t": 2, "a=1": 3, "b=2": 4}
    got = {r["scenario_id"]: r for r in sequences.sequences(small_scenarios, imp, length=4).collect()}
    assert got["s1"]["token_ids"] == [2, 3, 4, 0] and got["s1"]["mask"] == [True, True, True, False]
    assert got["s1"]["numeric"] == [[0.5, 2.0, 0.1, 0.0], [0.5, 2.0, 0.1, 0.5], [0.5, 2.0, 0.1, 0.0], [0.0] * 4]
    assert got["s2"]["token_ids"] == [2, 3, 0, 0] and got["s2"]["label"] == 0.25
    assert sequences.sequences(small_scenarios, imp, length=2).where("scenario_id = 's1'").first()["token_ids"] == [2, 3]
    known = spark.createDataFrame([("a=1", 7)], "token string, token_id int")
    got = sequences.sequences(small_scenarios, imp, known, length=3).where("scenario_id = 's1'").first()
    assert got["token_ids"] == [1, 7, 1]
    with pytest.raises(ValueError):
        sequences.sequences(small_scenarios, imp, length=0)


def test_weak_labels(small_scenarios):
    got = [r[0] for r in small_scenarios.orderBy("scenario_id").select(sequences.weak_label("uplift", "log1p")).collect()]
    assert got == pytest.approx([0.1823215567, -13.815510558])
    for kind, change in (("x", "none"), ("prob", "sqrt")):
        with pytest.raises(ValueError):
            sequences.weak_label(kind, change)


def test_standardized_tokens(spark, small_scenarios):
    imp = spark.createDataFrame([("zzz", 0.5)], "feature_name string, importance_score double")
    seq = sequences.sequences(small_scenarios, imp, length=4)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in sequences.token_statistics(seq).collect()}
    assert stats["prob"][0] == pytest.approx((3 * 0.5 + 2 * 0.25) / 5) and stats["importance"] == (0.0, 1e-6)
    again = {r["feature"]: (r["mean"], r["std"]) for r in sequences.token_statistics(sequences.standardize_tokens(seq)).collect()}
    assert again["prob"] == pytest.approx((0.0, 1.0), abs=1e-9)


def test_one_hot_rows_sum_to_one(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, i int")
    got = {r["i"]: r for r in features.encode_categorical(rows, ["c"]).collect()}
    assert [got[i]["c_a"] + got[i]["c_b"] for i in (1, 2, 3)] == [1, 1, 0]
    assert [got[i]["c_encoded"] for i in (1, 2, 3)] == [0, 1, 2]


def test_many_categories(spark):
    wide = spark.range(1001).select(F.format_string("v%04d", "id").alias("c"), "id")
    out = features.encode_categorical(wide, ["c"])
    assert len(out.columns) == 2 + 1001 + 1
    row = out.where("id = 77").select("c_v0077", "c_v0078", "c_encoded").first()
    assert tuple(row) == (True, False, 77)


def test_codes_of_a_column_with_very_many_values(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, F.format_string("x%06d", F.col("id") * 7 % 20_011)).alias("c"))
    out = features.encode_categorical(rows, ["c"], columns=False, rows_per_bucket=3000)
    assert out.columns == ["id", "c", "c_encoded", "c_indicators"]
    want = sorted({"nan" if r["c"] is None else r["c"] for r in rows.collect()})
    code = {v: i for i, v in enumerate(want)}
    for r in out.collect():
        assert r["c_encoded"] == code[r["c"] or "nan"]
        assert r["c_indicators"].size == len(want)
        assert r["c_indicators"].indices.tolist() == ([] if r["c"] is None else [r["c_encoded"]])


def test_codes_where_nan_is_a_value(spark):
    rows = spark.createDataFrame([(1, "nan"), (2, None), (3, "a"), (4, "z")], "i int, c string")
    got = {r["i"]: r for r in features.encode_categorical(rows, ["c"], columns=False).collect()}
    assert [got[i]["c_encoded"] for i in (1, 2, 3, 4)] == [1, 1, 0, 2]
    assert [got[i]["c_indicators"].toArray().sum() for i in (1, 2, 3, 4)] == [1, 0, 1, 1]
    empty = features.encode_categorical(rows.where("i < 0"), ["c"], columns=False)
    assert empty.collect() == []


def test_hashed_vectors_read_the_whole_text(spark):
    rows = spark.createDataFrame([(1, "a " * 4096 + "tail"), (2, "a")], "id int, t string")
    got = {r["row_id"]: r["embedding"] for r in features.embed_text(rows, "id", "t", size=4096).collect()}
    assert sum(x != 0 for x in got[1]) > sum(x != 0 for x in got[2])


def test_auc_is_exact(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3), [rng.random() + 0.2 * (k == 0) for k in range(3)]) for _ in range(3000)]
    got = {r["class"]: r["auc"] for r in models.auc_per_class(spark.createDataFrame(rows, "label int, p array<double>"), 3, "label", "p").collect()}
    for k in range(3):
        hits = sorted(p[k] for y, p in rows if y == k)
        misses = sorted(p[k] for y, p in rows if y != k)
        wins = sum(bisect.bisect_left(misses, h) + 0.5 * (bisect.bisect_right(misses, h) - bisect.bisect_left(misses, h)) for h in hits)
        assert got[str(k)] == pytest.approx(wins / len(hits) / len(misses), abs=1e-12)
    assert got["macro"] == pytest.approx(sum(got[str(k)] for k in range(3)) / 3)


def test_preprocessing(spark):
    rows = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, None), (None, 5.0, "y"), (2.0, None, "x")], "a double, k double, c string")
    out, names = features.preprocess(rows, ["a", "k"], ["c"])
    assert names == ["num__a", "num__k", "cat__c_x", "cat__c_y"]
    got = sorted(map(tuple, (r["v"] for r in out.select(vector_to_array("features").alias("v")).collect())))
    assert got == [(0.0, 0.0, 1.0, 0.0), (0.5, 0.0, 0.0, 1.0), (0.5, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 0.0)]


def test_numeric_features(spark):
    rows = spark.createDataFrame([(0.0, 7.0), (3.0, 7.0), (-2.0, 7.0)], "x double, c double")
    got = features.numeric_features(rows, ["x", "c", "absent"]).collect()
    assert [r["x_log"] is None for r in got] == [False, False, True] and [r["x_sqrt"] is None for r in got] == [False, False, True]
    assert {r["c_scaled"] for r in got} == {0.0}
    assert sum(r["x_scaled"] ** 2 for r in got) == pytest.approx(3.0)


def test_anova_by_hand(spark):
    rows = spark.createDataFrame([("a", 1.0, 9.0), ("a", 2.0, 9.0), ("b", 4.0, 9.0), ("b", 5.0, 8.0)], "t string, x double, y double")
    got = {r["feature"]: r["f_value"] for r in features.anova_f(rows, "t", ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(18.0) and got["y"] == pytest.approx(1.0)
    assert features.select_k_best(rows, "t", ["x", "y"], 1) == ["x"]


@pytest.mark.parametrize("size", [None, 13])
def test_splits_are_exact(spark, size):
    rows = spark.range(200).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("t"))
    got = {(r["t"], r["is_test"]): r["count"] for r in features.stratified_split(rows, "t", ["id"], 0.25, 1, size).groupBy("t", "is_test").count().collect()}
    assert got == {("rare", True): 5, ("rare", False): 15, ("common", True): 45, ("common", False): 135}
    assert features.split(rows, ["id"], 0.2, 3, size).where("is_validation").count() == 40
    assert features.split(rows.limit(2), ["id"], 0.01).where("is_validation").count() == 1
    a = features.split(rows, ["id"], 0.2, 3, size).where("is_validation").select("id")
    b = features.split(rows.repartition(7), ["id"], 0.2, 3).where("is_validation").select("id")
    assert a.exceptAll(b).isEmpty()
    with pytest.raises(ValueError):
        features.split(rows, ["id"], 1.0)


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((i, [a, b, c], float((a > 0.6) + (a > 0.6 and b > 0.5))))
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.select("id", array_to_vector("x").alias("features"), "label").cache()


@pytest.mark.parametrize("kind, options", [("random_forest", {"trees": 10, "depth": 5}), ("gradient_boosting", {"trees": 5}), ("logistic_regression", {"max_iter": 50})])
def test_models_beat_the_majority(training, kind, options):
    names = ["num__a", "num__b", "num__c"]
    got, imp = models.train_and_evaluate(training.where("id % 4 > 0"), training.where("id % 4 = 0"), names, kind, **options)
    accuracy = got.where("class = 'accuracy'").first()["f1"]
    assert accuracy > 0.75
    scores = {r["feature_name"]: r["importance_score"] for r in imp.collect()}
    assert all(v >= 0 for v in scores.values()) and sum(scores.values()) == pytest.approx(1.0)
    assert scores["num__c"] == min(scores.values())


def test_unknown_model_kind(training):
    with pytest.raises(ValueError):
        models.train_and_evaluate(training, training, ["a", "b", "c"], "svm")


def test_importances_hide_text_features(spark, training):
    model = models.train_forest(training, trees=3, depth=3)
    table = models.importance_table(spark, model, ["num__a", "num__b"])
    assert sorted(r["feature_name"] for r in table.collect()) == ["num__a", "num__b"]
    assert models.importance_table(spark, model, ["num__a", "num__b"], None).count() == 3


def test_forest_and_regression_take_all_rows(spark):
    rows = spark.range(60_000).select(F.array(F.col("id") % 7 + 0.0, F.col("id") + 0.0).alias("features"), F.when(F.col("id") > 0, F.col("id") % 2).alias("label"))
    assert models.spread(rows).count() == 59_999


def test_forest_thresholds_come_from_all_rows(spark):
    """A value of a few rows among many is split off: a sample of 10,000 rows would hardly have it."""
    x = F.when(F.col("id") % 10_000 == 0, 2.0).when(F.col("id") % 2 == 0, 1.0).otherwise(3.0)
    rows = spark.range(60_000).select(F.array(x).alias("features"), (F.col("id") % 10_000 == 0).cast("int").alias("label"))
    model = models.train_forest(rows, trees=5, depth=3)
    assert [c.tolist() for c in model.cuts] == [[1.5, 2.5]]
    said = model.transform(rows.withColumn("features", array_to_vector("features")))
    assert said.where("prediction = 1").count() == said.where("prediction = label and label = 1").count() == 6


def test_report_with_a_class_never_predicted(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")], "label string, prediction string")
    got = {r["class"]: r for r in models.classification_report(pred).collect()}
    assert got["a"]["precision"] == pytest.approx(2 / 3) and got["a"]["recall"] == 1.0
    assert got["b"]["precision"] == got["b"]["recall"] == got["b"]["f1"] == 0.0 and got["b"]["support"] == 1
    assert got["accuracy"]["f1"] == 0.75 and got["macro avg"]["recall"] == pytest.approx(2 / 3)
    assert got["weighted avg"]["recall"] == pytest.approx(0.75)


def test_learned_index_covers_every_scenario(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", "t", {"a": str(i % 4), "b": str(i % 3)}, rng.random(), 1.0, 0.1, (i % 4) / 10) for i in range(120)]
    df = spark.createDataFrame(
        rows, "scenario_id string, accident_type string, evidence map<string,string>, prob double, lift double, support_rate double, uplift double")
    imp = spark.createDataFrame([("a", 0.5)], "feature_name string, importance_score double")
    seq = sequences.sequences(df, imp, length=4, label=sequences.weak_label("uplift"))
    got = sequences.learned_cri(seq, trees=10, depth=3, leave_out="lift").collect()
    assert len(got) == 120 and sum(r["is_validation"] for r in got) == 24
    assert sum((r["CRI_Learned"] - r["label"]) ** 2 for r in got) / 120 < 0.005


def test_encoder_hook_sees_batches(spark):
    rows = spark.createDataFrame([(i, f"w{i} x y z") for i in range(40)], "id long, t string").repartition(3)

    def encoder():
        def encode(texts):
            assert len(texts) <= 16
            return [[float(len(t.split())), 1.0] for t in texts]

        return encode

    got = features.embed_text(rows, "id", "t", encoder, limit=3).collect()
    assert len(got) == 40 and {tuple(r["embedding"]) for r in got} == {(3.0, 1.0)}


def test_split_orders_only_the_rows_at_the_end_of_a_share(spark, monkeypatch):
    """All other rows are settled by counts; equal and missing keys still give exact shares."""
    seen = []

    class Watched(features.OrderedRows):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self.count)

    monkeypatch.setattr(features, "OrderedRows", Watched)
    rows = spark.range(20_000).select("id", (F.col("id") % 3).alias("t"))
    assert features.stratified_split(rows, "t", ["id"]).where("is_test").count() == 5001
    assert features.split(rows, ["id"]).where("is_validation").count() == 4000
    assert len(seen) == 2 and max(seen) < 500
    repeated = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.lit(7)).alias("id"), F.when(F.col("id") % 2 == 0, "a").alias("t"))
    got = features.stratified_split(repeated, "t", ["id"], 0.3).groupBy("t", "is_test").count().collect()
    assert {(r["t"], r["is_test"]): r["count"] for r in got} == {("a", True): 60, ("a", False): 140, (None, True): 60, (None, False): 140}
    assert features.stratified_split(repeated, "t", ["id"], 0.0).where("is_test").isEmpty()
    assert features.stratified_split(repeated, "t", ["id"], 1.0).where("not is_test").isEmpty()
    assert features.stratified_split(repeated.limit(0), "t", ["id"]).isEmpty()


def test_predictions_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def guess(x: float) -> float:
        made.add(1)
        return x

    pred = spark.range(60).select((F.col("id") % 3).cast("double").alias("label"))
    pred = pred.withColumn("prediction", F.udf(guess, "double")("label"))
    assert {r["recall"] for r in models.classification_report(pred).collect()} == {1.0}
    assert made.value == 60
    scored = pred.withColumn("probability", F.array(*[F.lit(0.0)] * 3))
    matrix, auc = models.confusion_and_auc(scored, 3)
    assert matrix.count() == 3 and {r["auc"] for r in auc.collect()} == {0.5}
    assert made.value == 120


def test_facts_shuffle_line_items_once(spark, sf_dir):
    """Orders meet their customers before the line items join."""
    from hazardloom.plans import tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tables.facts(spark, sf_dir).select("l_orderkey", "c_mktsegment")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # an outer exchange is printed first
    assert plan.index("hashpartitioning(l_orderkey") < plan.index("hashpartitioning(o_custkey")


def test_column_importances_read_the_facts_once(spark, sf_dir, monkeypatch):
    from hazardloom.plans import risk

    read, facts = [], risk.facts
    stored = risk.cut
    monkeypatch.setattr(risk, "facts", lambda *a: read.append(1) or facts(*a))
    monkeypatch.setattr(risk, "cut", lambda df: read.append(df.columns) or stored(df))
    assert risk.column_importances(spark, sf_dir).count() == 5
    assert read == [1, ["o_orderpriority", "l_returnflag", "l_quantity", "l_tax"]]
