"""End-to-end chains, checkpoint folder, and plans."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hazardloom import session
from hazardloom.operators import features, scenarios
from hazardloom.plans import tables, workflows


def test_state_statistics(spark, sf_dir):
    facts = tables.facts(spark, sf_dir)
    got = workflows.state_statistics(facts, "n_name", "o_orderpriority", "o_orderpriority")
    assert got.top_states.count() == 10 and got.mapping.count() == 5
    assert all(abs(sum(v for v in r[1:]) - 100) < 0.1 for r in got.percentages.collect())


def test_text_workflow_with_the_full_cleaner(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    got = workflows.text_workflow(docs, ["lang", "text"], ["lang", "text"])
    assert got.quality.first()["non_empty_count"] == docs.count()
    assert got.top_tokens.count() == 10 and sum(r["n"] for r in got.lengths.collect()) == docs.count()


def test_fusion_chain(spark, sf_dir):
    facts = tables.facts(spark, sf_dir).withColumnRenamed("r_name", "state")
    found = workflows.find_scenarios(facts, tables.CONDITIONS[:3], "severity", ["state"], max_len=2)
    imp = tables.importance_set(spark, sf_dir)
    fused = workflows.fuse_and_classify(found, imp, by=["state"])
    n = fused.classes.count()
    assert n == found.count() and sum(r["n"] for r in fused.class_counts.collect()) == n
    assert fused.class_a.count() == fused.classes.where("Class = 'A'").count() > 0
    moved = workflows.sensitivity(fused.scenarios)
    assert moved.metrics.count() == 25 and moved.matrix.count() == 5 and moved.trajectories.count() > 0
    per_type, best, told = workflows.deep_dive(fused.classes, ["state"])
    assert per_type.count() > 0 and best.count() > 0 and told.where("length(narrative) > 20").count() == told.count()
    learned = workflows.learned_classes(found, imp, ["state"], trees=5)
    assert learned.count() == n and learned.where("cumulative_percentage > 1.000001").isEmpty()


def test_classifier_chain(spark, sf_dir):
    facts = tables.facts(spark, sf_dir).withColumn("row_key", F.monotonically_increasing_id())
    facts = session.cut(facts)
    text = features.embed_text(facts.withColumn("t", F.concat_ws(" ", "l_returnflag", "severity")), "row_key", "t", size=8)
    vectors = text.select("row_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("text_features"))
    got = workflows.classifier(
        facts, ["row_key"], "severity", ["l_quantity", "l_discount"], ["l_returnflag"], vectors, trees=3, depth=3)
    assert got.report.where("class = 'accuracy'").first()["f1"] > 0.65
    assert [r["class"] for r in got.mapping.orderBy("code").collect()] == ["minor", "moderate", "severe"]
    names = {r["feature_name"] for r in got.importances.collect()}
    assert names == {"num__l_quantity", "num__l_discount", "cat__l_returnflag_A", "cat__l_returnflag_N", "cat__l_returnflag_R"}


class Session:
    """The part of a session that the folder rule looks at."""

    def __init__(self, master, named):
        self.made = None
        self.master = master
        self.named = named
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path

    def get(self, name, default):
        return self.named if name == "spark.checkpoint.dir" and self.named else default


def test_shared_folder_is_the_one_the_cluster_names():
    cluster = Session("yarn", "hdfs://shared/work")
    assert session.shared_folder(cluster) == "hdfs://shared/work" and cluster.made == "hdfs://shared/work"
    assert session.scratch_path(cluster, "x").startswith("hdfs://shared/work/x-")


def test_no_temporary_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_folder(Session("yarn", None))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_columns_in_use(spark, sf_dir):
    text = plan(tables.facts(spark, sf_dir).where("l_quantity > 40").groupBy("n_name").count())
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)" in text


def test_native_cleaning_has_no_python_step(spark, sf_dir):
    from hazardloom.functions import text as tx

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    native = pages.select(tx.clean_text("html", unescape_entities=False, normalize_unicode=False).alias("t"))
    assert "Python" not in plan(native)
    assert plan(pages.select(tx.clean_text("html").alias("t"))).count("ArrowEvalPython") == 2


def test_no_cross_join_in_scoring(spark, sf_dir):
    swept = scenarios.weight_sweep(tables.scored_set(spark, sf_dir), by=["state"])
    text = plan(swept)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
