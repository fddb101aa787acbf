"""Queries: Pareto classes, stability of rankings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.evidence import evidence_text
from ..operators import pareto, report, rules, scenarios, stability
from ..session import scratch_path
from ..sources import files
from .registry import query, r6, round_doubles
from .tables import CONDITIONS, SCORED, SWEEP, facts, importance_set, listed_set, pareto_set, scored_set


@query(f"""
WITH {SWEEP}
SELECT state, w1, w2, scenario_id, "Rank" FROM ranked
""")
def scenario_ranks(spark, sf) -> DataFrame:
    listed = listed_set(spark, sf).select("state", "w1", "w2", "scenario_id", "CRI_Score")
    return pareto.rank_scenarios(listed, ["state", "w1", "w2"]).drop("CRI_Score")


@query(f"""
WITH {SCORED}
SELECT state, scenario_id, round(CRI_Score, 6) AS "CRI_Score", round(cumulative_score, 6) AS cumulative_score,
       round(cumulative_percentage, 6) AS cumulative_percentage, Class AS "Class" FROM pareto
""")
def pareto_classes(spark, sf) -> DataFrame:
    scored = scenarios.cri(scored_set(spark, sf), by=["state"])
    classes = pareto.pareto(scored, by=["state"])
    return round_doubles(
        classes.select("state", "scenario_id", "CRI_Score", "cumulative_score", "cumulative_percentage", "Class")
    )


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (), 6) AS share
FROM orders
""")
def global_running_share(spark, sf) -> DataFrame:
    """One order over a whole table, cut into buckets of 2000 rows so the carry is exercised."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    shared = pareto.running_share(orders, "o_totalprice", key="o_orderkey", rows_per_bucket=2000)
    return shared.select("o_orderkey", r6("cumulative_percentage", "share"))


@query(f"""
WITH {SCORED}
SELECT state, Class AS "Class", n, round(n / sum(n) OVER (PARTITION BY state), 6) AS share
FROM (SELECT state, Class, count(*) AS n FROM pareto GROUP BY 1, 2)
""")
def class_counts(spark, sf) -> DataFrame:
    return round_doubles(pareto.class_counts(pareto_set(spark, sf), ["state"]))


@query(f"""
WITH {SWEEP}
SELECT state, w1, w2, scenario_id, round(CRI_Score, 6) AS "CRI_Score" FROM swept
""")
def weight_sweep(spark, sf) -> DataFrame:
    swept = scenarios.weight_sweep(scored_set(spark, sf), by=["state"])
    return round_doubles(swept.select("state", "w1", "w2", "scenario_id", "CRI_Score"))


@query(f"""
WITH {SWEEP}
SELECT state, w1, w2, accident_type, evidence, scenario_id, round(CRI_Score, 6) AS "CRI_Score" FROM listed WHERE state = 'ASIA'
""")
def saved_class_a(spark, sf) -> DataFrame:
    """Reports of all weight pairs written by partition, one state read back."""
    root = scratch_path(spark, "reports")
    report_rows = listed_set(spark, sf).withColumn("model_version", F.lit("baseline_v1"))
    files.save_class_a(pareto.class_a(report_rows), root)
    back = files.load_scenarios(spark, root, "ASIA")
    return round_doubles(back.select("state", "w1", "w2", "accident_type", "evidence", "scenario_id", "CRI_Score"))


@query(f"""
WITH {SWEEP}
SELECT r.state, r.w1, r.scenario_id, r."Rank" AS "Rank", b."Rank" AS "Rank_base" FROM ranked r JOIN base b USING (state, scenario_id)
""")
def joined_rankings(spark, sf) -> DataFrame:
    listed = listed_set(spark, sf).select("state", "w1", "scenario_id", "CRI_Score")
    ranked = pareto.rank_scenarios(listed, ["state", "w1"]).drop("CRI_Score")
    base = ranked.where("w1 = 0.5").drop("w1")
    return stability.join_rankings(ranked, base, ["state", "scenario_id"])


_METRICS = f"""{SWEEP},
pairs AS (SELECT r.state, r.w1, r.w2, r."Rank" AS x, b."Rank" AS y FROM ranked r JOIN base b USING (state, scenario_id)),
rk AS (SELECT state, w1, w2, rank() OVER (PARTITION BY state, w1, w2 ORDER BY x) AS rx, rank() OVER (PARTITION BY state, w1, w2 ORDER BY y) AS ry FROM pairs),
rho AS (SELECT state, w1, w2, CASE WHEN count(*) > 5 THEN corr(rx, ry) ELSE 0 END AS c FROM rk GROUP BY ALL),
hits AS (
  SELECT r.state, r.w1, r.w2, count(b.scenario_id) / any_value(bs.n) AS o
  FROM (SELECT * FROM ranked WHERE "Rank" <= 20) r LEFT JOIN (SELECT * FROM base WHERE "Rank" <= 20) b USING (state, scenario_id)
    JOIN (SELECT state, count(*) AS n FROM base WHERE "Rank" <= 20 GROUP BY 1) bs ON bs.state = r.state GROUP BY ALL),
metrics AS (SELECT state AS "State", w1 AS "Rule_Weight", w2 AS "Model_Weight", round(c, 6) AS "Spearman_Corr", round(o, 6) AS "Top20_Overlap" FROM rho JOIN hits USING (state, w1, w2))"""


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def ranking_stability(spark, sf) -> DataFrame:
    return round_doubles(stability.stability(listed_set(spark, sf)))


@query(f"""
WITH {_METRICS}
SELECT "State", {', '.join(f'max("Spearman_Corr") FILTER ("Rule_Weight" = {w}) AS "{w}"' for w in (0.1, 0.3, 0.5, 0.7, 0.9))} FROM metrics GROUP BY 1
""")
def stability_by_state(spark, sf) -> DataFrame:
    metrics = stability.stability(listed_set(spark, sf))
    return round_doubles(stability.stability_matrix(metrics, [0.1, 0.3, 0.5, 0.7, 0.9]))


@query(f"""
WITH {SWEEP},
top AS (SELECT state, scenario_id, '#' || "Rank" || ': ' || accident_type AS label FROM base WHERE "Rank" <= 5),
sizes AS (SELECT state, w1, w2, count(*) AS n FROM ranked GROUP BY ALL)
SELECT state, w1, w2, label, coalesce("Rank", n + 5) AS "Rank" FROM sizes JOIN top USING (state) LEFT JOIN ranked USING (state, w1, w2, scenario_id)
""")
def rank_trajectories(spark, sf) -> DataFrame:
    return stability.rank_trajectory(listed_set(spark, sf)).select("state", "w1", "w2", "label", "Rank")


@query("""
WITH r AS (
  SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
         rank() OVER (PARTITION BY l_returnflag ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_returnflag, l_tax) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS corr FROM r GROUP BY 1
""")
def spearman_with_ties(spark, sf) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return round_doubles(stability.spearman(rows, "l_quantity", "l_tax", ["l_returnflag"]))


@query("""
WITH a AS (SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 50),
     b AS (SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) <= 50)
SELECT p_type, round(count(b.p_partkey) / 50.0, 6) AS overlap FROM a LEFT JOIN b USING (p_type, p_partkey) GROUP BY 1
""")
def top_overlap(spark, sf) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_type", "p_partkey", "p_retailprice", "p_size")
    price = part.withColumn("score", F.col("p_retailprice"))
    size = part.withColumn("score", F.col("p_size").cast("double"))
    out = stability.top_k_overlap(
        price, size, ["p_partkey"], [F.desc("score"), F.col("p_partkey")], 50, ["p_type"], ["p_type"], denominator=50
    )
    return round_doubles(out)


@query(f"""
WITH {SCORED}
SELECT state, accident_type, count(*) AS n FROM pareto WHERE Class = 'A' GROUP BY ALL
""")
def scenarios_per_type(spark, sf) -> DataFrame:
    return report.scenarios_per_type(pareto_set(spark, sf).where("Class = 'A'"), ["state"])


_TOP = f"""{SCORED},
types AS (
  SELECT state, accident_type FROM (SELECT state, accident_type, count(*) AS n FROM pareto WHERE Class = 'A' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, accident_type) <= 2),
best AS (
  SELECT p.*, row_number() OVER (PARTITION BY state, accident_type ORDER BY CRI_Score DESC, scenario_id) AS position
  FROM pareto p JOIN types USING (state, accident_type) WHERE Class = 'A')"""


@query(f"""
WITH {_TOP}
SELECT state, accident_type, position, scenario_id, round(CRI_Score, 6) AS "CRI_Score",
       array_to_string(list_transform(ev, lambda e: e.k || ': ' || e.v), ' / ') AS label FROM best WHERE position <= 5
""")
def top_scenarios_per_type(spark, sf) -> DataFrame:
    best = report.top_per_type(pareto_set(spark, sf).where("Class = 'A'"), n=5, types=2, by=["state"])
    return best.select(
        "state", "accident_type", F.col("position").cast("bigint").alias("position"), "scenario_id", r6("CRI_Score"),
        F.replace("label", F.lit("\n"), F.lit(" / ")).alias("label"),
    )


@query(f"""
WITH {_TOP}
SELECT state, accident_type, position, array_to_string(list_concat([
    '{report.SCENE.split('%')[0]}' || position || '{report.SCENE.split('%d')[1]}',
    '{report.PATTERN.split('%s')[0]}' || array_to_string(list_transform(ev, lambda e: '{report.CONDITION.split('%s')[0]}' || e.k || '{report.CONDITION.split('%s')[1]}' || e.v || '{report.CONDITION.split('%s')[2]}'), '{report.JOINER}') || '{report.PATTERN.split('%s')[1]}',
    '{report.SUPPORT.split('%.1f')[0]}' || printf('%.1f', uplift * 100) || '% (Uplift)。',
    '{report.CAUSES}'], list_transform(list_filter(split(matched_details, '; '), lambda x: contains(x, 'Score')), lambda x: '  * ' || x)), chr(10)) AS narrative
FROM best WHERE position <= 3
""")
def narratives(spark, sf) -> DataFrame:
    told = report.narratives(pareto_set(spark, sf).where("Class = 'A'"), n=3, types=2, by=["state"])
    return told.select("state", "accident_type", F.col("position").cast("bigint").alias("position"), "narrative")


@query(f"""
WITH {SCORED}
SELECT state, accident_type, evidence, round(uplift, 6) AS uplift, round(s2_2_importance, 6) AS s2_2_importance,
       round(CRI_Score, 6) AS "CRI_Score", Class AS "Class" FROM pareto
""")
def risk_by_class(spark, sf) -> DataFrame:
    """The flagship: combinations, index, ranking and classes from the raw tables in one go."""
    combos = rules.risk_combinations(
        facts(spark, sf).withColumnRenamed("r_name", "state"), CONDITIONS, "severity", by=["state"]
    )
    scored = scenarios.scenario_importance(combos.where("uplift > 0"), importance_set(spark, sf), ["state"])
    classes = pareto.pareto(scenarios.cri(scored, by=["state"]), by=["state"])
    return round_doubles(
        classes.select(
            "state", "accident_type", evidence_text("evidence").alias("evidence"), "uplift", "s2_2_importance", "CRI_Score", "Class"
        )
    )
