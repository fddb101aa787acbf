"""Bindings: the given tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import pareto, rules, scenarios
from ..session import cut
from .registry import table

CONDITIONS = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "qty_band", "disc_band"]

_BANDS = {
    "qty_band": "case when l_quantity > 35 then 'high' when l_quantity > 15 then 'mid' else 'low' end",
    "disc_band": "case when l_discount > 0.065 then 'deep' when l_discount > 0.025 then 'some' else 'none' end",
    "severity": (
        "case when l_quantity > 35 and l_discount > 0.065 then 'severe'"
        " when l_returnflag = 'R' and l_quantity > 15 then 'moderate'"
        " when l_orderkey % 11 = 0 then 'severe' else 'minor' end"
    ),
}

FACTS = f"""
facts AS (
  SELECT l.*, o.*, c.*, n_name, r_name,
         {_BANDS['qty_band']} AS qty_band, {_BANDS['disc_band']} AS disc_band, {_BANDS['severity']} AS severity
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

FACTS_NULL = f"""{FACTS},
facts_null AS (
  SELECT l_orderkey, l_extendedprice, l_returnflag, severity,
         CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS l_tax,
         CASE WHEN l_orderkey % 100 = 0 THEN c_mktsegment END AS c_mktsegment
  FROM facts
)"""

EVENTS_GAPS = """
gaps AS (
  SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events
)"""

EVENT_DATES = """
event_dates AS (
  SELECT event_id, ts,
    CASE WHEN event_id % 50 = 0 THEN 'not a date'
         WHEN event_id % 8 = 0 THEN strftime(ts, '%Y-%m-%d')
         WHEN event_id % 8 = 1 THEN strftime(ts, '%Y-%m')
         WHEN event_id % 8 = 2 THEN strftime(ts, '%m/%d/%Y')
         WHEN event_id % 8 = 3 THEN strftime(ts, '%m-%d-%Y')
         WHEN event_id % 8 = 4 THEN strftime(ts, '%Y/%m/%d')
         WHEN event_id % 8 = 5 THEN strftime(ts, '%d/%m/%Y')
         WHEN event_id % 8 = 6 THEN strftime(ts, '%Y')
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw
  FROM events
)"""

_MASKED = ", ".join(
    f"CASE WHEN m & {1 << i} > 0 THEN {{'k': '{c}', 'v': {c}}} END" for i, c in enumerate(sorted(CONDITIONS))
)

SCENARIOS = f"""{FACTS},
merged AS (
  SELECT r_name AS state, severity AS accident_type, {', '.join(CONDITIONS)}, count(*) AS w FROM facts GROUP BY ALL
),
masks AS (SELECT m FROM (SELECT unnest(range(1, 64)) AS m) WHERE bit_count(m) <= 3),
joint AS (
  SELECT state, accident_type, ev, sum(w) AS n
  FROM (SELECT state, accident_type, w, list_filter([{_MASKED}], lambda x: x IS NOT NULL) AS ev FROM merged, masks)
  GROUP BY ALL
),
sets AS (SELECT state, ev, sum(n) AS n_items FROM joint GROUP BY ALL),
states AS (SELECT state, sum(w) AS n_all FROM merged GROUP BY ALL),
classes AS (SELECT state, accident_type, sum(w) AS n_class FROM merged GROUP BY ALL),
scen AS (
  SELECT state, accident_type, ev,
    '{{' || array_to_string(list_transform(ev, lambda e: '''' || e.k || ''': ''' || e.v || ''''), ', ') || '}}' AS evidence,
    n_items::DOUBLE / n_all::DOUBLE AS support_rate,
    n::DOUBLE / n_items::DOUBLE AS prob,
    (n::DOUBLE / n_items::DOUBLE) / (n_class::DOUBLE / n_all::DOUBLE) AS lift,
    n::DOUBLE / n_items::DOUBLE - n_class::DOUBLE / n_all::DOUBLE AS uplift
  FROM joint JOIN sets USING (state, ev) JOIN states USING (state) JOIN classes USING (state, accident_type)
  WHERE n_items::DOUBLE / n_all::DOUBLE >= 0.01
),
scenarios AS (SELECT *, accident_type || ' | ' || evidence AS scenario_id FROM scen)"""

_SCORED = ["l_returnflag", "l_linestatus", "o_orderpriority", "qty_band"]
_POINTS = "((ascii(right(f, 1)) * 7 + length(f)) % 97) / 1000.0"

IMPORTANCES = f"""
importances AS (
  SELECT 'cat__' || f AS feature_name, {_POINTS}::DOUBLE AS importance_score
  FROM ({' UNION '.join(f"SELECT '{c}_' || {c} AS f FROM facts" for c in _SCORED)})
  UNION ALL SELECT 'num__c_mktsegment', 0.042
),
lookup AS (
  SELECT translate(replace(replace(lower(feature_name), 'cat__', ''), 'num__', ''), ' /.', '') AS feature,
         min(importance_score) AS importance
  FROM importances GROUP BY 1
)"""

CONDITION_SCORES = """
conds AS (
  SELECT state, scenario_id, pos, e.k AS k, e.v AS v
  FROM (SELECT state, scenario_id, unnest(ev) AS e, generate_subscripts(ev, 1) AS pos FROM scenarios)
),
looked AS (
  SELECT conds.*, CASE WHEN p.feature IS NOT NULL THEN 1 WHEN s.feature IS NOT NULL THEN 2 ELSE 0 END AS tier,
         coalesce(p.importance, s.importance, 0.0) AS score
  FROM conds LEFT JOIN lookup p ON p.feature = translate(lower(k || '_' || v), ' /.', '')
             LEFT JOIN lookup s ON s.feature = translate(lower(k), ' /.', '')
),
detail AS (
  SELECT state, scenario_id, list_sum(list(score ORDER BY pos)) / count(*) AS s2_2_importance,
    string_agg(CASE tier WHEN 1 THEN k || '=' || v || printf('(Score:%.4f)', score)
                         WHEN 2 THEN k || printf('(Score:%.4f)', score)
                         ELSE k || '=' || v || '(N/A)' END, '; ' ORDER BY pos) AS matched_details
  FROM looked GROUP BY ALL
)"""

SCORED = f"""{SCENARIOS}, {IMPORTANCES}, {CONDITION_SCORES},
positive AS (
  SELECT s.*, s2_2_importance, matched_details
  FROM scenarios s JOIN detail d USING (state, scenario_id) WHERE uplift > 0
),
limits AS (
  SELECT state, min(uplift) AS ulo, max(uplift) AS uhi, min(s2_2_importance) AS ilo, max(s2_2_importance) AS ihi
  FROM positive GROUP BY ALL
),
normed AS (
  SELECT positive.*, coalesce((uplift - ulo) / nullif(uhi - ulo, 0), 0.0) AS norm_uplift,
         coalesce((s2_2_importance - ilo) / nullif(ihi - ilo, 0), 0.0) AS norm_importance
  FROM positive JOIN limits USING (state)
),
indexed AS (SELECT *, 0.5 * norm_uplift + 0.5 * norm_importance AS CRI_Score FROM normed),
running AS (
  SELECT *, sum(CRI_Score) OVER (PARTITION BY state ORDER BY CRI_Score DESC, scenario_id ROWS UNBOUNDED PRECEDING)
            AS cumulative_score, sum(CRI_Score) OVER (PARTITION BY state) AS total
  FROM indexed
),
shares AS (SELECT * EXCLUDE (total), cumulative_score / total AS cumulative_percentage FROM running),
pareto AS (
  SELECT *, CASE WHEN cumulative_percentage <= 0.8 THEN 'A' WHEN cumulative_percentage <= 0.9 THEN 'B' ELSE 'C' END AS Class
  FROM shares
)"""

SWEEP = f"""{SCORED},
weights AS (SELECT * FROM (VALUES (0.1::DOUBLE, 0.9::DOUBLE), (0.3, 0.7), (0.5, 0.5), (0.7, 0.3), (0.9, 0.1)) AS w(w1, w2)),
swept AS (SELECT normed.*, w1, w2, w1 * norm_uplift + w2 * norm_importance AS CRI_Score FROM normed, weights),
swept_total AS (
  SELECT *, sum(CRI_Score) OVER (PARTITION BY state, w1, w2 ORDER BY CRI_Score DESC, scenario_id ROWS UNBOUNDED PRECEDING)
            / sum(CRI_Score) OVER (PARTITION BY state, w1, w2) AS cumulative_percentage
  FROM swept
),
listed AS (SELECT * FROM swept_total WHERE cumulative_percentage <= 0.8),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY state, w1, w2 ORDER BY CRI_Score DESC, scenario_id) AS "Rank" FROM listed
),
base AS (SELECT * FROM ranked WHERE w1 = 0.5)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order, customer, nation and region; sizes decide the join strategy.

    Orders meet their customers first, so that line items, the largest table, are shuffled once only.
    """
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    placed = (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .drop("n_nationkey", "n_regionkey", "r_regionkey")
    )
    joined = t["lineitem"].join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumns({name: F.expr(text) for name, text in _BANDS.items()})


def _keep(col: str, condition: str) -> Column:
    return F.when(F.expr(condition), F.col(col)).alias(col)


def facts_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with missing values placed by order key."""
    return facts(spark, sf_dir).select(
        "l_orderkey",
        "l_extendedprice",
        "l_returnflag",
        "severity",
        _keep("l_quantity", "l_orderkey % 13 <> 0"),
        _keep("o_orderstatus", "l_orderkey % 7 <> 0"),
        _keep("l_tax", "l_orderkey % 3 <> 0"),
        _keep("c_mktsegment", "l_orderkey % 100 = 0"),
    )


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", _keep("value", "event_id % 5 <> 0")
    )


def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in eight layouts, and some text that is no date."""
    layouts = ["yyyy-MM-dd", "yyyy-MM", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy", "yyyy-MM-dd HH:mm:ss"]
    raw = F.when(F.col("event_id") % 50 == 0, "not a date")
    for i, layout in enumerate(layouts):
        raw = raw.when(F.col("event_id") % 8 == i, F.date_format("ts", layout))
    return table(spark, sf_dir, "events").select("event_id", "ts", raw.alias("raw"))


_SAVED: dict[tuple[str, str, str], DataFrame] = {}


def _saved(name: str, spark: SparkSession, sf_dir: str, build, keep=cut) -> DataFrame:
    """Intermediate tables are materialized once per application, as a stage's output file would be."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SAVED:
        _SAVED[key] = keep(build())
    return _SAVED[key]


def forget() -> None:
    """Let the next query build its intermediate tables anew."""
    _SAVED.clear()


def scenario_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of every condition set of up to three conditions, one set per region as state."""
    return _saved(
        "scenarios", spark, sf_dir,
        lambda: rules.risk_combinations(
            facts(spark, sf_dir).withColumnRenamed("r_name", "state"), CONDITIONS, "severity", by=["state"]
        ),
    )


def importance_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded importance per distinct condition; one column by name only, one without any."""

    def build() -> DataFrame:
        rows = facts(spark, sf_dir)
        names = F.array(*[F.concat(F.lit(c + "_"), F.col(c)) for c in _SCORED])
        seen = rows.select(F.explode(names).alias("f")).distinct()
        scored = seen.select(
            F.concat(F.lit("cat__"), "f").alias("feature_name"),
            (((F.ascii(F.right("f", F.lit(1))) * 7 + F.length("f")) % 97) / 1000.0).alias("importance_score"),
        )
        extra = spark.createDataFrame([("num__c_mktsegment", 0.042)], "feature_name string, importance_score double")
        return scored.unionByName(extra)

    return _saved("importances", spark, sf_dir, build)


def scored_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with positive uplift, their importance and matched details."""

    def build() -> DataFrame:
        positive = scenario_set(spark, sf_dir).where("uplift > 0")
        return scenarios.scenario_importance(positive, importance_set(spark, sf_dir), ["state"])

    return _saved("scored", spark, sf_dir, build)


def pareto_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(
        "pareto", spark, sf_dir,
        lambda: pareto.pareto(scenarios.cri(scored_set(spark, sf_dir), by=["state"]), by=["state"]),
    )


def listed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-A scenarios of every state and weight pair."""

    def build() -> DataFrame:
        swept = scenarios.weight_sweep(scored_set(spark, sf_dir), by=["state"])
        return pareto.pareto(swept, by=["state", "w1", "w2"]).where("Class = 'A'")

    return _saved("listed", spark, sf_dir, build)
