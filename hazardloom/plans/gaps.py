"""Queries: missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import missing
from .registry import query, r6, round_doubles, table
from .tables import EVENTS_GAPS, FACTS_NULL, event_gaps, facts_null

_COLUMNS = ["l_quantity", "o_orderstatus", "l_tax", "c_mktsegment", "severity"]


@query(f"""
WITH {FACTS_NULL}, middle AS (SELECT median(l_quantity) AS m FROM facts_null)
SELECT coalesce(o_orderstatus, 'UNKNOWN') AS o_orderstatus, severity, coalesce(l_quantity, m) AS l_quantity, count(*) AS n, count(l_tax) AS n_tax
FROM facts_null, middle GROUP BY ALL
""")
def policy_imputation(spark, sf) -> DataFrame:
    filled, _ = missing.impute_policy(facts_null(spark, sf).select(*_COLUMNS))
    assert "c_mktsegment" not in filled.columns
    return filled.groupBy("o_orderstatus", "severity", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("n_tax")
    )


def _ratio(c: str) -> str:
    return f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6)"


@query(f"""
WITH {FACTS_NULL}
SELECT 'l_quantity' AS "column", {_ratio('l_quantity')} AS null_ratio, 'median' AS action, CAST(median(l_quantity) AS VARCHAR) AS fill FROM facts_null
UNION ALL SELECT 'o_orderstatus', {_ratio('o_orderstatus')}, 'placeholder', 'UNKNOWN' FROM facts_null
UNION ALL SELECT 'l_tax', {_ratio('l_tax')}, 'keep', NULL FROM facts_null
UNION ALL SELECT 'c_mktsegment', {_ratio('c_mktsegment')}, 'drop', NULL FROM facts_null
UNION ALL SELECT 'severity', 0.0, 'keep', NULL
""")
def policy_report(spark, sf) -> DataFrame:
    _, report = missing.impute_policy(facts_null(spark, sf).select(*_COLUMNS))
    return round_doubles(report)


@query(f"""
WITH {FACTS_NULL}
SELECT 'Train Speed' AS "column", 'numeric' AS kind, {_ratio('l_quantity')} AS null_ratio, 'median_imputation' AS strategy, CAST(NULL AS VARCHAR) AS category FROM facts_null
UNION ALL SELECT 'Accident Year', 'numeric', {_ratio('l_tax')}, 'advanced_imputation', NULL FROM facts_null
UNION ALL SELECT 'Accident Year', 'special', {_ratio('l_tax')}, 'Time_specific', 'Time' FROM facts_null
UNION ALL SELECT 'State Name', 'text', {_ratio('o_orderstatus')}, 'placeholder', NULL FROM facts_null
UNION ALL SELECT 'State Name', 'special', {_ratio('o_orderstatus')}, 'Location_specific', 'Location' FROM facts_null
UNION ALL SELECT 'Railroad Code', 'high_missing', {_ratio('c_mktsegment')}, 'drop', NULL FROM facts_null
UNION ALL SELECT 'Railroad Code', 'special', {_ratio('c_mktsegment')}, 'Railroad_specific', 'Railroad' FROM facts_null
""")
def imputation_advice(spark, sf) -> DataFrame:
    named = facts_null(spark, sf).select(
        F.col("l_quantity").alias("Train Speed"),
        F.col("l_tax").alias("Accident Year"),
        F.col("o_orderstatus").alias("State Name"),
        F.col("c_mktsegment").alias("Railroad Code"),
        F.col("severity").alias("Accident Type"),
    )
    return round_doubles(missing.suggest_strategies(named))


@query(f"""
WITH {FACTS_NULL}, stats AS (
  SELECT median(l_quantity) AS mq, median(l_tax) AS mt,
    (SELECT o_orderstatus FROM facts_null WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS s,
    (SELECT c_mktsegment FROM facts_null WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS g
  FROM facts_null)
SELECT coalesce(o_orderstatus, s) AS o_orderstatus, coalesce(c_mktsegment, g) AS c_mktsegment, count(*) AS n,
  round(sum(coalesce(l_quantity, mq)), 6) AS qty, round(sum(coalesce(l_tax, mt)), 6) AS tax
FROM facts_null, stats GROUP BY ALL
""")
def median_mode_imputation(spark, sf) -> DataFrame:
    filled = missing.impute_median_mode(facts_null(spark, sf), ["l_quantity", "l_tax"], ["o_orderstatus", "c_mktsegment"])
    return filled.groupBy("o_orderstatus", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), "qty"), r6(F.sum("l_tax"), "tax")
    )


@query(f"""
WITH {FACTS_NULL}
SELECT coalesce(o_orderstatus, '(Missing)') AS o_orderstatus, coalesce(c_mktsegment, 'NA') AS c_mktsegment, coalesce(l_tax, -1.0) AS l_tax, count(*) AS n
FROM facts_null GROUP BY ALL
""")
def constant_fill(spark, sf) -> DataFrame:
    filled = missing.fill_constant(
        facts_null(spark, sf), {"o_orderstatus": "(Missing)", "c_mktsegment": "NA", "l_tax": -1.0}
    )
    return filled.groupBy("o_orderstatus", "c_mktsegment", "l_tax").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {EVENTS_GAPS}
SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value_ffill
FROM gaps
""")
def forward_fill(spark, sf) -> DataFrame:
    rows = missing.fill_forward(event_gaps(spark, sf), "value", ["ts", "event_id"], ["user_id"])
    return rows.select("event_id", "user_id", "value_ffill")


@query(f"""
WITH {EVENTS_GAPS}
SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value_bfill
FROM gaps
""")
def backward_fill(spark, sf) -> DataFrame:
    """One global order: no group column at all."""
    rows = missing.fill_backward(event_gaps(spark, sf), "value", ["ts", "event_id"], [])
    return rows.select("event_id", "value_bfill")


@query(f"""
WITH {EVENTS_GAPS},
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM gaps),
near AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER before AS p0, last_value(value IGNORE NULLS) OVER before AS v0,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER after AS p1, first_value(value IGNORE NULLS) OVER after AS v1
  FROM placed
  WINDOW before AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         after AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN p0 IS NULL THEN NULL WHEN p1 IS NULL THEN v0
                  ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, 6) AS value_linear FROM near
""")
def linear_interpolation(spark, sf) -> DataFrame:
    rows = missing.interpolate(event_gaps(spark, sf), "value", ["ts", "event_id"], ["user_id"])
    return rows.select("event_id", r6("value_linear"))


@query("""
WITH rows AS (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS p_size,
                     CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice END AS a, length(p_name)::DOUBLE AS b FROM part),
donors AS (SELECT * FROM rows WHERE p_size IS NOT NULL),
pairs AS (
  SELECT q.p_partkey, d.p_size,
    row_number() OVER (PARTITION BY q.p_partkey ORDER BY
      (coalesce((q.a - d.a) * (q.a - d.a), 0.0) + coalesce((q.b - d.b) * (q.b - d.b), 0.0)) * 3
        / (CASE WHEN (q.a - d.a) IS NULL THEN 1 ELSE 2 END), d.p_partkey) AS r
  FROM (SELECT * FROM rows WHERE p_size IS NULL) q, donors d)
SELECT p_partkey, round(avg(p_size), 6) AS p_size_knn FROM pairs WHERE r <= 5 GROUP BY 1
UNION ALL SELECT p_partkey, p_size::DOUBLE FROM donors
""")
def nearest_neighbour_imputation(spark, sf) -> DataFrame:
    """Sizes from the five parts nearest in price and name length; some prices are missing too."""
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 29 != 0, F.col("p_retailprice")).alias("a"),
        F.length("p_name").cast("double").alias("b"),
    )
    return missing.knn_impute(rows, "p_partkey", "p_size", ["a", "b"], 5).select("p_partkey", r6("p_size_knn"))


_AROUND = ["o_custkey", "c_nationkey", "c_acctbal", "year", "month", "day"]


@query(f"""
WITH rows AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice, o_custkey::DOUBLE AS o_custkey, c_nationkey::DOUBLE AS c_nationkey,
    CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, year(o_orderdate)::DOUBLE AS year,
    CASE WHEN o_orderkey % 17 <> 0 THEN month(o_orderdate)::DOUBLE END AS month, day(o_orderdate)::DOUBLE AS day
  FROM orders JOIN customer ON o_custkey = c_custkey),
donors AS (SELECT * FROM rows WHERE o_totalprice IS NOT NULL),
apart AS (
  SELECT q.o_orderkey, d.o_orderkey AS donor, d.o_totalprice, ({' + '.join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0.0)" for c in _AROUND)}) * 7
      / ({' + '.join(f"CASE WHEN (q.{c} - d.{c}) IS NULL THEN 0 ELSE 1 END" for c in _AROUND)}) AS distance
  FROM (SELECT * FROM rows WHERE o_totalprice IS NULL) q, donors d),
near AS (SELECT o_orderkey, unnest(min(row(distance, donor, o_totalprice), 5)) AS n FROM apart GROUP BY 1)
SELECT o_orderkey, round(avg(n[3]), 4) AS o_totalprice_knn FROM near GROUP BY 1
UNION ALL SELECT o_orderkey, round(o_totalprice, 4) FROM donors
""")
def neighbours_in_all_numbers(spark, sf) -> DataFrame:
    """Prices from the five orders nearest in all six other numbers, some of which are missing."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_custkey",
        "c_nationkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderkey") % 17 != 0, F.month("o_orderdate")).alias("month"),
        F.dayofmonth("o_orderdate").alias("day"),
    )
    found = missing.knn_impute(rows, "o_orderkey", "o_totalprice", _AROUND, 5)
    return found.select("o_orderkey", F.round("o_totalprice_knn", 4).alias("o_totalprice_knn"))
