"""Queries: cleaning, profiling, counts, enrichment, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import quality, rollup, schema
from ..operators.ordered import OrderedRows
from ..session import scratch_path
from ..sources import files, paged_json
from .registry import query, r6, round_doubles, table
from .tables import FACTS, FACTS_NULL, facts, facts_null

_BASE = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "o_orderstatus",
         "o_orderpriority", "c_mktsegment", "n_name"]


@query(f"""
WITH {FACTS_NULL},
withblank AS (
  SELECT l_quantity, o_orderstatus, l_tax, NULL AS empty FROM facts_null
  UNION ALL SELECT NULL, NULL, NULL, NULL FROM nation
)
SELECT DISTINCT l_quantity, o_orderstatus, l_tax FROM withblank
WHERE NOT (l_quantity IS NULL AND o_orderstatus IS NULL AND l_tax IS NULL)
""")
def clean_initial(spark, sf) -> DataFrame:
    rows = facts_null(spark, sf).select("l_quantity", "o_orderstatus", "l_tax").withColumn(
        "empty", F.lit(None).cast("string")
    )
    blank = table(spark, sf, "nation").select(
        *[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes]
    )
    return quality.clean_initial(rows.unionByName(blank))


@query("""
SELECT n_nationkey, n_name, n_regionkey FROM nation
""")
def drop_duplicate_rows(spark, sf) -> DataFrame:
    nation = table(spark, sf, "nation")
    return quality.clean_initial(nation.unionByName(nation))


@query(f"""
WITH {FACTS}
SELECT o_orderpriority AS "Order Priority", n_name AS "nation  NAME", count(*) AS n FROM facts GROUP BY ALL
""")
def select_core_columns(spark, sf) -> DataFrame:
    renamed = facts(spark, sf).select(
        F.col("n_name").alias("nation  NAME"), F.col("o_orderpriority").alias("Order Priority"), "l_tax"
    )
    core, missing = schema.select_core(renamed, ["order priority", " Nation Name", "Weather Condition"])
    assert missing == ["Weather Condition"]
    return core.groupBy(*core.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CAST(NULL AS INTEGER) AS all_null FROM part
""")
def drop_zero_variance(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").withColumns(
        {"constant": F.lit("x"), "one_or_null": F.when(F.col("p_partkey") % 2 == 0, 1), "all_null": F.lit(None).cast("int")}
    )
    return schema.drop_zero_variance(part)


@query("""
SELECT p_size, p_brand, p_partkey, 'narrative,weather' AS missing FROM part
""")
def keep_listed_columns(spark, sf) -> DataFrame:
    kept, missing = schema.keep_columns(
        table(spark, sf, "part"), ["narrative", "p_size", "p_brand", "weather", "p_partkey"]
    )
    return kept.withColumn("missing", F.lit(",".join(missing)))


@query(f"""
WITH {FACTS},
counts AS (
  SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS n_distinct FROM facts
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM facts
  UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM facts
  UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM facts
  UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM facts
)
SELECT * FROM counts
""")
def high_cardinality_report(spark, sf) -> DataFrame:
    rows = facts(spark, sf).select("l_returnflag", "o_orderpriority", "l_quantity", "n_name", "l_discount", "c_name", "l_extendedprice")
    _, counts = schema.drop_columns_report(rows, ["c_name", "l_extendedprice"], threshold=150)
    return counts


@query("""
SELECT 'numeric' AS kind, unnest(['p_partkey', 'p_size', 'p_retailprice']) AS "column", (SELECT count(*) FROM part) AS n
UNION ALL SELECT 'text', unnest(['p_name', 'p_brand', 'p_type']), (SELECT count(*) FROM part)
""")
def column_types(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    numeric, text = schema.split_types(part.withColumn("flag", F.lit(True)))
    pairs = [("numeric", c) for c in numeric] + [("text", c) for c in text]
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column")) for k, c in pairs])
    return part.agg(F.count(F.lit(1)).alias("n")).select(F.inline(entries), "n")


@query("""
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
       CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part
""")
def cast_to_categories(spark, sf) -> DataFrame:
    return schema.as_categorical(table(spark, sf, "part"), exclude=["p_partkey"])


@query(f"""
WITH {FACTS_NULL}
SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM facts_null
WHERE o_orderstatus IS NOT NULL GROUP BY ALL
""")
def drop_null_target(spark, sf) -> DataFrame:
    kept = quality.drop_null_target(facts_null(spark, sf), "o_orderstatus")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), "qty"))


@query(r"""
WITH blanks AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN chr(160) || '  ' || chr(9) ELSE text END AS t FROM documents)
SELECT doc_id, length(t) AS n FROM blanks WHERE regexp_replace(t, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g') <> ''
""")
def non_blank_texts(spark, sf) -> DataFrame:
    doc = F.col("doc_id")
    text = F.when(doc % 9 == 0, None).when(doc % 7 == 0, F.lit("   \t")).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    return quality.filter_non_blank(rows, "t").select("doc_id", F.length("t").cast("bigint").alias("n"))


@query(f"""
WITH {FACTS}
SELECT count(*) FILTER (l_quantity > 40) AS heavy, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.04) AS both_high,
       count(*) FILTER (severity = 'severe') AS severe FROM facts
""")
def threshold_counts(spark, sf) -> DataFrame:
    return quality.count_where(
        facts(spark, sf),
        {
            "heavy": F.col("l_quantity") > 40,
            "both_high": (F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.04),
            "severe": F.col("severity") == "severe",
        },
    )


_NULL_COLUMNS = ["l_quantity", "o_orderstatus", "l_tax", "c_mktsegment", "l_returnflag"]


@query(f"""
WITH {FACTS_NULL},
three AS (SELECT l_quantity, o_orderstatus, l_tax FROM facts_null)
SELECT 'shape' AS section, CAST(NULL AS VARCHAR) AS "column", 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM three
UNION ALL SELECT 'shape', NULL, 'columns', '3'
UNION ALL SELECT 'missing_values', 'l_quantity', 'nulls', CAST(count(*) - count(l_quantity) AS VARCHAR) FROM three
UNION ALL SELECT 'missing_values', 'o_orderstatus', 'nulls', CAST(count(*) - count(o_orderstatus) AS VARCHAR) FROM three
UNION ALL SELECT 'missing_values', 'l_tax', 'nulls', CAST(count(*) - count(l_tax) AS VARCHAR) FROM three
UNION ALL SELECT 'data_types', 'l_quantity', 'type', 'double'
UNION ALL SELECT 'data_types', 'o_orderstatus', 'type', 'string'
UNION ALL SELECT 'data_types', 'l_tax', 'type', 'double'
UNION ALL SELECT 'duplicates', NULL, 'duplicate_rows',
  CAST((SELECT count(*) FROM three) - (SELECT count(*) FROM (SELECT DISTINCT * FROM three)) AS VARCHAR)
""")
def quality_report(spark, sf) -> DataFrame:
    return quality.quality_report(facts_null(spark, sf).select("l_quantity", "o_orderstatus", "l_tax"))


@query(f"""
WITH {FACTS_NULL},
two AS (SELECT o_orderstatus, c_mktsegment FROM facts_null)
SELECT 'issue' AS severity, 'missing_column' AS "check", 'narrative' AS detail
UNION ALL SELECT 'warning', 'no_numeric_column', ''
UNION ALL SELECT 'warning', 'high_null_column', 'c_mktsegment' FROM two HAVING avg(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) > 0.5
UNION ALL SELECT 'warning', 'duplicate_rows',
  CAST((SELECT count(*) FROM two) - (SELECT count(*) FROM (SELECT DISTINCT * FROM two)) AS VARCHAR)
""")
def validate_table(spark, sf) -> DataFrame:
    rows = facts_null(spark, sf).select("o_orderstatus", "c_mktsegment")
    return quality.validate(rows, required=["o_orderstatus", "narrative"])


@query(f"""
WITH {FACTS_NULL}
{' UNION ALL '.join(f'''SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio FROM facts_null'''
                     for c in _NULL_COLUMNS)}
""")
def null_ratios(spark, sf) -> DataFrame:
    return round_doubles(quality.null_ratios(facts_null(spark, sf).select(*_NULL_COLUMNS)))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem""" for c in _NUMBERS))
def numeric_summary(spark, sf) -> DataFrame:
    return round_doubles(quality.numeric_summary(table(spark, sf, "lineitem"), _NUMBERS))


_TEXTS = ["l_returnflag", "o_orderpriority", "n_name"]


@query(f"""
WITH {FACTS}, counts AS (
  {' UNION ALL '.join(f'''SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM facts GROUP BY ALL''' for c in _TEXTS)}
)
SELECT "column", unique_count, position, value, n AS frequency FROM (
  SELECT *, count(*) OVER (PARTITION BY "column") AS unique_count,
         row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM counts)
WHERE position <= 5
""")
def categorical_summary(spark, sf) -> DataFrame:
    out = quality.categorical_summary(facts(spark, sf), _TEXTS)
    return out.withColumn("position", F.col("position").cast("bigint"))


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _NUMBERS for b in _NUMBERS))
def correlation_matrix(spark, sf) -> DataFrame:
    return round_doubles(quality.correlations(table(spark, sf, "lineitem"), _NUMBERS))


@query(f"""
WITH {FACTS}
SELECT n_name, count(*) AS accident_count FROM facts GROUP BY n_name ORDER BY accident_count DESC, n_name LIMIT 10
""")
def top_states(spark, sf) -> DataFrame:
    return rollup.top_groups(facts(spark, sf), "n_name", 10)


@query(f"""
WITH {FACTS_NULL}
SELECT o_orderstatus, count(*) AS accident_count FROM facts_null GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 4
""")
def top_groups_with_null(spark, sf) -> DataFrame:
    return rollup.top_groups(facts_null(spark, sf), "o_orderstatus", 4, include_na=True)


@query("""
SELECT DISTINCT n_nationkey AS accident_type_code, n_name AS accident_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 7 <> 0
""")
def code_mapping(spark, sf) -> DataFrame:
    rows = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).withColumn("code", F.when(F.col("n_nationkey") % 7 != 0, F.col("n_nationkey")))
    return rollup.code_mapping(rows, "code", "n_name")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""
WITH {FACTS}
SELECT n_name, {', '.join(f'''round_even(100.0 * count(*) FILTER (o_orderpriority = '{p}') / count(*), 2) AS "{p}"''' for p in _PRIORITIES)}
FROM facts GROUP BY n_name
""")
def state_type_percentages(spark, sf) -> DataFrame:
    return rollup.percent_crosstab(facts(spark, sf), "n_name", "o_orderpriority")


@query(f"""
WITH {FACTS_NULL},
pairs AS (SELECT coalesce(o_orderstatus, '(Missing)') AS r, l_returnflag AS c, count(*) AS n FROM facts_null GROUP BY ALL)
SELECT r AS o_orderstatus, c AS l_returnflag, n, round_even(100.0 * n / sum(n) OVER (PARTITION BY r), 2) AS percent FROM pairs
""")
def percentages_with_missing(spark, sf) -> DataFrame:
    return rollup.percent_long(facts_null(spark, sf), "o_orderstatus", "l_returnflag", include_na=True)


@query("""
SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 10 <> 0
""")
def enrich_by_key(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    source = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    twice = source.unionByName(source)
    return rollup.enrich(orders, twice, "c_mktsegment", [["o_custkey", "o_orderdate"], ["o_custkey"]])


@query("""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_id FROM orders),
     b AS (SELECT o_orderdate, o_orderkey AS other, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders)
SELECT row_id, o_orderkey, other FROM a JOIN b USING (row_id)
""")
def align_by_position(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    left = orders.select("o_orderkey", "o_totalprice")
    right = orders.select(F.col("o_orderkey").alias("other"), "o_orderdate")
    return rollup.align_by_position(left, right, ["o_totalprice", "o_orderkey"], ["o_orderdate", "other"]).select(
        "row_id", "o_orderkey", "other"
    )


@query("""
SELECT event_type, month, n, round(total, 6) AS total FROM (
  SELECT event_type, 'first' AS month, count(*) AS n, sum(value) AS total FROM events WHERE day(ts) <= 15 GROUP BY ALL
  UNION ALL SELECT event_type, 'second', count(*), sum(value) FROM events WHERE day(ts) > 15 GROUP BY ALL)
""")
def union_of_metric_tables(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")

    def part(name: str, condition: str) -> DataFrame:
        counts = events.where(condition).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        return counts.withColumn("month", F.lit(name))

    return round_doubles(rollup.union_all([part("first", "day(ts) <= 15"), part("second", "day(ts) > 15")]))


@query("""
SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders
""")
def common_ids(spark, sf) -> DataFrame:
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return rollup.common_ids(rich, table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query("""
SELECT 'missing_column' AS kind, name, (SELECT count(*) FROM part) AS n FROM (SELECT unnest(['narrative', 'weather']) AS name)
""")
def missing_required_columns(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    names = schema.missing_names(part, ["p_name", "narrative", "p_size", "weather"])
    wanted = F.array(*[F.lit(n) for n in names])
    return part.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("missing_column").alias("kind"), F.explode(wanted).alias("name"), "n"
    )


@query("""
SELECT doc_id, lang, length(text) AS n_text, md5(text) AS digest FROM documents
""")
def csv_round_trip(spark, sf) -> DataFrame:
    """Whole texts with quotes and line breaks through a csv file and back."""
    path = scratch_path(spark, "documents") + ".csv"
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    files.save_results(docs, path, "csv")
    back = files.read_incidents(spark, path, schema=docs.schema)
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_text"), F.md5("text").alias("digest"))


@query("""
SELECT p_type, 3 * count(*) AS n, CAST(3 * sum(p_size) AS BIGINT) AS size, round(3 * sum(p_retailprice), 6) AS price FROM part GROUP BY ALL
""")
def read_by_ending(spark, sf) -> DataFrame:
    """The same table through a parquet, a csv and a json file, each read by its ending."""
    part = table(spark, sf, "part")
    back = []
    for kind in files.FORMATS:
        path = f"{scratch_path(spark, 'part')}.{kind}"
        files.save_results(part, path, kind)
        back.append(files.read_table(spark, path, schema=part.schema).select(part.columns))
    every = back[0].unionByName(back[1]).unionByName(back[2])
    return every.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"), r6(F.sum("p_retailprice"), "price"))


@query("""
SELECT event_type, 2 * count(*) AS n, round(2 * sum(value), 6) AS total FROM events GROUP BY ALL
""")
def safe_save_twice(spark, sf) -> DataFrame:
    """The second save finds the target taken and writes a sibling; both are read back."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    path = scratch_path(spark, "events")
    written = [files.safe_save(events, path, "parquet"), files.safe_save(events, path, "parquet")]
    assert written[0] == path and written[1] != path
    both = files.load_results(spark, written[0], "parquet").unionByName(files.load_results(spark, written[1], "parquet"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))


@query("""
SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click'
""")
def paged_fetch(spark, sf) -> DataFrame:
    """Pages of 1000 records per event type are stored, then fetched with a filter and landed."""
    folder = scratch_path(spark, "pages")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    numbered = OrderedRows(events, ["event_type"], ["event_id"]).row_number("position").result()
    pages = numbered.withColumns(
        {"filter": F.col("event_type"), "page": F.floor((F.col("position") - 1) / 1000)}
    ).drop("position")
    pages.repartition("filter", "page").write.partitionBy("filter", "page").json(folder)
    provider = paged_json.FolderPages(folder)
    fetched = paged_json.read_pages(
        spark, provider, "event_id bigint, user_id bigint, event_type string, value double", where="event_type='click'"
    )
    landed = scratch_path(spark, "landed")
    paged_json.land_pages(fetched, landed)
    return spark.read.parquet(landed)


@query("""
SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY ALL
""")
def column_list_file(spark, sf) -> DataFrame:
    path = scratch_path(spark, "columns")
    part = table(spark, sf, "part")
    listed = part.agg(F.max(F.lit("p_size\n\n  p_brand \nnarrative\n")).alias("value"))
    listed.coalesce(1).write.text(path)
    kept, _ = schema.keep_columns(part, files.read_column_list(spark, path))
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))
