"""Queries: dates, times and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.values import lenient_number
from ..operators import temporal, text
from ..operators.schema import drop_zero_variance
from . import workflows
from .registry import query, r6, round_doubles, table
from .tables import EVENT_DATES, event_dates

_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"


def _stripped(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


def _squeezed(col: str) -> str:
    return f"regexp_replace({_stripped(col)}, '[{_SPACE}]+', ' ', 'g')"


DIRTY = """
dirty AS (
  SELECT event_id, CASE event_id % 20 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'none' WHEN 3 THEN 'x' WHEN 4 THEN NULL
                   ELSE CAST(value AS VARCHAR) END AS raw FROM events
)"""


def _dirty(spark, sf) -> DataFrame:
    k = F.col("event_id") % 20
    raw = F.when(k == 0, "").when(k == 1, "nan").when(k == 2, "none").when(k == 3, "x").when(k == 4, None)
    return table(spark, sf, "events").select("event_id", raw.otherwise(F.col("value").cast("string")).alias("raw"))


@query(f"""
WITH {DIRTY}
SELECT event_id, round(CASE WHEN raw <> 'nan' THEN try_cast(raw AS DOUBLE) END, 6) AS number FROM dirty
""")
def coerce_numbers(spark, sf) -> DataFrame:
    numbers = temporal.to_number(_dirty(spark, sf).withColumnRenamed("raw", "number"), ["number", "absent"])
    return numbers.select("event_id", r6("number"))


@query(f"""
WITH {DIRTY}
SELECT event_id, round(coalesce(CASE WHEN raw <> 'nan' THEN try_cast(raw AS DOUBLE) END, 0.0), 6) AS number FROM dirty
""")
def lenient_numbers(spark, sf) -> DataFrame:
    return _dirty(spark, sf).select("event_id", r6(lenient_number("raw"), "number"))


@query("""
WITH parts AS (
  SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN year(ts) END AS y, CASE WHEN event_id % 5 <> 0 THEN month(ts) + (event_id % 10) END AS m
  FROM events),
dated AS (SELECT event_id, CASE WHEN y IS NOT NULL THEN make_date(y, coalesce(m, 1), 1) END AS d FROM parts)
SELECT event_id, d AS accident_date, CAST(year(d) AS INTEGER) AS accident_year, CAST(month(d) AS INTEGER) AS accident_month,
       CAST(quarter(d) AS INTEGER) AS accident_quarter, CAST(dayofyear(d) AS INTEGER) AS accident_day_of_year,
       CAST(isodow(d) - 1 AS INTEGER) AS accident_weekday, dayname(d) AS accident_weekday_name
FROM dated
""")
def accident_dates(spark, sf) -> DataFrame:
    """Year and month as dirty text; some years and months are missing."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(e % 11 == 0, "unknown").otherwise(F.year("ts").cast("string")).alias("Accident Year"),
        F.when(e % 5 != 0, (F.month("ts") + e % 10).cast("string")).alias("Accident Month"),
    )
    return temporal.convert_date_columns(rows).drop("Accident Year", "Accident Month")


@query("""
WITH clock AS (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '25:05' ELSE strftime(ts, '%H:%M') END AS t, ts FROM events),
ok AS (SELECT event_id, t, CASE WHEN t <> '25:05' THEN ts END AS p FROM clock)
SELECT event_id, t AS "Time", CAST(hour(p) AS INTEGER) AS "Time_hour", CAST(minute(p) AS INTEGER) AS "Time_minute",
  CASE WHEN hour(p) >= 6 AND hour(p) < 12 THEN 'Morning' WHEN hour(p) >= 12 AND hour(p) < 18 THEN 'Afternoon'
       WHEN hour(p) >= 18 AND hour(p) < 22 THEN 'Evening' ELSE 'Night' END AS "Time_time_of_day"
FROM ok
""")
def time_of_day(spark, sf) -> DataFrame:
    e = F.col("event_id")
    clock = F.when(e % 17 == 0, None).when(e % 19 == 0, F.lit("25:05")).otherwise(F.date_format("ts", "HH:mm"))
    rows = table(spark, sf, "events").select("event_id", clock.alias("Time"))
    return temporal.time_parts(rows, "Time").drop("Time_parsed")


@query(f"""
WITH {EVENT_DATES}
SELECT event_id, raw, strftime(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y-%m'), try_strptime(raw, '%m/%d/%Y'),
  try_strptime(raw, '%m-%d-%Y'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%Y'),
  try_strptime(raw, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d') AS normal FROM event_dates
""")
def normalized_dates(spark, sf) -> DataFrame:
    return temporal.normalize_dates(event_dates(spark, sf), "raw", out="normal").select("event_id", "raw", "normal")


@query("""
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS d_year, CAST(month(d) AS INTEGER) AS d_month, CAST(day(d) AS INTEGER) AS d_day,
  CAST(quarter(d) AS INTEGER) AS d_quarter, CAST(isodow(d) - 1 AS INTEGER) AS d_weekday, dayname(d) AS d_weekday_name,
  isodow(d) >= 6 AS d_is_weekend, CAST(dayofyear(d) AS INTEGER) AS d_day_of_year, CAST(weekofyear(d) AS INTEGER) AS d_week_of_year,
  CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) <= 5 THEN 'Spring' WHEN month(d) <= 8 THEN 'Summer' ELSE 'Fall' END AS d_season
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)
""")
def date_features(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("d"))
    return temporal.date_features(orders, "d").drop("d")


@query("""
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(quarter(ts) AS INTEGER) AS quarter FROM events
""")
def time_features(spark, sf) -> DataFrame:
    return temporal.time_features(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@query(f"""
SELECT doc_id, md5(lower({_squeezed('text')})) AS digest FROM documents
""")
def normalized_text(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_text("text")).alias("digest"))


# tags, links, addresses, control characters and other symbols, in this order
_CLEAN_STEPS = [
    ("<[^>]+>", " "),
    (rf"(?i)https?://[^{_SPACE}]+|www\.[^{_SPACE}]+", " "),
    (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", " "),
    (r"[\p{Cf}\p{Co}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]", ""),
    (rf"[^\p{{L}}\p{{N}}{_SPACE}.,;:!?\-_/()\[\]{{}}''\"]", " "),
]


def _clean_sql(col: str) -> str:
    for pattern, replacement in _CLEAN_STEPS:
        col = f"regexp_replace({col}, '{pattern}', '{replacement}', 'g')"
    return f"lower({_squeezed(col)})"


@query(f"""
SELECT page_id, md5({_clean_sql('html')}) AS digest, length({_clean_sql('html')}) AS n FROM pages
""")
def cleaned_pages(spark, sf) -> DataFrame:
    """Whole pages through the cleaning chain, without the two steps SQL has no function for."""
    clean = tx.clean_text("html", unescape_entities=False, normalize_unicode=False)
    return table(spark, sf, "pages").select(
        "page_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n")
    )


# the entities that the pages hold; '&amp;' last, as unescaping is a single pass
_UNESCAPED = "html"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, regexp_replace({_clean_sql(_UNESCAPED)}, '[0-9]', '0', 'g') AS html_clean FROM pages")
def cleaned_pages_full(spark, sf) -> DataFrame:
    """The full chain with entity unescaping and the Unicode compatibility form (which leaves these
    pages as they are; the tests cover texts that it changes)."""
    clean = tx.clean_text("html", digits_to_placeholder=True)
    return table(spark, sf, "pages").select("page_id", clean.alias("html_clean"))


@query(f"""
SELECT doc_id, md5(lower({_squeezed('lang')})) AS lang_digest, md5(lower({_squeezed('text')})) AS text_digest FROM documents
""")
def cleaned_columns(spark, sf) -> DataFrame:
    """Several columns in one call with a plugged-in cleaner; an absent column is skipped."""
    docs = text.clean_columns(
        table(spark, sf, "documents"), ["lang", "text", "absent"], cleaner=tx.normalize_text
    )
    return docs.select("doc_id", F.md5("lang_clean").alias("lang_digest"), F.md5("text_clean").alias("text_digest"))


@query(f"""
WITH parts AS (SELECT doc_id, [CASE WHEN doc_id % 3 <> 0 THEN lang END, ' ' || source || ' ', '  ', text] AS p FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(p, lambda x: {_stripped('x')}), lambda x: x <> ''), ' [SEP] ')) AS digest
FROM parts
""")
def merged_text(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
        F.concat(F.lit(" "), "source", F.lit(" ")).alias("source"),
        F.lit("  ").alias("blank"),
        "text",
    )
    merged = text.merge_text(docs, ["lang", "source", "blank", "text"])
    return merged.select("doc_id", F.md5("text_merged").alias("digest"))


KEYWORDS = ["Water", "people", "license", "the", "qqqq"]
_HIT = "CASE WHEN contains(lower(text), '{0}') THEN '{1}' END"


@query(f"""
SELECT doc_id, array_to_string(list_filter([{', '.join(_HIT.format(k.lower(), k) for k in KEYWORDS)}], lambda x: x IS NOT NULL), ',') AS keywords
FROM documents
""")
def tagged_keywords(spark, sf) -> DataFrame:
    tagged = text.tag_keywords(table(spark, sf, "documents"), "text", KEYWORDS)
    return tagged.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(f"""
SELECT keyword, count(*) AS n FROM (SELECT unnest([{', '.join(_HIT.format(k.lower(), k) for k in KEYWORDS)}]) AS keyword FROM documents)
WHERE keyword IS NOT NULL GROUP BY 1
""")
def keyword_counts(spark, sf) -> DataFrame:
    return text.keyword_counts(table(spark, sf, "documents"), "text", KEYWORDS)


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


_SENTIMENT = f"""
hits AS (SELECT doc_id, CAST({_hits(tx.POSITIVE_WORDS)} AS INTEGER) AS positive_score, CAST({_hits(tx.NEGATIVE_WORDS)} AS INTEGER) AS negative_score FROM documents),
labelled AS (SELECT *, CASE WHEN positive_score > negative_score THEN 'positive' WHEN negative_score > positive_score THEN 'negative'
                      ELSE 'neutral' END AS sentiment FROM hits)"""


@query(f"WITH {_SENTIMENT} SELECT * FROM labelled")
def sentiment(spark, sf) -> DataFrame:
    out = text.sentiment(table(spark, sf, "documents"), "text")
    return out.select("doc_id", "positive_score", "negative_score", "sentiment")


@query(f"WITH {_SENTIMENT} SELECT sentiment, count(*) AS n FROM labelled GROUP BY 1")
def sentiment_counts(spark, sf) -> DataFrame:
    return text.sentiment_counts(table(spark, sf, "documents"), "text")


@query("""
SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n,
       md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS digest FROM conversations
""")
def tokenized(spark, sf) -> DataFrame:
    words = tx.tokens("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(words).cast("bigint").alias("n"), F.md5(F.array_join(words, " ")).alias("digest")
    )


_FULL = """'p_partkey ' || p_partkey || ', p_brand ' || p_brand || ', p_size ' || CASE WHEN p_partkey % 4 = 0 THEN 'NA' ELSE CAST(p_size AS VARCHAR) END
  || ', p_retailprice ' || CAST(p_retailprice AS VARCHAR) || ', narrative ' || p_name || ','"""


def _narratives(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_name").alias("narrative"), "p_partkey", "p_brand",
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("p_size"), "p_retailprice",
    )


_LISTED = ["narrative", "p_partkey", "p_brand", "p_size", "p_retailprice", "absent"]


@query(f"SELECT p_partkey, {_FULL} AS full_text FROM part")
def full_text(spark, sf) -> DataFrame:
    """Rows as text, the narrative moved to the end."""
    return text.full_text(drop_zero_variance(_narratives(spark, sf)), _LISTED).select("p_partkey", "full_text")


@query(f"""
SELECT row_number() OVER (ORDER BY p_partkey) AS position, p_brand, CASE WHEN length(n) > 30 THEN left(n, 30) || '...' ELSE n END AS narrative, full_text
FROM (SELECT p_partkey, p_brand, p_name || ' / ' || p_type || ' / ' || p_brand || ' / ' || p_name AS n, {_FULL.replace("p_name ||", "p_name || ' / ' || p_type || ' / ' || p_brand || ' / ' || p_name ||")} AS full_text
      FROM part ORDER BY p_partkey LIMIT 3)
""")
def text_preview(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    rows = _narratives(spark, sf).join(part, "p_partkey").withColumn(
        "narrative", F.concat_ws(" / ", "p_name", "p_type", "p_brand", "p_name")
    )
    shown = text.full_text(rows, _LISTED)
    out = text.preview(shown, ["p_brand", "narrative", "full_text"], ["p_partkey"])
    return out.withColumn("position", F.col("position").cast("bigint"))


_BLANKED = """
blanked AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '  ' WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS t FROM documents),
filled AS (SELECT t FROM blanked WHERE trim(t) <> '' AND t IS NOT NULL)"""


def _blanked(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    t = F.when(d % 6 == 0, F.lit("  ")).when(d % 5 == 0, None).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t"))


@query(f"""
WITH {_BLANKED}
SELECT round(1.0 - count(*) / (SELECT count(*) FROM blanked), 6) AS missing_rate, count(*) AS non_empty_count,
  (SELECT count(*) FROM blanked) AS total_count, CAST(min(length(t)) AS INTEGER) AS min_length, CAST(max(length(t)) AS INTEGER) AS max_length,
  round(avg(length(t)), 6) AS mean_length, round(stddev_samp(length(t)), 6) AS std_length FROM filled
""")
def text_quality(spark, sf) -> DataFrame:
    return round_doubles(text.text_quality(_blanked(spark, sf), "t"))


@query("""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
GROUP BY 1 ORDER BY n DESC, token LIMIT 10
""")
def top_tokens(spark, sf) -> DataFrame:
    return text.top_tokens(table(spark, sf, "documents"), "text", 10)


@query("""
WITH lengths AS (SELECT length(text)::DOUBLE AS x FROM documents WHERE trim(text) <> ''),
lim AS (SELECT min(x) AS lo, max(x) AS hi FROM lengths),
binned AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) + 1 AS BIGINT) AS bin, count(*) AS n FROM lengths, lim GROUP BY 1)
SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / 50), 6) AS bin_from, round(lo + b.bin * ((hi - lo) / 50), 6) AS bin_to, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 51)) AS bin) b LEFT JOIN binned USING (bin), lim
""")
def length_histogram(spark, sf) -> DataFrame:
    return round_doubles(text.length_histogram(table(spark, sf, "documents"), "text", 50))


_LENGTHS = "lengths AS (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents)"


@query(f"""
WITH {_LENGTHS}
SELECT count(*) AS total_rows, CAST(max(x) AS INTEGER) AS max_tokens, CAST(min(x) AS INTEGER) AS min_tokens, round(avg(x), 6) AS mean_tokens,
  round(quantile_cont(x, 0.5), 6) AS median_tokens, count(*) FILTER (x > 512) AS over_512, count(*) FILTER (x > 4096) AS over_4096,
  round(100.0 * count(*) FILTER (x > 512) / count(*), 6) AS over_512_percent,
  round(100.0 * count(*) FILTER (x > 4096) / count(*), 6) AS over_4096_percent FROM lengths
""")
def token_length_report(spark, sf) -> DataFrame:
    return round_doubles(text.token_length_report(table(spark, sf, "documents"), "text"))


@query(f"""
WITH {_LENGTHS},
lim AS (SELECT (greatest(max(x), 4096) + 10)::DOUBLE AS hi FROM lengths),
binned AS (SELECT CAST(least(floor(x / (hi / 100)), 99) + 1 AS BIGINT) AS bin, count(*) AS n FROM lengths, lim GROUP BY 1)
SELECT b.bin, round((b.bin - 1) * (hi / 100), 6) AS bin_from, round(b.bin * (hi / 100), 6) AS bin_to, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 101)) AS bin) b LEFT JOIN binned USING (bin), lim
""")
def token_length_histogram(spark, sf) -> DataFrame:
    return round_doubles(text.token_length_histogram(table(spark, sf, "documents"), "text"))


@query("""
SELECT doc_id, source FROM documents WHERE trim(text) <> '' ORDER BY md5(doc_id || '#42'), doc_id LIMIT 5
""")
def sampled_texts(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").where(~tx.is_blank("text"))
    return text.sample_rows(docs, "doc_id", 5, 42).select("doc_id", "source")


@query(f"""
WITH parts AS (SELECT [{_squeezed('lang')}, {_squeezed('source')}, {_squeezed('text')}] AS p FROM documents),
merged AS (SELECT array_to_string(list_filter(list_transform(p, lambda x: lower(x)), lambda x: x <> ''), ' [SEP] ') AS t FROM parts)
SELECT count(*) AS total_count, CAST(min(length(t)) AS INTEGER) AS min_length, CAST(max(length(t)) AS INTEGER) AS max_length, round(avg(length(t)), 6) AS mean_length FROM merged
""")
def text_workflow(spark, sf) -> DataFrame:
    """Select, clean, merge and profile in one chain."""
    named = table(spark, sf, "documents").withColumnsRenamed({"lang": "Accident  Type", "source": "weather condition"})
    done = workflows.text_workflow(
        named, ["Accident Type", "Weather Condition", "text", "Train Speed"], ["Accident  Type", "weather condition", "text"],
        cleaner=tx.normalize_text,
    )
    assert done.missing == ["Train Speed"]
    return round_doubles(done.quality.select("total_count", "min_length", "max_length", "mean_length"))
