"""Column functions on hand-made rows."""


import pytest
from pyspark.sql import functions as F, types as T

from hazardloom.functions import dates, evidence as ev, text as tx, values
from hazardloom.operators import temporal, text


def column(spark, data, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")


def apply(spark, data, function, kind="string"):
    rows = column(spark, data, kind).select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_white_space_is_complete():
    assert set(tx.WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_lenient_number(spark):
    got = apply(spark, ["1.5", " 2 ", "", "nan", "None", "x", None, "-3e2"], values.lenient_number)
    assert got == [1.5, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, -300.0]


def test_plain_text_of_doubles(spark):
    data = [10000000.0, 1.5, 0.1, 123456789.25, 0.0001, 0.0, -2.0, 12345.678, None, 3.0e15]
    got = apply(spark, data, lambda c: values.plain_text(c, T.DoubleType()), "double")
    assert got == [None if x is None else str(x) for x in data]


def test_log_and_root_of_bad_values(spark):
    assert apply(spark, [-1.0, 0.0, None], values.safe_log1p, "double") == [None, 0.0, None]
    assert apply(spark, [-1.0, 4.0, None], values.safe_sqrt, "double") == [None, 2.0, None]


def test_feature_keys(spark):
    assert apply(spark, ["cat__Equipment Type_Freight Train"], values.feature_key) == ["equipmenttype_freighttrain"]
    assert apply(spark, ["num__A/B.C", "cat__x"], values.condition_key) == ["num__abc", "cat__x"]
    assert apply(spark, ["Train-Speed_1é"], values.alnum_key) == ["trainspeed1é"]


def test_evidence_parsing(spark):
    raw = ["{'A': 'x'}", "{'A': \"it's\"}", "{'A': 40}", "{'A': None, 'B': True}", "bad", None, "[1, 2]", ""]
    got = apply(spark, raw, ev.parse_evidence)
    assert got == [{"A": "x"}, {"A": "it's"}, {"A": "40"}, {"A": "None", "B": "True"}, {}, {}, {}, {}]


def test_evidence_text_round_trip(spark):
    rows = spark.createDataFrame([({"B": "it's", "A": "x y"},)], "m map<string,string>")
    out = rows.select(ev.evidence_text("m").alias("t"), ev.parse_evidence(ev.evidence_text("m")).alias("back")).first()
    assert out["t"] == "{'A': 'x y', 'B': \"it's\"}"
    assert out["back"] == {"A": "x y", "B": "it's"}


def test_evidence_label(spark):
    rows = spark.createDataFrame(
        [({"b": "2", "a": "1"}, "x"), ({}, "unreadable text that is long")], "m map<string,string>, raw string"
    )
    got = [r[0] for r in rows.select(ev.evidence_label("m", "raw")).collect()]
    assert got == ["a: 1\nb: 2", "unreadable text that..."]


# text, cleaned text, cleaned text with digits replaced; written by hand
CLEANING = [
    ("&lt;b&gt;Hi&lt;/b&gt; see https://x.y a@b.co", "hi see", None),
    ("Ｆｕｌｌ　ｗｉｄｔｈ ﬁne 12½", "full width fine 121 2", "full width fine 000 0"),
    ("a\x00b\x07c\td\u200be", "abc de", None),
    ("WWW.Example.com/x?q=1 tail HTTPS://A.b", "tail", None),
    ("price: 5€ & more — dash… “quotes”", "price: 5 more dash... quotes", "price: 0 more dash... quotes"),
    ("&amp;amp; &eacute; &#x41; &notanentity;", "amp; é a anentity;", None),
    ("  lead and trail \u3000", "lead and trail", None),
    ("", "", None),
    (None, "", None),
    ("x < y and y > z", "x z", None),
    ("mail me.at+tag@sub.domain.org, ok", "mail , ok", None),
    ("٣ tests ١٢", "٣ tests ١٢", "0 tests 00"),
    ("emoji 😀 stays? no", "emoji stays? no", None),
]
CLEANING_CASES = [c[0] for c in CLEANING]


def test_full_cleaning_chain(spark):
    assert apply(spark, CLEANING_CASES, tx.clean_text) == [c[1] for c in CLEANING]


def test_digits_to_placeholder(spark):
    got = apply(spark, CLEANING_CASES, lambda c: tx.clean_text(c, digits_to_placeholder=True))
    assert got == [c[2] or c[1] for c in CLEANING]


def test_cleaning_without_punctuation(spark):
    got = apply(spark, ["a_b, c! d-e"], lambda c: tx.clean_text(c, keep_basic_punct=False))
    assert got == ["a_b c d e"]
    assert apply(spark, ["  A  b "], lambda c: tx.clean_text(c, strip_edges=False, to_lower=False)) == [" A b "]


def test_cleaning_is_idempotent(spark):
    once = apply(spark, CLEANING_CASES, tx.clean_text)
    settled = [s for s in once if "&" not in s]
    assert apply(spark, settled, tx.clean_text) == settled


def test_sentiment(spark):
    rows = column(spark, ["safe but failed, accident", "good", None, "plain"])
    got = [(r["positive_score"], r["negative_score"], r["sentiment"]) for r in text.sentiment(rows, "x").orderBy("i").collect()]
    assert got == [(1, 2, "negative"), (1, 0, "positive"), (0, 0, "neutral"), (0, 0, "neutral")]


def test_merge_skips_blank_cells(spark):
    rows = spark.createDataFrame([("a ", None, " ", "b", 2.0)], "p string, q string, r string, s string, t double")
    assert text.merge_text(rows, ["p", "q", "r", "s", "t", "absent"]).first()["text_merged"] == "a [SEP] b [SEP] 2.0"
    empty = rows.select(F.lit(None).cast("string").alias("p"), F.lit(" ").alias("q"))
    assert text.merge_text(empty, ["p", "q"]).first()["text_merged"] == ""


def test_keywords_keep_list_order(spark):
    rows = column(spark, ["The Signal failed", None])
    got = [r["keywords"] for r in text.tag_keywords(rows, "x", ["signal", "the", "zzz"]).orderBy("i").collect()]
    assert got == [["signal", "the"], []]


def test_full_text_orders(spark):
    rows = spark.createDataFrame([("hit a truck", 10000000.0, None)], "narrative string, speed double, city string")
    last = text.full_text(rows, ["narrative", "speed", "city"]).first()["full_text"]
    assert last == "speed 10000000.0, city NA, narrative hit a truck,"
    first = text.full_text(rows, ["narrative", "speed", "city"], narrative_last=False).first()["full_text"]
    assert first == "narrative hit a truck, speed 10000000.0, city NA,"


def test_all_lengths_equal_fill_one_bin(spark):
    got = text.length_histogram(column(spark, ["aa", "bb", None, " "]), "x", 4)
    assert sum(r["n"] for r in got.collect()) == 2
    assert got.where("n > 0").count() == 1


def test_largest_length_lands_in_last_bin(spark):
    got = {r["bin"]: r["n"] for r in text.length_histogram(column(spark, ["a", "bbb", "ccccc"]), "x", 4).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}


def test_text_quality_without_text(spark):
    got = text.text_quality(column(spark, [None, "  ", ""]), "x").first()
    assert (got["missing_rate"], got["non_empty_count"], got["total_count"]) == (1.0, 0, 3)
    assert (got["min_length"], got["max_length"], got["mean_length"], got["std_length"]) == (0, 0, 0.0, 0.0)


def test_calendar_features(spark):
    rows = column(spark, ["2024-01-01", "2021-01-01", "2024-03-01", "2024-12-08", None]).withColumn("d", F.to_date("x"))
    got = temporal.date_features(rows, "d").orderBy("i").collect()
    assert got[0]["d_weekday"] == 0 and got[0]["d_weekday_name"] == "Monday" and got[0]["d_season"] == "Winter"
    assert got[1]["d_week_of_year"] == 53
    assert got[2]["d_day_of_year"] == 61 and got[2]["d_season"] == "Spring"
    assert got[3]["d_is_weekend"] is True
    assert got[4]["d_year"] is None and got[4]["d_is_weekend"] is False
    assert temporal.date_features(rows, "absent").columns == rows.columns


@pytest.mark.parametrize(
    "clock, part",
    [("05:59", "Night"), ("06:00", "Morning"), ("12:00", "Afternoon"), ("18:00", "Evening"), ("22:00", "Night"),
     (None, "Night"), ("25:05", "Night"), ("7:5", "Morning")],
)
def test_part_of_day(spark, clock, part):
    rows = column(spark, [clock, "00:00"])
    assert temporal.time_parts(rows, "x").where("i = 0").first()["x_time_of_day"] == part


def test_no_time_columns_without_a_time(spark):
    assert temporal.time_parts(column(spark, ["bad", None]), "x").columns == ["i", "x", "x_parsed"]


def test_accident_dates(spark):
    rows = spark.createDataFrame(
        [("2023", "5"), ("2023.0", "12"), ("2023", None), (None, "5"), ("2023", "13"), ("x", "1")], "y string, m string"
    )
    got = [str(r["d"]) for r in rows.select(dates.accident_date("y", "m").alias("d")).collect()]
    assert got == ["2023-05-01", "2023-12-01", "2023-01-01", "None", "None", "None"]


def test_date_layouts(spark):
    raw = ["2023-01-15", "2023-01", "01/15/2023", "1-5-2023", "2023/01/15", "15/01/2023", "2023", "2023-01-15 14:30:00",
           " 2023-1-5 ", "garbage", None, "2023-13-45"]
    got = [r["x"] for r in temporal.normalize_dates(column(spark, raw), "x").orderBy("i").collect()]
    assert got == ["2023-01-15", "2023-01-01", "2023-01-15", "2023-01-05", "2023-01-15", "2023-01-15", "2023-01-01",
                   "2023-01-15", "2023-01-05", None, None, None]


def test_number_coercion(spark):
    got = [r["x"] for r in temporal.to_number(column(spark, ["1", "x", None, "2.5", "nan"]), ["x", "absent"]).collect()]
    assert got == [1.0, None, None, 2.5, None]
