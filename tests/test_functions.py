import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from feedbackmill.functions import dates, labels, ratings, text
from feedbackmill.operators import dashboard, runs, terms
from feedbackmill.operators.aspects import aspect_mentions
from feedbackmill.schemas import REVIEWS
from feedbackmill.sources.records import parse_records, prefer

AS_OF = date(2025, 1, 31)


def apply(spark, fn, values, kind="string"):
    """Result of a column function on each value, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def reviews_frame(spark, rows):
    """Review rows given as dicts; columns left out are null."""
    names = [f.name for f in REVIEWS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REVIEWS)


@pytest.mark.parametrize(
    "wording, expected",
    [
        ("a month ago", "2025-01-01"),
        ("2 weeks ago", "2025-01-17"),
        ("3 years ago", "2022-02-01"),
        ("yesterday", "2025-01-30"),
        ("today", "2025-01-30"),
        ("5 hours ago", "2025-01-31"),
        ("0 days ago", "2025-01-31"),
        ("", "Unknown"),
        (" \t", "Unknown"),
        (None, "Unknown"),
        (" UNKNOWN ", "Unknown"),
        ("2024/05/06", "2024/05/06"),
        (" 2024-05-06T10:00Z ", "2024-05-06t10:00z"),
        ("1 year 2 months ago", "2013-02-03"),
        ("99999 years ago", "2025-01-31"),
        ("9" * 30 + " days ago", "2025-01-31"),
        ("an hour", "2025-01-31"),
        ("Edited a week ago", "2025-01-24"),
    ],
)
def test_normalize_date(spark, wording, expected):
    got = apply(spark, lambda c: dates.normalize_date(c, F.lit(AS_OF)), [wording])
    assert got == [expected]


def test_month_period(spark):
    forms = [
        "2024-01-05", "2024-01-05t10:11:12z", "1/5/2024", "12/31/2023", "2024/1/5", "2024-13-40",
        "Unknown", None, "soon - maybe", "2/5/2024 9:30", "2024/2/5 09:30:01", "02-05-2024",
    ]
    assert apply(spark, dates.month_period, forms) == [
        "2024-01", "2024-01", "2024-01", "2023-12", "2024-01", "Unknown", "Unknown", "Unknown",
        "Unknown", "2024-02", "2024-02", "2024-02",
    ]


def test_month_names(spark):
    forms = ["Jan 5, 2024", "february 7 2024", "5 MAR 2024", "5-apr-2024", "May-05-2023", "jun/5/2023", "12/July/2023", "31 Smarch 2024", "Feb 31, 2024"]
    assert apply(spark, dates.month_period, forms) == [
        "2024-01", "2024-02", "2024-03", "2024-04", "2023-05", "2023-06", "2023-07", "Unknown", "Unknown",
    ]


def test_fill_unknown_date(spark):
    df = spark.createDataFrame([("Unknown", 3), ("2020-01-01", 4)], "d string, p long")
    out = dates.fill_unknown_date(F.col("d"), F.col("p"), F.lit(AS_OF))
    assert [r[0] for r in df.select(out).collect()] == ["2025-01-28", "2020-01-01"]


def test_parse_rating(spark):
    given = ["5", " 4.5 ", "4e0", ".5", "3.", "5d", "nan", "inf", "1e999", "", None, "five", "-2"]
    assert apply(spark, ratings.parse_rating, given) == [
        5.0, 4.5, 4.0, 0.5, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -2.0
    ]
    assert apply(spark, ratings.first_number, ["4.0 stars", "none", ""]) == [4.0, 0.0, 0.0]


def test_rating_bucket(spark):
    given = [None, math.nan, -2.5, -0.5, 0.0, 0.4, 0.5, 2.5, 4.5, 5.5]
    assert apply(spark, ratings.rating_bucket, given, "double") == [1, 1, -2, 1, 1, 1, 1, 3, 5, 6]
    assert apply(spark, ratings.half_up, [2.5, 3.49], "double") == [3, 3]
    assert apply(spark, ratings.two_decimals, [2.0, 1.236], "double") == ["2.00", "1.24"]


def test_text(spark):
    given = [None, "", "   ", " a  b\n\tc\x1cd ", "x  y", "　z"]
    assert apply(spark, text.clean_text, given) == ["", "", "", "a b c d", "x y", "z"]
    assert apply(spark, text.utf16_length, [None, "", "ab", "\U0001f600x"]) == [0, 0, 2, 3]
    words = apply(spark, text.chart_tokens, ["Don't STOP now 4you\nü", None, " "])
    assert words == [["dont", "stop", "now", "you"], [], []]
    assert apply(spark, text.chart_words, ["Don't STOP now 4you"]) == [["dont", "stop"]]
    assert apply(spark, text.cloud_tokens, ["It's a Café_1 'tis"]) == [["it's", "café_1", "tis"]]
    assert apply(spark, text.feature_tokens, ["It's a Café_1"]) == [["it", "café_1"]]


def test_labels(spark):
    given = ["Positive", "positive", None, "", "Neutral"]
    assert apply(spark, labels.valid_sentiment, given) == [
        "Positive", "Neutral", "Neutral", "Neutral", "Neutral"
    ]
    assert apply(spark, labels.sentiment_or_neutral, given) == [
        "Positive", "positive", "Neutral", "Neutral", "Neutral"
    ]
    replies = ['```json\n{"sentiments": ["Negative", "x"]}\n```', "no", '{"sentiments": "a"}', None]
    parsed = apply(spark, lambda c: labels.parse_sentiments(c, F.lit(3)), replies)
    assert parsed == [["Negative", "Neutral", "Neutral"]] + [["Neutral"] * 3] * 3
    assert apply(spark, lambda c: labels.parse_sentiments(c, F.lit(0)), ["x"]) == [[]]
    plan = apply(
        spark,
        lambda c: labels.parse_struct(c, "sql string, g boolean", sql="", g=False),
        ['```json{"sql": "select 1"}```', "??"],
    )
    assert [tuple(p) for p in plan] == [("select 1", False), ("", False)]
    terms_of = F.array(F.lit("pizza"), F.lit("4star"))
    assert spark.range(1).select(labels.title_case(terms_of)).first()[0] == "Pizza, 4star"
    record = spark.createDataFrame([(1, None)], "a int, b string").select(labels.record_json())
    assert record.first()[0] == '{"a":1,"b":null}'


def test_dashboards_on_edges(spark):
    rows = reviews_frame(spark, [
        {"id": 1, "business_url": "u", "rating": None, "sentiment": None, "review_text": None},
        {"id": 2, "business_url": "u", "rating": 5.5, "sentiment": "Positive", "date": "1/2/2024"},
        {"id": 3, "business_url": "u", "rating": 4.5, "sentiment": "odd", "review_text": "abcd"},
        {"id": 4, "business_url": "u", "rating": math.nan, "sentiment": "", "date": "Unknown"},
    ])
    totals = dashboard.dashboard_totals(rows)

    def table(df, key, value):
        return {r[key]: r[value] for r in df.collect()}

    assert table(dashboard.sentiment_breakdown(totals), "sentiment", "n") == {
        "Positive": 1, "Negative": 0, "Neutral": 2
    }
    assert table(dashboard.rating_distribution(totals), "bucket", "n") == {
        1: 2, 2: 0, 3: 0, 4: 0, 5: 1
    }
    assert table(dashboard.avg_rating_by_sentiment(totals), "sentiment", "avg_rating") == {
        "Positive": 5.5, "Negative": 0.0, "Neutral": 0.0
    }
    assert table(dashboard.avg_length_by_rating(totals), "bucket", "avg_length") == {
        1: 0, 2: 0, 3: 0, 4: 0, 5: 4
    }
    cross = dashboard.sentiment_by_rating(totals)
    assert cross.count() == 15 and cross.agg(F.sum("n")).first()[0] == 2
    months = dashboard.monthly_volume_rating(rows).collect()
    assert [(r["period"], r["n"], r["avg_rating"]) for r in months] == [("2024-01", 1, 5.5)]


def test_aspects_on_edges(spark):
    rows = reviews_frame(spark, [
        {"id": 1, "business_url": "u", "sentiment": "Negative",
         "review_text": "Waiter: bad SERVICE, long wait"},
        {"id": 2, "business_url": "u", "review_text": " ", "sentiment": None},
        {"id": 3, "business_url": "u", "review_text": ""},
        {"id": 4, "business_url": "u", "review_text": None},
    ])
    got = sorted((r["review_id"], r["aspect"]) for r in aspect_mentions(rows).collect())
    assert got == [(1, "Service"), (1, "Wait"), (2, "Overall Experience")]


def test_top_words_ties_follow_first_sight(spark):
    rows = reviews_frame(spark, [
        {"id": 2, "business_url": "u", "review_text": "omega alpha gamma delta"},
        {"id": 1, "business_url": "u", "review_text": "zeta zeta gamma the food"},
        {"id": 3, "business_url": "u", "review_text": None},
    ])
    got = [(r["word"], r["n"]) for r in terms.top_words(rows).orderBy("rank").collect()]
    assert got == [("zeta", 2), ("gamma", 2), ("omega", 1), ("alpha", 1), ("delta", 1)]


def test_cloud_terms(spark):
    rows = reviews_frame(spark, [
        {"id": i, "business_url": "u", "sentiment": "Positive",
         "review_text": f"new york pizzas 2024 bob's w{i} y{i}x z{i}q"} for i in range(20)
    ] + [{"id": 99, "business_url": "u", "sentiment": "Positive", "review_text": "pizza"}])
    plain = {r["term"]: r["n"] for r in terms.term_frequencies(rows).collect()}
    assert plain["new"] == 20 and plain["pizzas"] == 20 and plain["pizza"] == 1
    assert plain["bob"] == 20 and "2024" not in plain
    merged = terms.term_frequencies(rows, merge_plurals=True, collocations=True)
    found = {r["term"]: r["n"] for r in merged.collect()}
    assert found["new york"] == 20 and found["york pizzas"] == 20
    assert "new" not in found and "york" not in found


def test_registry_views(spark):
    log = spark.createDataFrame(
        [("a", "pending", 1), ("a", "completed", 2), ("b", "pending", 1), ("b", "failed", 3)],
        "business_url string, status string, ts int",
    )
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "business_url string")
    got = {r["business_url"]: r["status"] for r in runs.status_of(keys, log).collect()}
    assert got == {"a": "completed", "b": "failed", "c": "not_found"}
    assert runs.duplicate_keys(keys).count() == 0 and runs.duplicate_keys(log).count() == 2


def test_records_and_precedence(spark):
    good = '[{"user_name":"A","rating":4,"date":"d","review_text":"t"}, {"rating":"x"}]'
    payloads = spark.createDataFrame(
        [("a", good), ("b", "not json"), ("c", "[]"), ("d", None)], "k string, payload string"
    )
    got = parse_records(payloads).orderBy("item_pos").collect()
    assert [(r["k"], r["item_pos"], r["user_name"], r["rating"]) for r in got][0] == ("a", 0, "A", 4.0)
    assert {r["k"] for r in got} == {"a"}
    first = spark.createDataFrame([("a", 1)], "business_url string, id int")
    second = spark.createDataFrame([("a", 2), ("b", 3)], "business_url string, id int")
    chosen = prefer(first, second, ["id"]).collect()
    assert sorted(tuple(r) for r in chosen) == [("a", 1), ("b", 3)]


def test_stand_in_dates_stay_in_the_calendar(spark):
    rows = spark.createDataFrame([(0,), (1,), (738_000,), (800_000,), (1 << 40,)], "pos long")
    as_of = F.lit("2025-01-31").cast("date")
    got = [r[0] for r in rows.orderBy("pos").select(dates.fill_unknown_date(F.lit("Unknown"), F.col("pos"), as_of)).collect()]
    assert got[:2] == ["2025-01-31", "2025-01-30"] and got[2].startswith("0004-")
    assert got[3:] == ["2025-01-31", "2025-01-31"]
