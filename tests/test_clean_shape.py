import datetime as dt

from pyspark.sql import functions as F

from trove.functions import clean as C
from trove.functions import shape as S


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()["o"]


def test_strip_html(spark):
    assert one(spark, C.strip_html, "  <b>Hi</b> there <i>x</i>\n") == "Hi there x"
    # a tag spanning a newline is not a tag
    assert one(spark, C.strip_html, "a <b\n>c") == "a <b\n>c"
    assert one(spark, C.strip_html, None) == ""
    assert one(spark, C.strip_html, "") == ""


def test_safe_float(spark):
    assert one(spark, C.safe_float, "7.5") == 7.5
    assert one(spark, C.safe_float, " 8 ") == 8.0
    assert one(spark, C.safe_float, "") is None
    assert one(spark, C.safe_float, "N/A") is None
    assert one(spark, C.safe_float, None) is None


def test_safe_list(spark):
    assert one(spark, C.safe_list, None, "v array<string>") == []
    assert one(spark, C.safe_list, [" a ", "", "  ", "b"], "v array<string>") == ["a", "b"]
    assert one(spark, C.safe_list_json, '["x", " y "]') == ["x", "y"]
    assert one(spark, C.safe_list_json, '"solo"') == ["solo"]
    assert one(spark, C.safe_list_json, "null") == []


def test_parse_date_multi(spark):
    assert one(spark, C.parse_date_multi, "1999-02-13") == dt.date(1999, 2, 13)
    assert one(spark, C.parse_date_multi, "1999") == dt.date(1999, 1, 1)
    assert one(spark, C.parse_date_multi, "2/13/1999") == dt.date(1999, 2, 13)
    assert one(spark, C.parse_date_multi, "13/02/1999") == dt.date(1999, 2, 13)
    assert one(spark, C.parse_date_multi, "junk") is None
    assert one(spark, C.parse_date_multi, None) is None


def test_trim_default(spark):
    assert one(spark, C.trim_default, None) == ""
    assert one(spark, C.trim_default, " \tTitle\n") == "Title"


def test_release_year(spark):
    assert one(spark, S.release_year, "1999-02-13") == "1999"
    assert one(spark, S.release_year, "02/13/1999") == "1999"
    assert one(spark, S.release_year, "02/13/") == "02"
    assert one(spark, S.release_year, "19991231") == "1999"
    assert one(spark, S.release_year, None) == "Unknown"


def test_score_band(spark):
    vals = [None, 0.0, -1.0, 5.9, 6.0, 7.9, 8.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r["b"] for r in df.select(S.score_band(F.col("s")).alias("b")).collect()]
    assert got == [None, None, None, "low", "medium", "medium", "high", "high"]


def test_truncate_and_lists(spark):
    assert one(spark, lambda c: S.truncate_text(c, 5), "abcdefg") == "abcde..."
    assert one(spark, lambda c: S.truncate_text(c, 5), "abc") == "abc"
    assert one(spark, S.join_list_default, [], "v array<string>") == "Unknown"
    assert one(spark, S.join_list_default, None, "v array<string>") == "Unknown"
    assert one(spark, S.join_list_default, ["a", "b"], "v array<string>") == "a, b"


def test_review_objects_keep_position(spark):
    got = one(spark, S.review_objects, ["good", "  ", None, " fine "], "v array<string>")
    assert [(r["source"], r["review"]) for r in got] == [("Critic 1", "good"), ("Critic 4", "fine")]


def test_display_score(spark):
    df = spark.createDataFrame([(0.0, None, 7.0), (0.1234, 0.5, 1.0), (None, None, None)], "a double, b double, c double")
    got = [r["d"] for r in df.select(S.display_score(F.col("a"), F.col("b"), F.col("c")).alias("d")).collect()]
    assert got == ["7.00", "0.12", "N/A"]
