from pyspark.sql import functions as F

from loomline.functions import text


def one(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_titles(spark):
    got = one(spark, text.undouble, ["ABAB", "Foo Foo", "Abc", None, "\t xyz ", "", "a"])
    assert got == ["AB", "Foo", "Abc", None, "xyz", "", ""]  # by the rule, one letter is its own longer half, and the first half is empty


def test_export_lines(spark):
    got = one(spark, text.drop_export_lines, ["x\nPage 1 of 3\ny", "x\r\nPage 1 of 3\r\ny", "a\n\n\n\nb", "q\nload-date: 1 mei\nz", None, ""])
    assert got == ["x\n\ny", "x\r\n\ny", "a\n\nb", "q\n\nz", None, ""]


def test_words_hits_lists(spark):
    assert one(spark, text.word_count, ["a  b c", "", None]) == [3, 0, 0]
    terms = F.array(F.lit("aa"), F.lit("A"), F.lit(""))
    assert one(spark, lambda c: text.count_hits(c, terms), ["aaa", None, ""]) == [1 + 3, 0, 0]
    assert one(spark, text.parse_list, ["['a', ' b ']", "[]", "['a'", "nan", None]) == [["a", "b"], [], None, None, None]


def test_yes_no_and_dates(spark):
    assert one(spark, text.yes_no, ["Yes", " no ", "null", "", "maybe", None]) == ["yes", "no", None, None, None, None]
    got = one(spark, text.parse_date, ["garbage", "2014-01-01", "2023-12-31 10:00:00", "17-05-2021", None, ""])
    assert [None if d is None else str(d) for d in got] == [None, "2014-01-01 00:00:00", "2023-12-31 10:00:00", "2021-05-17 00:00:00", None, None]


def test_half_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.78125), 4).alias("x")).first()["x"] == 0.7812
