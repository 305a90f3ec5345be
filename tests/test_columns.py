import datetime as dt

from pyspark.sql import functions as F

from quillmark.functions import columns as X
from quillmark.functions import names as N


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_ids(spark):
    assert values(spark, [("12.0",), (" 7 ",), (None,), ("a.0",)], "a string", X.canonical_id(F.col("a"))) == ["12", "7", "", "a.0"]
    assert values(spark, [("nan",), (None,), ("5",), ("<NA>",)], "a string", X.is_null_id(F.col("a"))) == [True, True, False, True]


def test_distances(spark):
    rows = [("abc", "abd"), ("", ""), ("abc", ""), (None, "a"), ("thoë", "thoe")]
    assert values(spark, rows, "a string, b string", X.distance(F.col("a"), F.col("b"))) == [1 / 3, 0.0, 1.0, None, 0.25]
    assert values(spark, rows[:3], "a string, b string", F.bround(X.overlap_distance(F.col("a"), F.col("b")), 6)) == [0.333333, 0.0, 1.0]


def test_split_points(spark):
    assert values(spark, [("ab cdefghi",), ("abc",), ("abcdefghij",)], "a string", X.split_points(F.col("a"))) == [[2, 3, 4, 5, 6, 7], [], [3, 4, 5, 6, 7]]


def test_texts(spark):
    one = lambda v, f: values(spark, [(v,)], "a string", f(F.col("a")))[0]
    assert one("  Van  DER\tA ", X.normalise) == "van der a"
    assert one("Dekker, Jan", X.surname) == "dekker"
    assert one("a; b|c/d\\e;;", X.pattern_parts) == ["a", "b", "c", "d", "e"]
    assert tuple(one("a b c", X.word_halves)) == ("a", "b c")
    birth, death = X.lifespan(F.col("a"))
    assert values(spark, [("1712-1790",), ("1712 - ",), ("x",)], "a string", F.struct(birth, death)) == [(1712, 1790), (None, None), (None, None)]


def test_days(spark):
    day = X.day_key(F.col("d"), F.col("y"), F.col("m"), F.col("n"))
    rows = [("1780-02-03", 1, 1, 1), (None, 1781, 2, 3), ("bad", 1782, None, None), (None, 1783, 2, 31)]
    got = values(spark, rows, "d string, y int, m int, n int", day)
    assert got[:2] == [dt.date(1780, 2, 3), dt.date(1781, 2, 3)]
    assert got[3] == dt.date(1783, 1, 1)


def test_ngrams(spark):
    got = values(spark, [("ab c",)], "a string", X.char_ngrams(F.col("a")))[0]
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert values(spark, [("Ab c d",)], "a string", X.word_ngrams(F.col("a")))[0] == ["ab", "c", "d", "ab c", "c d"]


def test_prefixes(spark):
    one = lambda v, f: values(spark, [(v,)], "a string", f(F.col("a")))[0]
    assert one("vau Wassenaer", N.normalise_prefix) == "van Wassenaer"
    assert tuple(one("vau Wassenaer", N.strip_prefix)) == ("van", "Wassenaer")
    assert tuple(one("Dekker", N.strip_prefix)) == ("", "Dekker")
    assert one("dekker", N.strip_infix) == "kker"
    assert one("van der ", N.is_prefix_only) and not one("van der Aa", N.is_prefix_only)
    assert one("Lunae den 3", N.is_session_header) and not one("Martina", N.is_session_header)
    assert one(None, N.is_session_header) is False
    d = values(spark, [("vau Aa", "Aa"), ("van Bb", "van Bb")], "a string, b string", N.prefix_distance(F.col("a"), F.col("b")))
    assert d == [0.0, 0.0]


def test_generated_id(spark):
    df = spark.createDataFrame([("added_07",), ("5",), ("added_123",)], "delegate_id string")
    assert X.next_generated_id(df).first()[0] == "added_124"
    assert X.next_generated_id(df.limit(0)).first()[0] == "added_01"


def test_resolve_and_clean(spark):
    df = spark.createDataFrame([(" x_x000D_y ", 1)], "naam string, k int")
    out = X.resolve(X.clean_strings(df), {"fullname": ["naam"], "death_year": ["overlijden"]})
    assert out.first().asDict() == {"k": 1, "fullname": "x y", "death_year": None}
