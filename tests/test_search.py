import pytest

from quillmark.operators.search import search, search_name_or_id


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Alice", "HR", 1), ("Bob", "IT", 2), ("Charlie", "HR", 3), ("David", "Finance", 4)], "name string, dept string, id int")


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_global(people):
    assert names(search(people, "hr")) == ["Alice", "Charlie"]


def test_column(people):
    assert names(search(people, "bob", "column", "name")) == ["Bob"]
    assert names(search(people, "hr", "column", "name")) == []


def test_strict(people):
    assert names(search(people, "hr", "strict")) == ["Alice", "Charlie"]
    assert names(search(people, "h", "strict")) == []


def test_empty_query_gives_all(people):
    assert search(people, "").count() == 4
    assert search(people, None).count() == 4


def test_mixed_case(people):
    assert names(search(people, "aLiCe")) == ["Alice"]


def test_number(people):
    assert names(search(people, 3)) == ["Charlie"]


def test_special_characters(spark):
    df = spark.createDataFrame([("Ann-Marie", 10), ("O'Connor", 11), ("Smith", 12), (None, None)], "name string, id int")
    assert names(search(df, "ann-marie")) == ["Ann-Marie"]
    assert names(search(df, "o'connor")) == ["O'Connor"]
    assert names(search(df, "o.connor")) == ["O'Connor"]
    assert names(search(df, "o.connor", literal=True)) == []


def test_no_match(people):
    assert search(people, "zzz").count() == 0


def test_bad_column(people):
    with pytest.raises(ValueError, match="not found"):
        search(people, "x", "column", "nope")
    with pytest.raises(ValueError):
        search(people, "x", "column")
    with pytest.raises(ValueError):
        search(people, "x", "other")


def test_name_or_id(spark):
    df = spark.createDataFrame([("7", "Aa"), ("8", "Bb"), (None, None)], "delegate_id string, fullname string")
    assert [r.delegate_id for r in search_name_or_id(df, "b|7").orderBy("delegate_id").collect()] == ["7", "8"]
