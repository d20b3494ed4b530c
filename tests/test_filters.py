import pytest
from pyspark.sql import functions as F

from quilldex.plans.filters import FilterError, compile_filter, equal_all, text_filter

ROWS = [(1, 22, "A", True, 0.5), (2, 21, "B", True, 1.0), (3, 20, "C", True, 12.0), (3, 27, "C", False, 1e10), (5, 25, "C", True, None), (6, 19, "D", True, -2.5), (7, None, None, None, float("nan"))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, age int, name string, gender boolean, size double")


def ids(rows, expression):
    return [r.id for r in rows.filter(compile_filter(expression, rows.schema)).orderBy("id", "age").collect()]


def one(column, op, value):
    return {"column": column, "op": op, "value": value}


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (one("age", "GT", 50), []),
        (one("age", "GTE", 22), [1, 3, 5]),
        (one("name", "EQ", "A"), [1]),
        ({"and": [one("age", "GTE", 20), one("name", "EQ", "C")]}, [3, 3, 5]),
        (one("age", "NEQ", 22), [2, 3, 3, 5, 6]),  # a missing value matches no operator
        (one("age", "EQ", 22.0), []),  # equality is typed
        (one("age", "LT", 21.5), [2, 3, 6]),
        (one("age", "GTE", "25"), [3, 5]),
        (one("gender", "GT", False), [1, 2, 3, 5, 6]),
        (one("name", "GTE", "C"), [3, 3, 5, 6]),
        ({"or": []}, []),
        ({"or": [{"and": [one("age", "GT", 20), one("gender", "EQ", True)]}, one("name", "EQ", "D")]}, [1, 2, 5, 6]),
    ],
)
def test_truth_table(rows, expression, want):
    assert ids(rows, expression) == want


@pytest.mark.parametrize(
    "expression",
    [{}, {"and": []}, one("age", "LIKE", 1), one("none", "EQ", 1), one("age", "GT", True), one("gender", "LT", 1), one("age", "GT", "abc"), one("age", "EQ", None), {"column": "age"}, one("age", "EQ", [1])],
)
def test_refused_before_a_job_runs(rows, expression):
    with pytest.raises(FilterError):
        compile_filter(expression, rows.schema)


def test_texts_against_numbers_fail_on_rows_that_are_none(rows):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ids(rows, one("name", "GT", 5))


def test_schemaless_filter(rows):
    got = lambda wanted: [r.id for r in rows.filter(text_filter(wanted, rows.schema)).collect()]
    assert got({"size": "12"}) == [3] and got({"size": "10000000000"}) == [3] and got({"size": "0.5"}) == [1]
    assert got({"gender": "true", "name": "C"}) == [3, 5] and got({}) == [] and got({"age": "x"}) == []
    with pytest.raises(FilterError):
        text_filter({"none": "1"}, rows.schema)


def test_deleting_coerces_to_the_column(rows):
    assert rows.filter(equal_all({"age": 22.0, "size": 0.5}, rows.schema)).count() == 1
    assert rows.filter(equal_all({"size": 1}, rows.schema)).count() == 1


def test_filters_reach_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    found = t.filter(compile_filter({"or": [{"and": [one("age", "GT", 20), one("size", "LT", 5.0)]}, one("name", "EQ", "D")]}, t.schema)).select(F.col("id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThan(age,20),LessThan(size,5.0)),EqualTo(name,D))]" in plan
