import pytest
from pyspark.sql import functions as F

from sparkvec.operators import filters as X
from sparkvec.operators.filters import Filter, FilterError, both, either, leaf, negated


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 10.5, "A", True, "2024-01-01 00:00:00"), (2, 20.0, "B", False, "2024-01-02 00:00:00"), (3, 30.5, "A", None, "2024-01-03 00:00:00"), (4, 40.0, "C", True, None), (5, None, None, False, "2024-01-05 00:00:00")]
    return spark.createDataFrame(rows, "id bigint, score double, category string, ok boolean, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("small", F.col("id").cast("tinyint"))


def ids(df, *f, **how):
    return sorted(r["id"] for r in X.apply(df, f, **how).collect())


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (leaf("id", ">", 3), [4, 5]), (leaf("category", "eq", "A"), [1, 3]), (leaf("score", "<=", "20.0"), [1, 2]), (leaf("score", "!=", 20), [1, 3, 4]),
        (leaf("category", "<>", "A"), [2, 4]), (leaf("category", "ge", "B"), [2, 4]), (leaf("ok", "=", "true"), [1, 4]), (leaf("ok", "==", "0"), [2, 5]),
        (leaf("ts", ">=", "2024-01-02T00:00:00Z"), [2, 3, 5]), (leaf("ts", "<", "2024-01-02T01:00:00+01:00"), [1]), (leaf("small", "in", "1, 2,x"), [1, 2]),
        (leaf("category", "IN", '["A", "C"]'), [1, 3, 4]), (leaf("id", "not in", "1,2"), [3, 4, 5]), (leaf("id", "in", "x,y"), []), (leaf("id", "not_in", "x"), [1, 2, 3, 4, 5]),
        (leaf("category", "like", "A"), [1, 3]), (leaf("category", "contains", "%"), []), (negated(leaf("category", "=", "A")), [2, 4]),
        (either(leaf("id", "=", 1), leaf("score", ">", 35)), [1, 4]), (both(leaf("category", "=", "B"), leaf("id", ">", 2)), []),
        (negated(either(leaf("score", ">", 15), leaf("category", "=", "Z"))), [1]), (either(leaf("nope", "=", 1), leaf("id", "=", 2)), [2]), (negated(leaf("nope", "=", 1)), []),
    ],
)
def test_matrix(df, f, want):
    assert ids(df, f) == want


def test_lists_unknown_fields_and_errors(df):
    assert ids(df) == [1, 2, 3, 4, 5]
    assert ids(df, leaf("category", "=", "A"), leaf("id", ">", 1)) == [3]
    assert ids(df, leaf("nope", "=", 1), leaf("id", "=", 1)) == [1]
    for bad in (leaf("nope", "=", 1), leaf("id", "=", "x"), leaf("id", "~", 1), Filter(logic="NOT"), Filter(logic="XOR"), leaf("id", "contains", "1"), leaf("ok", "=", "yes")):
        with pytest.raises(FilterError):
            ids(df, bad)
    with pytest.raises(FilterError):
        ids(df, leaf("nope", "=", 1), leaf("id", "=", 1), strict=True)


def test_parse():
    f = X.parse({"logic": "or", "filters": [{"field": "a", "op": "eq", "value": 1.5, "extra": 1}, {"field": "b", "operator": ">", "value": "x"}]})
    assert f == either(leaf("a", "eq", "1.5"), leaf("b", ">", "x"))
    assert X.parse({"field": "a", "value": "1", "filters": None}).op == "="
    with pytest.raises(FilterError):
        X.parse({"field": "a", "value": True})


def test_pushed_to_the_scan(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/t")
    plan = X.apply(spark.read.parquet(f"{tmp_path}/t"), [leaf("id", ">", 3), leaf("category", "=", "A")]).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "EqualTo(category,A)" in plan and "score" not in plan.split("ReadSchema")[1]
