import pytest
from pyspark.sql import functions as F

from arcavec.operators import filters
from arcavec.plans import filter_language as L

PAYLOADS = [(1, "u=a age=20"), (2, "u=a age=40"), (3, "u=b age=60"), (4, "u=c"), (5, None), (6, "loose words")]
CASES = {
    "u = a": {1, 2}, "age >= 40": {2, 3}, "age > 40": {3}, "age < 40": {1}, "age <= 40": {1, 2}, "age BETWEEN 20 AND 40": {1, 2}, "age between 40 and 20": set(),
    "u = a AND age >= 40": {2}, "u = b OR age < 40": {1, 3}, "u = a AND NOT age = 20": {2}, "NOT u = a AND NOT u = b": {4}, "age EXISTS": {1, 2, 3}, "NOT age EXISTS": {4},
    "NOT u = a": {3, 4}, "u = nobody": set(), "u IN (a, c)": {1, 2, 4}, "(u=a OR u=b) AND age>20": {2, 3}, "NOT NOT u=c": {4}, "u=c OR u=a AND age=20": {1, 4}, "u >= b": {3, 4}, "age < zzz": set(),
}


@pytest.mark.parametrize("text", CASES)
def test_filter_selects(spark, text):
    rows = spark.createDataFrame(PAYLOADS, "vec_id long, payload string")
    assert {r.vec_id for r in rows.where(filters.predicate(text, F.col("payload"))).collect()} == CASES[text]


def test_values_of_several_types_and_counts(spark):
    rows = spark.createDataFrame([(1, "t=a t=b"), (2, "t=b"), (3, "n=1 n=9"), (4, "n=5"), (5, "n=old"), (6, "n=+7")], "vec_id long, payload string")
    ids = lambda text: {r.vec_id for r in rows.where(filters.predicate(text, F.col("payload"))).collect()}
    assert ids("NOT t = a") == {2, 3, 4, 5, 6}
    assert ids("n >= 4 AND n <= 6") == {3, 4}  # each bound by a value of its own
    assert ids("n BETWEEN 4 AND 6") == {4}
    assert ids("n < 2") == {3, 5}  # every keyword is below every integer
    assert ids("n >= m") == {3, 4, 5, 6}
    assert ids("n = 7") == {6}


@pytest.mark.parametrize("text", ["", "u", "u =", "= a", "u = a AND", "(u = a", "u IN a", "u IN (a", "u BETWEEN 1 2", "u = a b", "u ~ a", "AND = a", "u IN ()"])
def test_malformed_filters(text):
    with pytest.raises(L.FilterError):
        L.parse(text)


def test_fields_of_a_payload(spark):
    rows = spark.createDataFrame([(1, "user=alice  age=42\tloose tag= =x a=b=c big=99999999999999999999 n=007 m=-0"), (2, ""), (3, None)], "vec_id long, payload string")
    got = {(r.vec_id, r.field, r.sval, r.ival) for r in filters.explode_fields(rows).collect()}
    assert got == {(1, "user", "alice", None), (1, "age", None, 42), (1, "tag", "", None), (1, "a", "b=c", None), (1, "big", "99999999999999999999", None), (1, "n", None, 7), (1, "m", None, 0)}
