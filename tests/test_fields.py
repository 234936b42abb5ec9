import math
import operator

import pytest
from pyspark.sql import functions as F

from millrace.functions import fields as fl
from millrace.functions import text as T

OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
INTEGERS = [None, -(2**63), -1, 0, 2**53, 2**53 + 1, 2**60, 2**60 + 1, 2**63 - 1]
FLOATS = [None, -math.inf, -1.5, 0.0, 0.1, math.nextafter(0.1, 1), 2.0**53, 2.0**60, 1e300]


@pytest.mark.parametrize("kind,values", [("integer", INTEGERS), ("number", FLOATS)])
def test_comparisons_equal_python(spark, kind, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {'long' if kind == 'integer' else 'double'}")
    constants = [c for c in INTEGERS + FLOATS + [0.5, 2**64, -1e30] if c is not None and math.isfinite(c)]
    field = fl.Field("x", kind)
    tests = [(op, c, field._compare(op, c)) for op in OPS for c in constants]
    found = df.select("k", *[F.coalesce(p.column, F.lit(False)).alias(f"t{i}") for i, (*_, p) in enumerate(tests)]).collect()
    for row in found:
        for i, (op, c, _) in enumerate(tests):
            v = values[row["k"]]
            assert row[f"t{i}"] == (v is not None and OPS[op](v, c)), (v, op, c)


def test_texts_compare_by_code_point(spark):
    values = [None, "", "a", "é", "🌍", "￿"]
    df = spark.createDataFrame([(v,) for v in values], "source_key string")
    for op, f in OPS.items():
        got = {r[0] for r in df.where(fl.URI._compare(op, "é").column).collect()}
        assert got == {v for v in values if v is not None and f(v, "é")}


def test_what_predicates_refuse():
    text = fl.Field("lang", "text")
    with pytest.raises(TypeError):
        bool(fl.Field("x", "integer") > 3)
    with pytest.raises(TypeError):
        3 < fl.Field("x", "integer") < 5
    with pytest.raises(TypeError):
        text < "de"
    with pytest.raises(TypeError):
        text == 3
    with pytest.raises(ValueError):
        fl.BYTES >= -1
    with pytest.raises(ValueError):
        fl.Field("x", "number") > math.nan
    with pytest.raises(NotImplementedError):
        fl.CORPUS == "a"
    with pytest.raises(IndexError):
        fl.VectorField("v", 3).component(3)
    with pytest.raises(KeyError):
        fl.ClassField("t", ["a"])["b"]
    with pytest.raises(TypeError):
        fl.ClassField("t", ["a"], "sigmoid").label


def test_classes(spark):
    df = spark.createDataFrame([([10000.0, 10001.0, -10000.0],), ([1.0, 1.0, 0.0],), ([1000.0, -1000.0, 0.0],)], "t array<double>")
    soft, sig = fl.ClassField("t", ["Z", "A", "B"]), fl.ClassField("t", ["Z", "A", "B"], "sigmoid")
    rows = df.select(soft.probabilities().alias("p"), soft.label.column.alias("top"), sig.probabilities().alias("s")).collect()
    assert [r["top"] for r in rows] == ["A", "Z", "Z"] and all(abs(sum(r["p"]) - 1) < 1e-12 for r in rows)
    assert rows[2]["s"] == [1.0, 0.0, 0.5]
    assert df.where((soft.label == "A").column).count() == 1


def test_null_tests(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    x = fl.Field("x", "integer").is_null()
    assert [df.where(p.column).count() for p in (x, x == False, x != True, x != False)] == [1, 1, 1, 1]  # noqa: E712
    assert df.where((x == False).column).first()[0] == 1  # noqa: E712


def test_words_are_pythons(spark):
    text = "a\x1cb c\xa0d e\x85f​g"
    got = spark.createDataFrame([(text,), ("",), (" ",)], "t string").select(T.words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [text.split(), [], []]


def test_strata_keys(spark):
    df = spark.createDataFrame([('a"b', 6, None)], "s string, n long, z string")
    one = df.select(T.stratum([(F.col("s"), True)]).alias("a"), T.stratum([(F.col("n"), False)]).alias("b"), T.stratum([(F.col("s"), True), (F.col("n"), False), (F.col("z"), True)]).alias("c"), T.stratum([]).alias("d")).first()
    assert tuple(one) == ('a"b', "[6]", '["a\\"b",6,null]', "[]")
