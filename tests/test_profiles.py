import math
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import fields as fl
from millrace.functions import producers, recipes
from millrace.model import population
from millrace.operators import profiles as pf
from millrace.plans import query as q


def test_moments(spark):
    p = population(spark.createDataFrame([(1, "é\n🌍\r\nend"), (2, "abc"), (3, "")], "doc_id long, text string"), corpus=F.lit("c"))
    assert tuple(pf.text_profile(p).first()) == (3, 15, 11, 2)
    r = pf.numeric(p, ["n_chars"]).first()
    assert r["mean"] == pytest.approx(11 / 3) and {x["value"] for x in pf.quantiles(p, "n_chars", [0.5]).collect()} == {3.0}
    kept = q.Query(p, (q.where(fl.CHARACTERS > 0),)).rows()
    r = pf.numeric(kept, ["n_chars"]).first()
    assert (r["mean"], r["deviation"]) == (5.5, 2.5) and pf.quantiles(kept, "n_chars", [0.9]).first()["value"] == 8
    with pytest.raises(TypeError):
        pf.quantiles(p, "text", [0.5])


def test_large_integers_and_weights(spark):
    df = spark.createDataFrame([(2**60 + k, k) for k in range(3)] + [(None, 5)], "x long, w int")
    r = pf.numeric(df, ["x"]).first()
    assert r["deviation"] == pytest.approx(math.sqrt(2 / 3)) and (r["documents"], r["missing"]) == (3, 1)
    small = spark.createDataFrame([(1, 3), (5, 1)], "x long, w long")
    r = pf.numeric(small, ["x"], weight="w").first()
    assert (r["mean"], r["deviation"], r["documents"]) == (2.0, pytest.approx(statistics.pstdev([1, 1, 1, 5])), 4)
    by = {x["g"]: x["mean"] for x in pf.numeric(small.withColumn("g", F.col("w") > 1), ["x"], "g").collect()}
    assert by == {True: 1.0, False: 5.0}


def test_histograms(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 400, 5000)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "x long")
    found = sorted(tuple(r) for r in pf.histogram(df, "x").collect())
    assert len(found) <= 64 and sum(n for *_, n in found) == 5000
    assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
    real = sorted(v for v in values if v is not None)
    for p in (0.0, 0.3, 0.5, 0.99, 1.0):
        lower, upper = pf.quantile_range(found, p)
        assert lower <= real[max(1, math.ceil(p * 5000)) - 1] <= upper
    few = pf.histogram(spark.createDataFrame([(1,), (1,), (9,)], "x long"), "x").collect()
    assert sorted(tuple(r) for r in few) == [(1, 1, 2), (9, 9, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=60), st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.integers(-1, 10)), max_size=4))
def test_estimates_hold_the_truth(rows, tests):
    def buckets(values):
        values = sorted(values)
        return [(part[0], part[-1], len(part)) for part in (list(x) for x in np.array_split(values, min(3, len(values)))) if len(part)]

    held = {"x": buckets([a for a, _ in rows]), "y": buckets([b for _, b in rows])}
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    truth = sum(all(ops[op]({"x": a, "y": b}[name], v) for name, op, v in tests) for a, b in rows)
    e = pf.estimate(len(rows), held, tests)
    assert e.lower <= truth <= e.upper and e.lower <= e.expected <= e.upper
    assert pf.union_estimate([e, pf.Estimate(0, 5)]).upper == e.upper + 5


def test_producers(spark):
    df = spark.createDataFrame([(1, "The cat, 42 times... OK"), (2, ""), (3, "  ")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in producers.with_statistics(df).collect()}
    assert (r[1]["n_words"], r[1]["digit_ratio"], r[1]["uppercase_ratio"]) == (5, 2 / 23, 3 / 23)
    assert r[1]["elipsis_ratio"] == 1 / 23 and r[1]["punctuation_ratio"] == 4 / 23 and r[1]["stop_word_ratio"] == 1 / 5
    assert r[2]["n_words"] == 0 and r[2]["digit_ratio"] is None and r[3]["white_space_ratio"] == 1.0 and r[3]["avg_word_length"] is None
    scored = producers.from_pandas("score", "double", lambda s: s.str.len().astype("float64").where(s != "", None))(df)
    assert {x["doc_id"]: x["score"] for x in scored.collect()}[1] == 23.0
    values = spark.createDataFrame([(1, 0.5), (2, None)], "doc_id long, v double")
    assert producers.joined(df, values, ["v"]).count() == 3
    with pytest.raises(Exception, match="no values for 3"):
        producers.joined(df, values, ["v"], complete=True).collect()
    lab = spark.createDataFrame([([0.2, 1.5, 1.2],)], "s array<double>").select(producers.language_label(F.col("s"), ["a", "b", "c"])).first()[0]
    assert lab == "b"
    mean = spark.sql("select array(named_struct('score', 1.0d, 'weight', 3.0d), named_struct('score', 5.0d, 'weight', 1.0d)) w").select(producers.windowed_mean(F.col("w"))).first()[0]
    assert mean == 2.0 and isinstance(pd.Series([1]), pd.Series)


def test_recipes(spark):
    prose = "The people of this town have to be here with all that they know and more of it. " * 5
    rows = [(1, prose, "a"), (2, "short text", "b"), (3, "spam spam spam spam " * 40, "c"), (4, "line one is short.\nkeep this line as it has words.\nand this one is fine as well.\nno end here\nthe last line is kept too!", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source_key string")
    assert {r["doc_id"] for r in recipes.gopher_quality(df).collect()} == {1}
    worst = {r["doc_id"]: r["worst"] for r in recipes.repetition_shares(df).collect()}
    assert worst[3] > 1 and worst[4] <= 1
    assert {r["doc_id"] for r in recipes.gopher_repetition(df).collect()} >= {2, 4}
    clean = {r["doc_id"]: r["text"] for r in recipes.c4_lines(df).collect()}
    assert clean[4] == "keep this line as it has words.\nand this one is fine as well.\nthe last line is kept too!" and 2 not in clean
    assert 4 not in {r["doc_id"] for r in recipes.c4_lines(df, blocked=("last",)).collect()}
    many = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as source_key")
    assert recipes.pareto(many, F.lit(1.0)).count() == 4000
    assert recipes.pareto(many, F.lit(0.5)).count() / 4000 == pytest.approx(1.5**-9, abs=0.01)
    with pytest.raises(Exception, match="a score is finite"):
        recipes.pareto(many, F.lit(2.0)).count()
    assert all(math.fsum(recipes.source_weights(m).values()) == pytest.approx(1) for m in recipes.WEIGHTS)
