"""Statistics of populations: counts, moments, categories, quantiles, histograms, classifier profiles, steps, estimates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.fields import ClassField
from millrace.scratch import Scratch

BUCKETS = 64


def counts(docs: DataFrame, *by: str) -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("characters"))


def text_profile(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"), F.sum("n_chars").alias("characters"), F.sum(T.newlines(F.col("text"))).alias("newlines"))


#: Integers up to here are exact as doubles.
EXACT = 1 << 53


def numeric(docs: DataFrame, columns: Sequence[str], *by: str, weight: str | None = None) -> DataFrame:
    """A row a column (and group): documents, missing, total, mean, population deviation, min, max of the non-null values.

    One pass over docs, with merged central moments. Only where integers are too large for doubles, or rows have a weight
    (occurrences), a second pass takes deviations from the smallest value.
    """
    w = F.col(weight) if weight else F.lit(1)
    aggs = [F.sum(w).alias("_rows")]
    for c in columns:
        aggs += [F.coalesce(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0)).alias(f"n_{c}"), F.sum(F.col(c) * w).alias(f"total_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.var_pop(F.col(c).cast("double")).alias(f"v_{c}")]
    one = docs.groupBy(*by).agg(*aggs)
    one = Scratch(docs.sparkSession, "numeric").keep(one, "moments") if by else docs.sparkSession.createDataFrame(one.collect(), one.schema)
    whole = [c for c in columns if dict(docs.dtypes)[c] in ("bigint", "decimal(20,0)")]
    far = [F.max(F.greatest(F.abs(F.col(f"min_{c}")), F.abs(F.col(f"max_{c}"))) > EXACT).alias(c) for c in whole]
    again = columns if weight else [c for c, x in one.agg(*far).first().asDict().items() if x] if far else []
    if again:
        shift = lambda c: (F.col(c) - F.col(f"min_{c}")).cast("double")
        lows = one.select(*[F.col(g).alias(f"_by{k}") for k, g in enumerate(by)], *[f"min_{c}" for c in again])
        same = F.lit(True)
        for k, g in enumerate(by):
            same &= F.col(g).eqNullSafe(F.col(f"_by{k}"))
        both = docs.join(lows if by else F.broadcast(lows), same)
        n = lambda c: F.sum(F.when(F.col(c).isNotNull(), w))
        second = both.groupBy(*by).agg(*[((F.sum(shift(c) * shift(c) * w) / n(c)) - F.pow(F.sum(shift(c) * w) / n(c), 2)).alias(f"w_{c}") for c in again])
        second = second.select(*[F.col(g).alias(f"_by{k}") for k, g in enumerate(by)], *[f"w_{c}" for c in again])
        one = one.join(second, same, "left")
    rows = []
    for c in columns:
        n, v = F.col(f"n_{c}"), F.col(f"w_{c}" if c in again else f"v_{c}")
        rows.append(F.struct(F.lit(c).alias("field"), n.cast("long").alias("documents"), (F.coalesce("_rows", F.lit(0)) - n).cast("long").alias("missing"), F.col(f"total_{c}").cast("double").alias("total"), (F.col(f"total_{c}") / n).cast("double").alias("mean"), F.sqrt(F.greatest(v, F.when(v.isNotNull(), 0.0))).alias("deviation"), F.col(f"min_{c}").cast("double").alias("min"), F.col(f"max_{c}").cast("double").alias("max")))
    return one.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def categories(docs: DataFrame, column: Column) -> DataFrame:
    """value, count, fraction of the non-null values."""
    scratch = Scratch(docs.sparkSession, "categories")
    each = scratch.keep(docs.where(column.isNotNull()).groupBy(column.alias("value")).agg(F.count("*").alias("count")), "each")
    return each.withColumn("fraction", F.col("count") / F.lit(each.agg(F.sum("count")).first()[0]))


def histogram(docs: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """lower, upper, count of at most `buckets` disjoint inclusive ranges: exact values where they are few, else equal depth.

    Bounds are exact ranks of the values: a global order in sorted ranges, never one task.
    """
    scratch = Scratch(docs.sparkSession, "histogram")
    each = scratch.keep(docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "values")
    if each.limit(buckets + 1).count() <= buckets:
        return each.select(F.col("value").alias("lower"), F.col("value").alias("upper"), F.col("n").alias("count"))
    from millrace.model import running

    total = each.agg(F.sum("n")).first()[0]
    placed = running(each, [F.col("value")], "n", scratch)
    bucket = F.floor(F.col("before") * buckets / F.lit(total))
    return placed.groupBy(bucket.alias("bucket")).agg(F.min("value").alias("lower"), F.max("value").alias("upper"), F.sum("n").alias("count")).select("lower", "upper", "count")


def quantiles(docs: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """point, value by nearest rank, without interpolation; ranks come from sorted ranges of the distinct values, never from one task."""
    if dict(docs.dtypes)[column] in ("string", "boolean"):
        raise TypeError("quantiles are of numbers")
    from millrace.model import running

    scratch = Scratch(docs.sparkSession, "quantiles")
    each = scratch.keep(docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "values")
    total = each.agg(F.sum("n")).first()[0] or 0
    ranks = docs.sparkSession.createDataFrame([(k, float(p), max(1, math.ceil(p * total))) for k, p in enumerate(points)], "k int, point double, rank long")
    placed = running(each, [F.col("value")], "n", scratch)
    hit = placed.join(F.broadcast(ranks), (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))).select("k", F.col("value").cast("double").alias("value"))
    return F.broadcast(ranks).join(hit, "k", "left").select("point", "value")


def quantile_range(buckets: Sequence[tuple[float, float, int]], p: float) -> tuple[float, float]:
    """Bounds of the nearest-rank quantile from a histogram."""
    rank, seen = max(1, math.ceil(p * sum(n for *_, n in buckets))), 0
    for lower, upper, n in sorted(buckets):
        seen += n
        if seen >= rank:
            return lower, upper
    raise ValueError("an empty histogram has no quantiles")


def classifier(docs: DataFrame, field: ClassField) -> DataFrame:
    """class, top (documents whose first greatest class it is; null for sigmoid), mean and greatest probability."""
    each = docs.where(field.column.isNotNull()).select(field.probabilities().alias("p"), (field.label.column if field.transform == "softmax" else F.lit(None).cast("string")).alias("label"))
    each = each.select("label", F.posexplode("p").alias("k", "p")).groupBy("k").agg(
        F.avg("p").alias("mean"), F.max("p").alias("max"), F.sum((F.col("label") == F.element_at(F.array(*map(F.lit, field.classes)), F.col("k") + 1)).cast("long")).alias("top")
    )
    return each.select(F.element_at(F.array(*map(F.lit, field.classes)), F.col("k") + 1).alias("class"), "top", "mean", "max")


def steps(decided: DataFrame, n: int) -> DataFrame:
    """step, before, after (documents) from the decision column, in one pass."""
    at = F.coalesce("decision.step", F.lit(n))
    one = decided.agg(*[F.sum((at >= k).cast("long")).alias(f"k{k}") for k in range(n + 1)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.coalesce(F.col(f"k{k}"), F.lit(0)).alias("before"), F.coalesce(F.col(f"k{k + 1}"), F.lit(0)).alias("after")) for k in range(n)])).alias("r")).select("r.*") if n else decided.sparkSession.createDataFrame([], "step int, before long, after long")


@dataclass(frozen=True)
class Estimate:
    lower: int
    upper: int

    @property
    def expected(self) -> float:
        return (self.lower + self.upper) / 2


def _holds(lower, upper, op: str, v) -> tuple[bool, bool]:
    """Whether all, and whether any, values of an inclusive range satisfy the comparison."""
    tests = {"=": (lower == upper == v, lower <= v <= upper), "!=": (v < lower or v > upper, not lower == upper == v), "<": (upper < v, lower < v), "<=": (upper <= v, lower <= v), ">": (lower > v, upper > v), ">=": (lower >= v, upper >= v)}
    return tests[op]


def estimate(total: int, histograms: dict[str, Sequence[tuple[float, float, int]]], predicates: Sequence[tuple[str, str, float]]) -> Estimate:
    """Bounds on the documents that satisfy all predicates, from histograms alone; data isn't read.

    Predicates on one field meet bucket by bucket; of several fields, the least of the upper bounds and Fréchet's lower bound.
    """
    by: dict[str, list] = {}
    for name, op, value in predicates:
        by.setdefault(name, []).append((op, value))
    lowers, uppers = [total], [total]
    for name, tests in by.items():
        low = high = 0
        for lower, upper, n in histograms[name]:
            found = [_holds(lower, upper, op, v) for op, v in tests]
            low += n * all(a for a, _ in found)
            high += n * all(b for _, b in found)
        lowers.append(low)
        uppers.append(high)
    return Estimate(max(0, sum(lowers[1:]) - (len(lowers) - 2) * total) if by else total, min(uppers))


def union_estimate(parts: Sequence[Estimate]) -> Estimate:
    """Snapshots may share documents."""
    return Estimate(max(p.lower for p in parts), sum(p.upper for p in parts))
