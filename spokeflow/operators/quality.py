"""Data tests on columns: each counts its failing rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "model string, column string, test string, failing_rows bigint"


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; NULLs do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.where("n > 1")


def _row(model: str, column: str, test: str, failing) -> list:
    return [F.lit(model).alias("model"), F.lit(column).alias("column"), F.lit(test).alias("test"), failing]


def unique(df: DataFrame, model: str, column: str) -> DataFrame:
    failing = F.count("*").alias("failing_rows")
    return duplicate_keys(df, column).agg(failing).select(*_row(model, column, "unique", F.col("failing_rows")))


def not_null(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """All the columns of one model in a single scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    results = F.array(*[F.struct(*_row(model, c, "not_null", F.col(c).alias("failing_rows"))) for c in columns])
    return counts.select(F.inline(results))


def primary_key(df: DataFrame, model: str, column: str) -> DataFrame:
    """Stands for a declared key that no store enforces."""
    return unique(df, model, column).unionByName(not_null(df, model, [column]))


TESTS = ("unique", "not_null")


def _model_tests(df: DataFrame, model: str, columns: dict[str, Sequence[str]]) -> list[DataFrame]:
    """A model's tests in one scan and one aggregation: every unique column is a grouping set of its own, so equal values are
    counted before the shuffle and a hot one sends one row per task. The first set also counts the NULLs of all columns."""
    keys = [c for c, names in columns.items() if "unique" in names]
    filled = [c for c, names in columns.items() if "not_null" in names]
    if not keys:
        return [not_null(df, model, filled)] if filled else []
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(filled)]
    counts = df.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("_n"), *nulls
    )
    # A grouping id has a bit for each column that is not in the set, the first column's highest.
    of = lambda i: F.col("_set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
    totals = counts.agg(
        *[F.count_if(of(i) & (F.col("_n") > 1) & F.col(k).isNotNull()).alias(f"_twice_{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(F.when(of(0), F.col(f"_null_{i}"))), F.lit(0)).alias(f"_null_{i}") for i in range(len(filled))],
    )
    rows = [F.struct(*_row(model, k, "unique", F.col(f"_twice_{i}").alias("failing_rows"))) for i, k in enumerate(keys)]
    rows += [F.struct(*_row(model, c, "not_null", F.col(f"_null_{i}").alias("failing_rows"))) for i, c in enumerate(filled)]
    return [totals.select(F.inline(F.array(*rows)))]


def run_tests(spark: SparkSession, models: dict[str, DataFrame], tests: dict[str, dict[str, Sequence[str]]]) -> DataFrame:
    """``tests``: model → column → test names. One row per test, none without tests; an unknown name is an error."""
    unknown = {name for columns in tests.values() for names in columns.values() for name in names} - set(TESTS)
    if unknown:
        raise ValueError(f"no such data tests: {', '.join(sorted(unknown))}")
    results = [r for model, columns in tests.items() for r in _model_tests(models[model], model, columns)]
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], RESULT)
