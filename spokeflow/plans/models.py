"""Models: named DataFrames that may refer to each other, materialized as their references allow and tested after the write."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.operators.quality import run_tests
from spokeflow.sinks.tables import create_view, replace_table

# Fixed value: how many models are built at the same time.
THREADS = 12
Ref = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Model:
    """``build(ref)`` returns the model's rows; ``ref(name)`` reads another model, wherever it stands among the models.

    A build that refers to a model which is not there yet ends at that reference and is called again later, so it should do
    nothing but read and describe its rows. ``ref.last()`` is the model's own table as it stands, None before there is one.

    The data tests of a ``guarded`` table run before the table is replaced; if one fails the old table stays, and ``TestsFailed``
    tells which.
    """

    name: str
    build: Callable[[Ref], DataFrame]
    materialized: str = "table"
    layer: str | None = None
    descriptions: dict[str, str] = field(default_factory=dict)
    tests: dict[str, Sequence[str]] = field(default_factory=dict)
    guarded: bool = False

    @property
    def full_name(self) -> str:
        return f"{self.layer}.{self.name}" if self.layer else self.name


def described(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """Column descriptions as column comments."""
    return df.select(
        *[F.col(c).alias(c, metadata={"comment": descriptions[c]}) if c in descriptions else F.col(c) for c in df.columns]
    )


class TestsFailed(ValueError):
    """Data tests of a guarded table failed before it was replaced."""

    __test__ = False


def _guard(model: Model) -> Callable[[DataFrame], None]:
    def check(rows: DataFrame) -> None:
        results = run_tests(rows.sparkSession, {model.name: rows}, {model.name: model.tests})
        failed = results.where("failing_rows > 0").collect()  # at most one row per test
        if failed:
            found = ", ".join(f"{r.column} {r.test}: {r.failing_rows}" for r in failed)
            raise TestsFailed(f"{model.full_name} is left as it was; failing rows: {found}")

    return check


class NotYet(Exception):
    """A model was referred to before it was there."""


@dataclass
class Built:
    """The table or view of each model, in the order in which they were finished, and the models each one referred to."""

    tables: dict[str, str] = field(default_factory=dict)
    references: dict[str, list[str]] = field(default_factory=dict)

    def order(self) -> list[str]:
        return list(self.tables)


def _cycle(waits_for: dict[str, str]) -> list[str]:
    """A chain of waiting models that comes back to its beginning."""
    chain = [next(iter(waits_for))]
    while waits_for[chain[-1]] not in chain:
        chain.append(waits_for[chain[-1]])
    return [*chain[chain.index(waits_for[chain[-1]]) :], waits_for[chain[-1]]]


def materialize(spark: SparkSession, models: Sequence[Model], threads: int = THREADS) -> Built:
    """Write all models, given in any order, each as soon as those it refers to are there, several at a time.

    The graph is what the builds refer to: nothing has to be declared. Every model runs in a scheduler pool of its own name,
    so that with ``spark.scheduler.mode=FAIR`` a large one does not hold up the others. A reference to an unknown model, and
    models that refer to each other in a circle, are errors that name them. When a model fails, those that run are waited
    for, no other is begun, and the error is raised; what is finished stays.
    """
    by_name = {m.name: m for m in models}
    if len(by_name) < len(models):
        raise ValueError("two models have one name")
    built = Built(references={name: [] for name in by_name})

    def attempt(model: Model) -> str:
        def ref(name: str) -> DataFrame:
            if name not in by_name:
                raise ValueError(f"{model.name} refers to {name}, which is no model")
            if name not in built.references[model.name]:
                built.references[model.name].append(name)
            if name not in built.tables:
                raise NotYet(name)
            return spark.table(built.tables[name])

        ref.last = lambda: spark.table(model.full_name) if spark.catalog.tableExists(model.full_name) else None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", model.name)
        try:
            rows = described(model.build(ref), model.descriptions)
            if model.materialized == "view":
                create_view(rows, model.name)
                return model.name
            replace_table(rows, model.full_name, _guard(model) if model.guarded else None)
            return model.full_name
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    waits_for: dict[str, str] = {}
    failure: BaseException | None = None
    with ThreadPoolExecutor(max(1, threads), "model") as pool:
        running: dict[Future, Model] = {pool.submit(attempt, m): m for m in models}
        while running:
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                model = running.pop(done)
                error = done.exception()
                if error is None:
                    built.tables[model.name] = done.result()
                elif isinstance(error, NotYet):
                    waits_for[model.name] = error.args[0]
                elif failure is None:
                    failure = error
                    failure.add_note(f"in the model {model.name}")
            # A reference may have been finished since it was asked for, so this looks at all that wait.
            for name in [n for n, other in waits_for.items() if other in built.tables]:
                del waits_for[name]
                if failure is None:
                    running[pool.submit(attempt, by_name[name])] = by_name[name]
    if failure is not None:
        raise failure
    if waits_for:
        raise ValueError(f"models refer to each other in a circle: {' -> '.join(_cycle(waits_for))}")
    return built


def run(spark: SparkSession, models: Sequence[Model], threads: int = THREADS) -> DataFrame:
    """Materialize the models, given in any order, then return the results of all their data tests."""
    return tested(spark, models, materialize(spark, models, threads))


def tested(spark: SparkSession, models: Sequence[Model], built: Built) -> DataFrame:
    """The results of all data tests of built models."""
    with_tests = [m for m in models if m.tests]
    tables = {m.name: spark.table(built.tables[m.name]) for m in with_tests}
    return run_tests(spark, tables, {m.name: m.tests for m in with_tests})


def union_all(*parts: DataFrame) -> DataFrame:
    """By position, duplicates kept."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


def without_null(rows: DataFrame, column: str) -> DataFrame:
    """The filter that would make the first starter model pass its test; not applied by default."""
    return rows.where(F.col(column).isNotNull())


def starter_models(spark: SparkSession) -> list[Model]:
    """The two starter models. The first holds a NULL id on purpose and so fails one of its tests."""
    description = {"id": "Identifies the row"}
    tests = {"id": ("unique", "not_null")}
    first = Model(
        "starter_first",
        lambda ref: union_all(spark.sql("select 1 as id"), spark.sql("select null as id")),
        descriptions=description,
        tests=tests,
    )
    second = Model(
        "starter_second",
        lambda ref: ref("starter_first").where("id = 1"),
        materialized="view",
        descriptions=description,
        tests=tests,
    )
    return [first, second]
