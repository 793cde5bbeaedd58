"""Stepwise migrations: ordered steps with preconditions, and reconciliation of counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """``change`` maps tables to changed tables; ``expects`` are row counts that must hold before."""

    name: str
    change: Callable[[Tables], Tables]
    expects: Mapping[str, int] = field(default_factory=dict)


def run(steps: list[Step], tables: Tables, first: str | None = None, last: str | None = None) -> tuple[Tables, list[str]]:
    """The tables after the steps from ``first`` to ``last``, and the names of those done; a failed precondition stops."""
    names = [s.name for s in steps]
    span = steps[names.index(first) if first else 0 : names.index(last) + 1 if last else None]
    done = []
    for step in span:
        for table, expected in step.expects.items():
            if (actual := tables[table].count()) != expected:
                raise AssertionError(f"{step.name}: {table} has {actual} rows, not {expected}")
        tables = {**tables, **step.change(tables)}
        done.append(step.name)
    return tables, done


def reconcile(actual: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """(table_name, expected, actual, ok) from (table_name, n); tables on one side only are not ok."""
    wanted = actual.sparkSession.range(1).select(F.explode(F.create_map(*[x for name, n in expected.items() for x in (F.lit(name), F.lit(int(n)).cast("long"))])).alias("table_name", "expected"))
    joined = wanted.join(actual.withColumnRenamed("n", "actual"), "table_name", "full")
    return joined.select("table_name", "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))
