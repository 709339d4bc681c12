"""Extension points — chain operators as DataFrame transforms and expose
tables to SQL.

The reference's analyzer/sink/filter traits map to plain Spark idioms: an
analyzer is a ``DataFrame -> DataFrame`` function applied with
``DataFrame.transform``; a sink is ``foreachBatch`` (see streaming.stream);
a filter is a Column predicate (functions.filters). SQL users get the derived
tables as temporary views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Pipeline:
    """An ordered list of DataFrame → DataFrame steps, applied with
    ``DataFrame.transform`` (the plan stays one lazy Catalyst plan)."""

    def __init__(self, *steps: Callable[[DataFrame], DataFrame]):
        self.steps = list(steps)

    def then(self, step: Callable[[DataFrame], DataFrame]) -> "Pipeline":
        return Pipeline(*self.steps, step)

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Expose DataFrames (e.g. the derived trace tables) as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)
