"""Jobs: a source, an aggregate, optional queries to cross with and a number of rounds, as one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from foldmill.operators import apps  # noqa: F401  names the shipped aggregates
from foldmill.operators.crossing import cross_queries
from foldmill.operators.sinks import write_result
from foldmill.plans.spec import AggSpec, PythonAgg, lookup
from foldmill.sources import readers


@dataclass
class Job:
    """``source`` is a DataFrame of records, or None to read ``path`` in ``mode``.

    ``strategy`` is kept for configurations and changes nothing in the result; neither do
    ``combine`` (before the shuffle or not) and the numbers of partitions before and behind
    the shuffle, ``mappers`` and ``reducers`` (0: Spark's own).
    """

    aggregate: str | AggSpec | PythonAgg
    source: DataFrame | None = None
    mode: str = "chunk"
    path: str | list[str] | None = None
    options: dict = field(default_factory=dict)
    queries: DataFrame | None = None
    rounds: int = 0
    strategy: str = "bucket"
    combine: bool = True
    mappers: int = 0
    reducers: int = 0
    STRATEGIES = ("bucket", "hashsort", "exthash", "iterative")

    def run(self, spark: SparkSession) -> DataFrame:
        if self.strategy not in self.STRATEGIES:
            raise ValueError(f"no strategy {self.strategy!r}; there are {', '.join(self.STRATEGIES)}")
        if self.source is None and self.path is None:
            raise ValueError("a job needs a source or a path")
        rows = self.source if self.source is not None else readers.read(spark, self.mode, self.path, **self.options)
        if self.mappers:
            rows = rows.repartition(self.mappers)
        if self.queries is not None:
            rows = cross_queries(rows, self.queries)
        spec = lookup(self.aggregate) if isinstance(self.aggregate, str) else self.aggregate
        if isinstance(spec, PythonAgg):
            return spec.run(rows)
        rounds = self.rounds or (1 if self.strategy == "iterative" else 0)
        if rounds and spec.create is None:
            partials = rows
        else:
            partials = spec.merged(spec.created(rows), self.combine, self.reducers)
        for _ in range(rounds):
            partials = spec.merged(spec.divided(partials), self.combine, self.reducers)
        return spec.finished(partials)

    def save(self, spark: SparkSession, path: str, kind: str = "parquet") -> dict[str, int]:
        """Write the result; the counters of what was written."""
        result = self.run(spark)
        write_result(result, path, kind)
        return {"rows": spark.read.parquet(path).count() if kind == "parquet" else spark.read.text(path).count(), "partitions": result.rdd.getNumPartitions()}
