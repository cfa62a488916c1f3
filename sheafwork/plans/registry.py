"""Registry of queries and shared input statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


class Tables:
    """The given tables and the inputs derived from them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            # a table of one small file is one scan task: the queries deal it out, the operators never do
            return df.repartition(self.spark.sparkContext.defaultParallelism) if name == "documents" and df.rdd.getNumPartitions() == 1 else df
        raise AttributeError(name)

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Run a statement whose {table} names are given tables or passed DataFrames."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used, **more)


def duck(text: str) -> str:
    """The same statement for DuckDB, where the tables are views of that name."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.replace("{{", "{").replace("}}", "}")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(covers: str, oracle: str | None = None) -> Callable:
    """Register a function of Tables under its own name; ``covers`` lists operator ids."""
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if fn.__name__ in QUERIES:
            raise ValueError(fn.__name__)
        QUERIES[fn.__name__] = Query(fn.__name__, fn, duck(oracle) if oracle else None, covers)
        return fn

    return add
