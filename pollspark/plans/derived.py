"""Derived tables that are built again only when what they are made from has changed.

A table's folder is named by a digest: the fingerprints of its source rows, the digests of the derived tables it reads,
and its recipe's version. A finished folder of that name is the table; anything else means it is stale. So a changed
source rebuilds exactly the tables downstream of it, a job that was lost leaves an unfinished folder that does not
count, and a change that is taken back finds the old table again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pollspark.functions.hashing import fingerprint


@dataclass(frozen=True)
class Recipe:
    """How a table is made: the names it reads, a function of their DataFrames, and a version to raise when it changes."""

    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: int = 1


def _finished(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def source_mark(source: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order; one row is gathered."""
    r = fingerprint(source).first()
    return hashlib.sha256(f"{source.schema.simpleString()}|{r.n_rows}|{r.hash_sum}".encode()).hexdigest()


def build(spark: SparkSession, root: str, sources: dict[str, DataFrame], recipes: dict[str, Recipe]) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """All derived tables by name, and for each whether it was built now.

    ``recipes`` stand in an order in which each reads only sources and tables before it.
    """
    marks = {name: source_mark(df) for name, df in sources.items()}
    tables, built = dict(sources), {}
    for name, recipe in recipes.items():
        text = "|".join([name, str(recipe.version), *[f"{r}={marks[r]}" for r in recipe.reads]])
        marks[name] = hashlib.sha256(text.encode()).hexdigest()
        folder = f"{root.rstrip('/')}/{name}/{marks[name]}"
        built[name] = not _finished(spark, folder)
        if built[name]:
            recipe.make(*[tables[r] for r in recipe.reads]).write.mode("overwrite").parquet(folder)
        tables[name] = spark.read.parquet(folder)
    return {n: tables[n] for n in recipes}, built
