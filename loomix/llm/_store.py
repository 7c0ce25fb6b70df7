"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..paths import new_path


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes the rows to the shared folder and reads them again: lineage ends, and any executor may be lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    size, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(size, "1000")  # whole texts and sets make wide rows
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(size, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomix_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing needs any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._loomix_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links (a, b) of a task by (node, smallest node linked with it), as bounded batches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def out() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if root(x) != x]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield from out()
            parent.clear()
    yield from out()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of links (a, b): the smallest node it can reach.

    Alternates large-star and small-star steps, each one min per node and one join
    whose both sides are plain tables, so a node with very many links is split.
    """
    edges = save(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(forest, "a long, b long"), "edges")
    for _ in range(rounds):
        # Settled when no target has a target of its own and no node has two.
        targets = edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x"))
        if edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and targets.where("m <> x").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        one = save(large.where("a <> b").distinct(), "large")
        down = one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = save(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        new = save(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        drop(edges, least, one, lowest)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).distinct().unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def apart(keep: list[str], *names: str) -> list[str]:
    """Names of result columns; one that a kept column has already gets kept_ before it."""
    return [f"kept_{n}" if n in keep else n for n in names]
