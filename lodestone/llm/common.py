"""Shared plumbing: the folder all executors see, written tables, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import new_path, shared_dir, written

__all__ = ["bounded_batches", "components", "extended", "extended_components", "freed", "new_path", "shared_dir", "table", "written"]

#: Vectors of a batch double as they grow, in the JVM and in each worker, outside the heap.
BATCH_BYTES = "4m"
SPLIT_EDGES = 5_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session to hand Arrow batches of at most ``BATCH_BYTES``, or one row, to Python workers.

    Queries and stages call it at their entry; operators leave the caller's session as it is and work with any bound.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def freed(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage between the many small queries of a long operator.

    A collection gives heap back that the queries' plans took, and lets Spark delete the shuffle files and broadcasts of those that are over.
    """
    spark.sparkContext._jvm.System.gc()


def stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (a, b) with a < b, and whether every component is a star: no b has a second a or is an a itself."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    count, other = ends.agg(F.sum("up"), F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()
    return count or 0, not other


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each connected component, for every node of an edge; a written table.

    Alternates large-star and small-star steps, each a grouped minimum whose partial aggregation absorbs hubs, until all
    components are stars. The edges of a hub meet its minimum in a join; where there are more than ``SPLIT_EDGES`` edges,
    minima are written first, as a join of two plain exchanges is what adaptive execution splits at hot keys. Every step
    is a written table, as plans of several steps take the driver's memory. Self-edges and null ends are dropped.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    count, done = stars(e)
    while not done:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        apart = written if count > SPLIT_EDGES else lambda df, name: df
        low = apart(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # Small star: every node points at its smallest smaller neighbour, and so do its other smaller neighbours.
        large = written(large, "large")
        least = apart(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        small = (
            large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
            .union(least.select("x", F.col("m").alias("y"))).distinct()
        )
        e = written(small.select(F.col("y").alias("a"), F.col("x").alias("b")), "edges")
        count, done = stars(e)
    return written(e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a"), F.col("a")).distinct()), "nodes")


def extended_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (node, component) after the edges (a, b) of ``more`` are added: the components of its components."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    top = components(ends)
    moved = found.join(top.select(F.col("node").alias("component"), F.col("component").alias("low")), "component", "left")
    return written(moved.select("node", F.coalesce("low", "component").alias("component")).union(top.join(found, "node", "left_anti").select("node", "component")), "nodes")


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` and then the fields of ``ddl``."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
