"""Objects and references: duplicates, reachability, trees."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical(df: DataFrame, key: str, *content: Column) -> DataFrame:
    """(key, canonical): the least id of each content.

    A hash is grouped with a partial minimum; only contents that are repeated are joined back, and adaptive
    execution splits the rows of a frequent one.
    """
    identity = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in content]), 256)
    hashed = df.select(key, identity.alias("_h"))
    first = hashed.groupBy("_h").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return hashed.join(first, "_h", "left").select(key, F.coalesce("_first", F.col(key)).alias("canonical"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints; where none is set (tests), one of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def _written(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def link_duplicates(objects: DataFrame) -> DataFrame:
    """Objects (id, content, refs) whose references point at canonical objects, repeated until no two are equal.

    Each round ends in a checkpoint; a round leaves fewer objects, and there are as many rounds as levels of nesting.
    """
    while True:
        names = canonical(objects, "id", F.col("content"), F.col("refs"))
        again = _written(names.where("id <> canonical"))
        if again.isEmpty():
            return objects
        edges = objects.select("id", F.posexplode("refs").alias("i", "ref")).join(again.withColumnsRenamed({"id": "ref", "canonical": "new"}), "ref", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "ref").alias("r")))).alias("_r"))
        kept = objects.join(again.select("id"), "id", "left_anti").join(edges, "id", "left")
        objects = _written(kept.select("id", "content", F.coalesce(F.transform("_r", lambda x: x["r"]), "refs").alias("refs")))


def unreferenced(items: DataFrame, key: str, references: DataFrame, ref: str) -> DataFrame:
    """Items that nothing refers to."""
    return items.join(references.select(F.col(ref).alias(key)), key, "left_anti")


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, level) of nodes that steps (edges src, dst) lead to from the roots (id), at their least level; ``depth`` limits the steps where it is given.

    Each step joins the last one's new nodes only, and ends in a checkpoint.
    """
    seen = _written(roots.select("id").distinct().withColumn("level", F.lit(0)))
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        front = _written(front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = _written(seen.unionByName(front)) if level % 16 == 0 else seen.unionByName(front)
    return nodes.join(seen, "id")


def outline(spark, view: str) -> DataFrame:
    """(id, title, level, path) of a tree (id, parent_id, title) by a recursive query, parents before children."""
    return spark.sql(
        f"""WITH RECURSIVE t(id, title, level, path) AS (
          SELECT id, title, 0, cast(title AS string) FROM {view} WHERE parent_id IS NULL
          UNION ALL SELECT c.id, c.title, t.level + 1, concat(t.path, '/', c.title) FROM {view} c JOIN t ON c.parent_id = t.id)
        SELECT * FROM t"""
    )


def link_rows(rows: DataFrame, target: DataFrame, on: str, how: str = "left") -> DataFrame:
    """References resolved by key."""
    return rows.join(target, on, how)


def as_of(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """Rows with the last value that is not null at or before them, in the order of their keys' rows."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def banded(df: DataFrame, value: str, bands: list[tuple], into: str) -> DataFrame:
    """Rows whose value lies in a band (name, low, high), low inclusive and high exclusive: a lookup by range without a join, the first band that fits."""
    v = F.col(value)
    fits = F.coalesce(*[F.when((v >= lo) & (v < hi), F.lit(name)) for name, lo, hi in bands])
    return df.withColumn(into, fits).where(F.col(into).isNotNull())


def referenced(items: DataFrame, key: str, references: DataFrame, ref: str) -> DataFrame:
    """Items that something refers to."""
    return items.join(references.select(F.col(ref).alias(key)), key, "left_semi")


def islands(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows with ``cluster`` from 0: sorted values chain while the gap to the one before is at most the tolerance."""
    order = W.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(order)
    return df.withColumn("_new", F.when(gap > tolerance, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def cluster_means(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, cluster, position, members): each cluster's mean."""
    return islands(df, keys, value, tolerance).groupBy(*keys, "cluster").agg(F.avg(value).alias("position"), F.count("*").alias("members"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """(keys, start, end): intervals that overlap or stand within a gap are one."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")
