"""Session helpers: where lineage is cut, and how large a side may be broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Most rows of a counted side that is broadcast.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only a session on one machine may be without one
    and gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="siteloom-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, materialised in the shared checkpoint folder, with its lineage cut. Lost executors lose nothing: the files are shared."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark removes the shuffle files and checkpoints of tables that nothing
    refers to any more. Else those of a long chain of checkpoints lie on disk until the driver happens to collect."""
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, materialised and counted: marked for a broadcast up to BROADCAST_ROWS rows, of a few numbers each; beyond, a shuffle joins it."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, order: str | Column | list, name: str) -> DataFrame:
    """df with `name`, the place of each row in the order, from 0. Rows are sorted in ranges; only the sizes of partitions are collected."""
    at = checkpointed(df.orderBy(*(order if isinstance(order, list) else [order])).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    up, first = 0, []
    for r in sorted(at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        first.append((r.part, up))
        up += r.n
    if not first:
        return at
    starts = df.sparkSession.createDataFrame(first, "part long, first long")
    return at.withColumn("__part", part).join(F.broadcast(starts.withColumnRenamed("part", "__part")), "__part").withColumn(name, F.col("first") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "first")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once for each application (Spark serves the archive to all executors)."""
    import os
    import zipfile

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="siteloom-"), "siteloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.join("siteloom", os.path.relpath(file, top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
