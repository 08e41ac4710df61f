"""What the operators share: tables, scratch tables on the cluster's shared folder, ranks and components.

Scratch tables are Parquet files below ``spark.checkpoint.dir``. They stand in for cached data, so a lost
executor costs no lineage, and they may be deleted once the job's result is written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.sources import shipping

#: Rows of a table in one Arrow batch. Documents may be a megabyte each, so batches are kept short.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches of this session short, unless their size was set."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shipping.ship(spark)


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset in local mode (tests), below a temporary folder. On a cluster, whose
    executors share no such folder, the setting must be there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leafmill-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder, or a path below it from ``scratch``, and read it again, which cuts its lineage."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a table that was staged at a path, when nothing will read it again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1 and so on, so that none clashes with an operator's own, and the new name of each."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


#: Rows of a rank's bucket, about.
RANK_ROWS = 1 << 20


def salted(df: DataFrame) -> DataFrame:
    """df with a number of its own for each row, ``_salt``, written with it: rows that are alike get apart, and a second read finds the same."""
    return stage(df.withColumn("_salt", F.monotonically_increasing_id()))


def ranked(df: DataFrame, group: list[str], out: str, buckets: int | Column, small: bool) -> DataFrame:
    """df without ``_salt`` and with ``out``, a gapless rank from 0 within each group.

    A group is dealt to ``buckets`` tasks by the rows' ``_salt``; ranks within a bucket are shifted by
    the rows of the buckets before it, so no group has to fit in one task, nor many rows that are alike. small: the buckets of all
    groups are few by construction, so the shifts may be broadcast. df is read twice; pass one that is ``salted``.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64("_salt"), buckets if isinstance(buckets, Column) else F.lit(buckets)))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_bucket").orderBy("_salt")
    rows = dealt.withColumn("_rank", F.row_number().over(within) - F.lit(1))
    joined = rows.join(F.broadcast(shifts) if small else shifts, [*group, "_bucket"])
    return joined.withColumn(out, (F.col("_rank") + F.col("_shift")).cast("long")).drop("_bucket", "_rank", "_shift", "_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component: the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes, each written to the shared folder.
    Rows that an executor holds are its share of the edges only; no node, link or component goes to the driver
    but two numbers a round. Loops and repeated edges are ignored; no edges give no rows.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # Large star: what is above a node hangs on the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: what is below a node, and the node, hang on its least neighbour below.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small)
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
