"""Tables written in between, and connected components of an edge table by alternating star contraction, in DataFrames.

Each round links every node to the smallest node of its neighbourhood (large
star), then every node to the smallest of its smaller neighbours (small star);
a logarithmic number of rounds suffices. The lineage is cut each round by a
table written in the shared folder the session names: lost executors cost no
more than what they were at, and later joins are planned from true sizes (what
checkpoint() hands on keeps estimates, whose products grow without bound over
rounds of joins). Only a count and a sum come to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, removed when the application ends; where neither that nor a checkpoint folder is set, one of this machine, in local mode only."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        base = context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/tables-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written now."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has an edge to another node; raises if that takes more than ``most_rounds``."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs = cut(pairs)
    before = None
    for _ in range(most_rounds):
        # Large star: neighbours larger than u go to the smallest of u and its neighbours.
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Cut, so that the join below can be split at a node with very many neighbours.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        pairs = cut(small)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise ArithmeticError(f"No components after {most_rounds} rounds")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))
    return pairs.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min("root").alias("root"))
