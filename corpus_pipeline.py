"""A training-data pipeline over ``documents``: each stage is one operator, written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). run()
applies them in order. All stages but the last return the columns of documents.
Files are read again in any order, so the last stage takes the order of the mix
from the names and row numbers of the files it reads and hands it on as
``position``. Nulls, empty and repeated rows are treated as each operator says;
an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.llm._batches import packed, quoted
from strataq.llm.bpe import encode_decode
from strataq.llm.components import shared_folder
from strataq.llm.line_templates import drop_recurring_lines
from strataq.llm.pfair import in_mix_order
from strataq.llm.probminhash import keep_one
from strataq.llm.zstd_quality import keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has them."""
    return drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that holds the target weights of the sources."""
    return in_mix_order(docs)


def positioned(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``, read from Parquet files) and ``position``, the place of the row in the order in which the files were written."""
    meta = docs.metadataColumn("_metadata")
    named = packed(docs, file=meta["file_name"], at=meta["row_index"])
    sizes = named.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row per file
    return named.join(F.broadcast(offsets), "file").select("row", (F.col("before") + F.col("at")).alias("position"))


#: What the last stage adds; input columns of these names are replaced.
ADDED = ("position", "ids", "n_tokens", "decoded_sha256")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ADDED: the position in the mix, the token ids (little-endian unsigned 32-bit integers), their number and the digest of the decoded text; in the order of the mix."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = positioned(docs).repartitionByRange(parts, "position").sortWithinPartitions("position")
    told = encode_decode(placed.select(F.struct("row", "position").alias("key"), F.col("row.text").alias("text")), public_tokenizers.path("byte_bpe_50k.json"), "key")
    kept = [F.col(f"key.row.{quoted(c)}") for c in docs.columns if c not in ADDED]
    return told.select(*kept, "key.position", "ids", "n_tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", encoding)]

#: The classifier, ProbMinHash and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"  # goes with the application
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the next stage has read and written anew
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
