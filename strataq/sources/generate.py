"""Synthetic inputs by modular arithmetic over a range: the same rows at any size and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def i() -> Column:
    return F.col("id")


def pick(*values: str, by: int = 1) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(i() / by) % len(values) + 1).cast("int"))


def padded(prefix: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(i().cast("string"), width, "0"))


def scrambled(low: int, high: int, step: int = 7919) -> Column:
    return low + i() * step % (high - low + 1)


def agent_logs(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select((1700000000 + i()).alias("ts"), F.when(i() % 100 == 0, "ERROR").otherwise("INFO").alias("level"), pick("auth", "api", "db").alias("service"), padded("trace-", 8).alias("trace_id"), F.concat(F.lit("step "), (i() % 50).cast("string"), F.lit(" finished")).alias("msg"), scrambled(1, 999).alias("user_id"), pick("eu", "us", by=10).alias("region"))


def payments(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(padded("tx-", 10).alias("tx_id"), (scrambled(100, 99999) / 100).alias("amount"), pick("USD", "EUR").alias("currency"), F.when(i() % 20 == 0, "FAILED").otherwise("OK").alias("status"), F.concat(F.lit("merchant-"), (i() % 40).cast("string")).alias("merchant"), (1700000000 + i() * 3).alias("ts"))


def containers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.date_format(F.timestamp_seconds(1700000000 + i()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), pick("stdout", "stderr").alias("stream"), padded("app-", 5).alias("pod"), F.lit("default").alias("namespace"), F.lit("main").alias("container"), F.concat(F.lit("handled request "), (i() % 500).cast("string")).alias("log"))


def access_log(spark: SparkSession, n: int) -> DataFrame:
    ip = F.concat(F.lit("10.0."), (F.floor(i() / 256) % 256).cast("string"), F.lit("."), (i() % 256).cast("string"))
    return spark.range(n).select(F.concat(ip, F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET /api/item/'), (i() % 100).cast("string"), F.lit(' HTTP/1.1" '), pick("200", "200", "304", "500").alias("s"), F.lit(" "), scrambled(100, 5000).cast("string"), F.lit(' "-" "agent"')).alias("line"))


def system_log(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("Jan  5 10:"), F.lpad((F.floor(i() / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((i() % 60).cast("string"), 2, "0"), F.lit(" host"), (i() % 4).cast("string"), F.lit(" daemon["), scrambled(1000, 9999).cast("string"), F.lit("]: connection closed retries="), (i() % 5).cast("string")).alias("line"))


def sql_log(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(scrambled(100, 999).alias("pid"), (scrambled(10, 9000) / 10).alias("duration_ms"), F.concat(F.lit("SELECT * FROM orders WHERE id = "), i().cast("string"), F.lit(" AND status = '"), pick("open", "done"), F.lit("'")).alias("query"), (i() % 200).alias("rows_returned"))


def flow_log(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.format_string("2 123456789 eni-%d 10.0.0.%d 10.0.1.%d %d 443 6 %d %d %d %d %s OK", i() % 8, i() % 250, i() * 3 % 250, scrambled(1024, 65535), i() % 100 + 1, scrambled(40, 90000), 1700000000 + i(), 1700000060 + i(), F.when(i() % 13 == 0, "REJECT").otherwise("ACCEPT")).alias("line"))


def token_rows(spark: SparkSession, n: int, width: int = 16, planted: int = 1234, place: int = 3, low: int = 100, high: int = 149) -> DataFrame:
    """row_id and t0 ... : pseudo-random ids with one planted in some rows."""
    token = lambda k: F.when(F.lit(k == place) & i().between(low, high), planted).otherwise(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(32000)).cast("int"))
    return spark.range(n).select(i().alias("row_id"), *(token(k).alias(f"t{k}") for k in range(width)))


def receipts(spark: SparkSession, n: int) -> DataFrame:
    digest = F.sha2(i().cast("string"), 256)
    return spark.range(n).select((scrambled(1, 100000) / 1000).alias("amount"), F.concat(F.lit("agent-"), (i() % 7).cast("string")).alias("sender"), F.concat(F.lit("agent-"), (i() * 3 % 7).cast("string")).alias("receiver"), (1700000000 + i()).alias("timestamp"), pick("small", "large").alias("model"), scrambled(10, 4000).alias("tokens_used"), digest.alias("signature"), F.sha2(digest, 256).alias("prompt_hash"))


GENERATORS = {f.__name__: f for f in (agent_logs, payments, containers, access_log, system_log, sql_log, flow_log, token_rows, receipts)}
