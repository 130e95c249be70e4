"""Token index per block and pruning by it. Pruned and full search find the same rows.

A block passes the gate only for queries that are whole tokens; any other query
scans all blocks. Tokens are kept in lower case, so the gate fits a search
without regard to case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import occurrences

WORD = "[0-9A-Za-z_]{4,}"


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})")))


#: Which parts of a parsed line are indexed, per format.
TOKEN_RULES = {
    "nginx": lambda: F.array("ip", "request", "referer", "agent"),
    "apache": lambda: F.array("ip", "request", "referer", "agent"),
    "syslog": lambda: F.filter(F.transform("variables", lambda v: F.translate(v, '"[]', "")), lambda v: F.length(v) < 64),
    "sql": lambda: F.filter("variables", lambda v: v.rlike("^['\"]")),
    "vpcflow": lambda: F.filter("fields", lambda v: v.contains(".") | v.startswith("eni-")),
    "cloudtrail": lambda: F.array("eventName", "eventSource", "sourceIPAddress", "awsRegion", "userName"),
    "github": lambda: F.array("actor", "repo"),
    "vmware": lambda: F.array("host"),
    "k8s": lambda: tokens(F.col("log")),
    "universal": lambda: tokens(F.col("line")),
}


def token_index(df: DataFrame, key: str, text: str, block_size: int) -> DataFrame:
    """(block_id, token), distinct; a block is ``block_size`` neighbouring keys."""
    return df.select(F.floor(F.col(key) / block_size).cast("long").alias("block_id"), F.explode(tokens(F.col(text))).alias("token")).distinct()


def token_sets(df: DataFrame, key: str, text: str, block_size: int) -> DataFrame:
    """block_id and tokens, the distinct ones of a block as an array. The tokens of a text move once, to its block."""
    own = df.select(F.floor(F.col(key) / block_size).cast("long").alias("block_id"), tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    return own.repartition("block_id").groupBy("block_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def gate_applies(query: str, pattern: str = WORD) -> bool:
    return re.fullmatch(pattern, query) is not None


def pruned(df: DataFrame, index: DataFrame, key: str, query: str, block_size: int) -> DataFrame:
    """Rows of the blocks that may hold the query.

    The text test that follows accepts parts of words, so a block passes if any of its tokens contains the query.
    """
    if not gate_applies(query):
        return df
    blocks = index.where(F.col("token").contains(query.lower())).select("block_id").distinct()
    return df.withColumn("block_id", F.floor(F.col(key) / block_size).cast("long")).join(blocks, "block_id", "left_semi").select(*df.columns)


def block_report(df: DataFrame, key: str, text: str, query: str, block_size: int) -> DataFrame:
    """total, candidate and skipped blocks and the hits in the candidates."""
    index = token_index(df, key, text, block_size)
    total = df.select(F.countDistinct(F.floor(F.col(key) / block_size)).alias("total_blocks"))
    found = pruned(df, index, key, query, block_size)
    hits = found.select(F.countDistinct(F.floor(F.col(key) / block_size)).alias("candidate_blocks"), F.coalesce(F.sum(occurrences(F.lower(text), query.lower())), F.lit(0)).alias("hits"))
    return total.join(hits).withColumn("skipped_blocks", F.col("total_blocks") - F.col("candidate_blocks")).select("total_blocks", "candidate_blocks", "skipped_blocks", "hits")


def bloom_size(n: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and probes of a Bloom filter for n items, with the customary lower bounds."""
    bits = max(64, math.ceil(-max(n, 10) * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, int(bits / max(n, 10) * math.log(2)))


def rule_tokens(parsed: DataFrame, form: str) -> Column:
    """array<string>: what the rules of a format index of a parsed line, in lower case, without nulls and blanks."""
    return F.array_distinct(F.filter(F.transform(TOKEN_RULES[form](), F.lower), lambda t: t.isNotNull() & (t != "")))


def rule_index(parsed: DataFrame, form: str, key: str, block_size: int) -> DataFrame:
    """(block_id, token) of the parts of parsed lines that a format indexes; whole parts, not words."""
    return parsed.select(F.floor(F.col(key) / block_size).cast("long").alias("block_id"), F.explode(rule_tokens(parsed, form)).alias("token")).distinct()


def blooms_of(tokens: DataFrame, rate: float = 0.01, fixed: tuple[int, int] | None = None) -> DataFrame:
    """Bloom filters, as ``blooms_of_sets``, of the tokens (block_id, token) of each block."""
    return blooms_of_sets(tokens.repartition("block_id").groupBy("block_id").agg(F.collect_list("token").alias("tokens")), rate, fixed)


def blooms_of_sets(sets: DataFrame, rate: float = 0.01, fixed: tuple[int, int] | None = None) -> DataFrame:
    """block_id, m, k and bits (sorted places of the set ones): a Bloom filter of the tokens (block_id, tokens) of each block.

    Sizes follow from the number of tokens of each block and ``rate``; ``fixed``
    gives all filters the same (bits, probes). A block is one row all the way:
    its places are made inside the row.
    """

    def m_of(tokens: Column) -> Column:
        n = F.greatest(F.size(tokens).cast("long"), F.lit(10))
        return F.lit(fixed[0]).cast("long") if fixed else F.greatest(F.lit(64), F.ceil(n * (-math.log(rate) / math.log(2) ** 2))).cast("long")

    def k_of(tokens: Column, m: Column) -> Column:
        n = F.greatest(F.size(tokens).cast("long"), F.lit(10))
        return F.lit(fixed[1]) if fixed else F.greatest(F.lit(1), F.floor(m / n * math.log(2)).cast("int"))

    def filter_of(tokens: Column, m: Column, k: Column) -> Column:
        probes = F.sequence(F.lit(0), k - 1)
        seeds = F.transform(tokens, lambda t: F.struct(*(s.alias(f"s{i}") for i, s in enumerate(seeds_of(t, m)))))
        bits = F.flatten(F.transform(seeds, lambda s: F.transform(probes, lambda j: place_of(s["s0"], s["s1"], j, m))))
        return F.struct(m.alias("m"), k.alias("k"), F.array_sort(F.array_distinct(bits)).alias("bits"))

    made = bound(F.col("tokens"), lambda t: bound(m_of(t), lambda m: bound(k_of(t, m), lambda k: filter_of(t, m, k))))
    return sets.select("block_id", F.inline(F.array(made)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: the optimizer writes the expression of a plain column into inner lambdas, which compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seeds_of(token: Column, m: Column) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(token), m), F.pmod(F.xxhash64(F.lit("second"), token), m)


def place_of(first: Column, second: Column, k: Column, m: Column) -> Column:
    return F.pmod(first + k * second, m)


def place(token: Column, k: Column, m: Column) -> Column:
    """Place of probe ``k`` among ``m`` bits, by double hashing."""
    return place_of(*seeds_of(token, m), k, m)


def bloom_index(df: DataFrame, key: str, text: str, block_size: int, rate: float = 0.01, fixed: tuple[int, int] | None = None) -> DataFrame:
    """Bloom filters of the words of each block, sized by their number or ``fixed``."""
    return blooms_of_sets(token_sets(df, key, text, block_size), rate, fixed)


#: The fixed form: 4096 bytes and two probes.
FIXED_BLOOM = (4096 * 8, 2)


def bloom_candidates(blooms: DataFrame, token: str) -> DataFrame:
    """block_id of the blocks that may hold the whole token; never misses one that does."""
    t = F.lit(token.lower())
    return blooms.where(F.forall(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.array_contains(F.col("bits"), place(t, j, F.col("m"))))).select("block_id")
