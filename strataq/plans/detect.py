"""Format detection and routing as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4096
OBJECT_LINE = r"^\s*[{]"
ADDRESS = r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3} "


def detect_compat(text: Column) -> Column:
    """The engine name by the reference rules, on the first 4 KiB; the first rule that holds decides."""
    s = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    has = lambda *words: sum((F.contains(s, F.lit(w)).cast("int") for w in words), F.lit(0))
    first = F.substring_index(F.ltrim(s), "\n", 1)
    return (
        F.when(F.length(s) == 0, "universal")
        .when((has('"Records"', '"eventVersion"') > 0) & (has('"eventSource"', '"userIdentity"') > 0), "cloudtrail")
        .when(has('"srcaddr"', '"dstaddr"') == 2, "vpcflow")
        .when((has('"namespace"', '"pod"') == 2) | (has('"log"', '"stream"') == 2), "k8s")
        .when((has('"query"') > 0) | (has("SELECT ", "INSERT INTO ", "UPDATE ") > 0), "sql")
        .when(first.rlike(OBJECT_LINE), "json_columnar")
        .when(first.rlike(ADDRESS) & (has("nginx") > 0), "nginx")
        .when(first.rlike(ADDRESS), "apache")
        .when(first.rlike("^[A-Z][a-z]{2} +[0-9]"), "syslog")
        .when(has('"repo"', '"actor"') == 2, "github")
        .otherwise("universal")
    )


def detect(text: Column) -> Column:
    """As above, and formats that those rules never reach: events with repo and actor, plain flow records, hypervisor lines."""
    s = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    first = F.substring_index(F.ltrim(s), "\n", 1)
    fields = F.size(F.split(F.btrim(first), " "))
    return (
        F.when(F.contains(s, F.lit('"repo"')) & F.contains(s, F.lit('"actor"')) & first.rlike(OBJECT_LINE), "github")
        .when((fields == 14) & first.rlike("^[0-9]+ [0-9]+ eni-"), "vpcflow")
        .when(first.rlike(r"^[0-9]{4}-[0-9-]+T[^ ]+ [^ ]+ [A-Za-z]+: "), "vmware")
        .otherwise(detect_compat(text))
    )


def route(lines: Column, unique_ratio: Column, bits_per_byte: Column, readable: Column) -> Column:
    """zstd for short, diverse, unreadable or dense input, else columnar."""
    return F.when(lines < 10, "zstd").when(unique_ratio > 0.8, "zstd").when(~readable, "zstd").when(bits_per_byte > 6.8, "zstd").otherwise("columnar")


def route_by_size(n_bytes: Column, head_bits: Column) -> Column:
    """zstd under 100 KiB or for a dense head, else an audition of the candidates."""
    return F.when(n_bytes < 100 * 1024, "zstd").when(head_bits > 7.5, "zstd").otherwise("audition")


def champion(results: DataFrame, group: str, name: str = "engine", ratio: str = "ratio") -> DataFrame:
    """The engine with the best ratio per group; ties go to the first name."""
    return results.groupBy(group).agg(F.min_by(name, F.struct(-F.col(ratio), F.col(name))).alias("winner"), F.max(ratio).alias("best_ratio"))


def audition(sample: bytes, levels: tuple[int, ...] = (3, 19)) -> list[tuple[str, float]]:
    """Ratio of each zstd level on a sample, best first."""
    import zstandard

    found = [(f"zstd-{n}", len(sample) / max(1, len(zstandard.ZstdCompressor(level=n).compress(sample)))) for n in levels]
    return sorted(found, key=lambda x: (-x[1], x[0]))
