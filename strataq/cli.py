"""Command line: compress, decompress, search, verify, benchmark over archives of JSON or text lines.

Exit codes: 0 done, 10 corrupt archive, 12 unsupported input, 13 anything else.
"""

from __future__ import annotations

import argparse
import sys

from .plans import archive

OK, CORRUPT, UNSUPPORTED, INTERNAL = 0, 10, 12, 13


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strataq").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataq")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("input")
    c.add_argument("archive")
    c.add_argument("--max", action="store_true")
    d = sub.add_parser("decompress")
    d.add_argument("archive")
    d.add_argument("output")
    s = sub.add_parser("search")
    s.add_argument("archive")
    s.add_argument("query")
    s.add_argument("--limit", type=int)
    s.add_argument("--context", type=int, default=0)
    s.add_argument("--json", action="store_true")
    sub.add_parser("verify").add_argument("archive")
    sub.add_parser("benchmark").add_argument("archive")
    return p


def hits(spark, path: str, query: str, context: int, limit: int | None):
    """Rows that match, in the order of the archive's rows, with ``context`` rows on each side; the first ``limit`` of them."""
    from pyspark.sql import functions as F

    from .operators.ordered import with_running_sum
    from .operators.search import where

    df = archive.read(spark, path)
    order = "row_id" if "row_id" in df.columns else None
    if context and not order:
        raise ValueError("--context needs an archive with a row_id")
    found = where(df, query)
    if context:
        ranked = with_running_sum(df, order, F.lit(1).cast("long"), "__rank")
        near = where(ranked, query).select(F.explode(F.sequence(F.col("__rank") - context, F.col("__rank") + context)).alias("__near")).distinct()
        found = ranked.join(near, F.col("__rank") == F.col("__near"), "left_semi").select(*df.columns)
    if limit:
        # Without a row number, the order of all columns that have one; the same rows in each run.
        by = [order] if order else [f"`{c}`" for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
        return found.orderBy(*by).limit(limit)
    return found.orderBy(order) if order else found


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    spark = spark or session()
    try:
        if a.command == "compress":
            df = spark.read.json(a.input, mode="PERMISSIVE")
            if not df.columns:
                print("no records in the input", file=sys.stderr)
                return UNSUPPORTED
            print(archive.write(df, a.archive, "max" if a.max else "fast")["rows"], "rows")
        elif a.command == "decompress":
            archive.restore(spark, a.archive, a.output)
        elif a.command == "search":
            found = archive.restore_jsonl(hits(spark, a.archive, a.query, a.context, a.limit))
            lines = (r[0] for r in found.toLocalIterator())
            if a.json:
                print("[" + ",\n".join(lines) + "]")
            else:
                for line in lines:
                    print(line)
        elif a.command == "verify":
            archive.read(spark, a.archive, verify=True)
            print("PASS")
        else:
            import time

            began = time.time()
            n = archive.read(spark, a.archive).count()
            print(f"{n} rows in {time.time() - began:.3f} s")
    except archive.CorruptArchive as e:
        print(e, file=sys.stderr)
        return CORRUPT
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return UNSUPPORTED
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return INTERNAL
    return OK


if __name__ == "__main__":
    sys.exit(main())
