"""Command line: check, stats, dump, get and merge tables. ``python -m lamella.cli help``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamella.sources.table import Corrupt, Table, merge_tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamella", description="Inspect layered key-value tables.")
    sub = p.add_subparsers(dest="command")
    sub.add_parser("help", help="show this text")
    for name, text in (("check", "read everything and hold it against checksums, order and counts"), ("stats", "show entries, files and compression")):
        sub.add_parser(name, help=text).add_argument("table")
    d = sub.add_parser("dump", help="print entries in key order")
    d.add_argument("table")
    d.add_argument("--prefix", help="only keys that begin so; goes before --start")
    d.add_argument("--start", help="from this key on")
    d.add_argument("--limit", type=int, default=100)
    d.add_argument("--keys-only", action="store_true")
    g = sub.add_parser("get", help="print the value of a key")
    g.add_argument("table")
    g.add_argument("key")
    m = sub.add_parser("merge", help="merge tables; the last one wins")
    m.add_argument("out")
    m.add_argument("inputs", nargs="+")
    m.add_argument("--compress", action="store_true")
    return p


def shown(raw: bytes | None) -> str:
    if raw is None:
        return "<tombstone>"
    text = bytes(raw).decode("utf-8", "replace")
    return text if len(text.encode()) <= 200 else f"<{len(raw)} bytes>"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.command in (None, "help"):
        print(parser().format_help(), file=out)
        return 0
    spark = spark or SparkSession.builder.appName("lamella").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.command == "merge":
            n = merge_tables(spark, a.inputs, a.out, "zstd" if a.compress else "uncompressed")
            print(f"{len(a.inputs)} tables, {n} entries", file=out)
            return 0
        table = Table(spark, a.table)
        if a.command == "check":
            print(f"ok: {table.check()} entries", file=out)
        elif a.command == "stats":
            for k, v in table.stats().items():
                print(f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}", file=out)
        elif a.command == "dump":
            found = table.scan(prefix=a.prefix, ordered=False) if a.prefix is not None else table.scan(a.start, ordered=False)
            value = F.lit(None).cast("binary") if a.keys_only else F.col("value")
            rows = found.select("key", value.alias("value")).orderBy("key").limit(a.limit).collect()
            for r in rows:
                print(shown(r["key"]) if a.keys_only else f"{shown(r['key'])}\t{shown(r['value'])}", file=out)
            rest = found.count() - len(rows)
            if rest > 0:
                print(f"{rest} more", file=err)
        elif a.command == "get":
            there, value = table.get_entry(a.key)
            if value is None:
                print("the key is deleted" if there else "no such key", file=err)
                return 1
            if hasattr(out, "buffer"):
                out.flush()
                out.buffer.write(value)
                out.buffer.flush()
            else:
                out.write(value.decode("utf-8", "replace"))
    except (Corrupt, ValueError, FileExistsError, OSError) as e:
        print(f"error: {e}", file=err)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
