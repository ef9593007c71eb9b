"""Command line over a store: ``python -m tidemark.cli COMMAND ...``.

Exit status: 0 fine, 1 wrong usage, 2 store error or failed check; of ``ship``: 3 up to date, 4 a base copy is needed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.errors import StoreError
from tidemark.functions.text import human_bytes, is_printable, show
from tidemark.plans import inspect, replicate
from tidemark.plans.store import Store

FINE, USAGE, FAILED, UP_TO_DATE, NEED_BASE = range(5)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="inspect and ship stores")
    sub = p.add_subparsers(dest="command", required=True)
    one = lambda name, text: sub.add_parser(name, help=text)
    for name, text in (("stats", "sizes, and entries of each tree"), ("check", "walk everything"), ("list", "names of the sub-databases"), ("checkpoint", "the version that a replica must match")):
        c = one(name, text)
        c.add_argument("store")
        if name == "stats":
            c.add_argument("-d", dest="db")
    c = one("dump", "print entries")
    c.add_argument("store")
    c.add_argument("-d", dest="db", help="sub-database; the main tree if none")
    c.add_argument("-p", dest="prefix", help="only keys with this prefix (in reversed order: suffix)")
    c.add_argument("-n", dest="limit", type=int, default=0, help="stop after so many")
    c.add_argument("-k", dest="keys_only", action="store_true")
    mode = c.add_mutually_exclusive_group()
    mode.add_argument("--hex", action="store_const", const="hex", dest="mode", default="auto")
    mode.add_argument("--text", action="store_const", const="text", dest="mode")
    for name, args in (("compact", ("src", "dst")), ("ship", ("store", "replica", "bundle")), ("apply", ("replica", "bundle"))):
        c = one(name, "")
        for a in args:
            c.add_argument(a)
    return p


def _open(spark: SparkSession, path: str) -> Store:
    return Store.open(spark, path, read_only=True, create_if_missing=False)


def _dump(spark: SparkSession, a) -> int:
    with _open(spark, a.store) as s, s.read() as t:
        df = t.all(a.db) if a.prefix is None else t.prefix(a.prefix.encode(), a.db)
        df = df.select("key") if a.keys_only else df.select("key", "value")
        modes: list[str | None] = [None, None]
        for row in (df.limit(a.limit) if a.limit else df).toLocalIterator():
            cells = []
            for i, cell in enumerate(row):
                if modes[i] is None:  # the first key and the first value decide for all
                    modes[i] = a.mode if a.mode != "auto" else "text" if is_printable(bytes(cell)) else "hex"
                cells.append(show(bytes(cell), modes[i]))
            print(" = ".join(cells))
    return FINE


def run(spark: SparkSession, argv: list[str]) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else FINE
    try:
        if a.command == "dump":
            return _dump(spark, a)
        if a.command == "compact":
            with _open(spark, a.src) as s:
                new = s.compact(a.dst)
            print(f"{a.src} -> {a.dst} ({human_bytes(inspect.stats(new)['bytes'])})")
        elif a.command == "checkpoint":
            for k, v in replicate.checkpoint_of(a.store).items():
                print(f"{k:10} {v}")
        elif a.command == "ship":
            base = replicate.checkpoint_of(a.replica)
            with _open(spark, a.store) as s:
                said = replicate.extract(s, base, a.bundle)
            if said == replicate.UP_TO_DATE:
                print(f"up to date at version {base['version']}")
                return UP_TO_DATE
            if said == replicate.NEED_BASE:
                print(f"the replica is at version {base['version']}, which is gone; send a base copy", file=sys.stderr)
                return NEED_BASE
            head = replicate.inspect_bundle(a.bundle)
            print(f"{a.bundle}: version {base['version']} -> {head['target']['version']}, {len(head['files'])} files")
        elif a.command == "apply":
            before = replicate.checkpoint_of(a.replica)["version"]
            replicate.apply_bundle(a.replica, a.bundle)
            print(f"{a.replica}: version {before} -> {replicate.checkpoint_of(a.replica)['version']}")
        else:
            with _open(spark, a.store) as s:
                if a.command == "list":
                    with s.read() as t:
                        print(*t.dbs(), sep="\n")
                elif a.command == "stats":
                    for k, v in inspect.stats(s).items():
                        print(f"{k:18} {v}")
                    for r in inspect.trees(s).collect():
                        if a.db is None or r.tree == a.db:
                            print(f"{r.tree or '(main)':18} {r.order}: {r.entries} entries, {r.files} files, {human_bytes(r.bytes)}, {r.bytes_per_entry} bytes an entry")
                elif wrong := inspect.check(s):
                    print(*wrong, sep="\n", file=sys.stderr)
                    return FAILED
                else:
                    print("fine")
    except StoreError as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return FAILED
    return FINE


def main() -> int:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
