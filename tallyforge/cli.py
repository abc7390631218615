"""Command line: python -m tallyforge STORE import|check|audit|backup FILE ..."""

from __future__ import annotations

import argparse
import getpass
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources import ingest
from .sources.store import Store, read_rates, write_csv


def _load(spark: SparkSession, path: str, day_first: bool | None):
    rows, problems = ingest.normalize(ingest.read_table(spark, path), day_first)
    for p in problems:
        print(p)
    return rows


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    parser.add_argument("store", help="folder of the records")
    parser.add_argument("--rates", help="CSV of currency, usd_per_unit")
    todo = parser.add_subparsers(dest="command", required=True)
    for name in ("import", "check"):
        p = todo.add_parser(name)
        p.add_argument("file")
        order = p.add_mutually_exclusive_group()
        order.add_argument("--dayfirst", dest="day_first", action="store_true", default=None)
        order.add_argument("--monthfirst", dest="day_first", action="store_false")
        if name == "check":
            p.add_argument("--out", help="folder for the results as CSV")
    todo.add_parser("audit")
    todo.add_parser("backup")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyforge").getOrCreate()
    store = Store(spark, args.store)
    rates = read_rates(spark, args.rates) if args.rates else None
    if args.command == "import":
        print(f"{store.import_records(_load(spark, args.file, args.day_first))} new records")
    elif args.command == "check":
        results, _ = store.check(_load(spark, args.file, args.day_first), rates)
        results = results.persist()
        store.log_checks(results, args.file, args.file, checked_by=getpass.getuser())
        if args.out:
            write_csv(results.drop("id"), args.out)
        for r in results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).orderBy("verdict").collect():
            print(f"{r.verdict}: {r.n}")
    elif args.command == "audit":
        print(json.dumps(store.audit(rates), indent=1))
    else:
        print(store.backup())
    return 0
