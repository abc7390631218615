"""The records: Parquet tables in one folder, and numbered states that list the parts of every table.

A write makes new parts and then a new state, which names them; readers see the state before or the one after, never
anything between, and a write that several tables share is one state. A state is made under a number that must be free:
of two writers at once, the second reads the first one's state and tries again. Appends write only the new rows' files.
All access goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..plans import audit as audits
from ..plans import check as checks
from ..plans.check import numbered
from ..schema import DEFAULTS, TABLES
from ..settings import DEFAULT, Settings
from . import ingest
from .scratch import scope, written


#: States that are kept beside the newest one, for readers that have just opened an older one.
OLD_STATES = 20
State = dict[str, list[str]]


class Conflict(RuntimeError):
    """Another writer changed a table that a write was computed from."""


class Store:
    """Tables of TABLES under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULT):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    # files

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, content: str) -> bool:
        """The content under a name that must be free: written beside it and renamed, which the file system does at
        once or not at all. False if the name is taken."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        new, at = self._path(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(content.encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(new), self._fs.makeQualified(at), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _names(self, prefix: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(self.path)) if (n := s.getPath().getName()).startswith(prefix))

    def _state(self) -> tuple[int, State]:
        """(number, parts of each table) of the newest state."""
        names = self._names("state-")
        return (int(names[-1][6:-5]), json.loads(self._read(names[-1]) or "{}")) if names else (0, {})

    def _commit(self, change: Callable[[State], State], based_on: State | None = None) -> None:
        """Make the next state. based_on: the parts, by table, that the write was computed from and that must be current."""
        while True:
            number, now = self._state()
            for table, parts in (based_on or {}).items():
                if now.get(table, []) != parts:
                    raise Conflict(f"{table} was changed by another writer")
            if self._write(f"state-{number + 1:012d}.json", json.dumps(now | change(now))):
                break
        for old in self._names("state-")[: -OLD_STATES - 1]:
            self._fs.delete(self._path(f"{self.path}/{old}"), False)

    def _parts(self, table: str) -> list[str]:
        return self._state()[1].get(table, [])

    def _new_part(self, name: str, rows: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        self._shaped(name, rows).write.parquet(f"{self.path}/{part}")
        return part

    # tables

    def table(self, name: str) -> DataFrame:
        """The current version; an older file without a newer column has nulls in it."""
        schema = T.StructType.fromDDL(TABLES[name])
        parts = self._parts(name)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over the tables, with named parameters."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or None)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        schema = T.StructType.fromDDL(TABLES[name])
        have = set(rows.columns)
        cols = []
        for f in schema:
            c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
            cols.append((F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS and name == "invoices" else c).alias(f.name))
        return rows.select(*cols)

    def append(self, name: str, rows: DataFrame) -> None:
        part = self._new_part(name, rows)
        self._commit(lambda now: {name: [*now.get(name, []), part]})

    def replace(self, **tables: DataFrame) -> None:
        """Whole tables anew, all at once; what others append meanwhile stays. The parts of the version before stay until
        vacuum()."""
        before = self._state()[1]
        parts = {name: self._new_part(name, rows) for name, rows in tables.items()}
        self._commit(lambda now: {name: [part, *(p for p in now.get(name, []) if p not in before.get(name, []))] for name, part in parts.items()})

    def vacuum(self, least_age: float = 86_400) -> int:
        """Delete parts that no state or backup lists and that are older than least_age seconds, since a writer lists its
        parts only when all are written. Returns their number."""
        listed, there = set(), []
        for s in self._fs.listStatus(self._path(self.path)):
            file = s.getPath().getName()
            if s.isDirectory():
                if s.getModificationTime() <= (time.time() - least_age) * 1000:
                    there.append(file)
            elif file.endswith(".json") and not file.startswith("."):
                for parts in json.loads(self._read(file) or "{}").values():
                    listed.update(parts)
        if least_age <= 0:  # nobody else writes: older states are not read any more either
            listed = {p for f in [*self._names("backup-"), *self._names("state-")[-1:]] for parts in json.loads(self._read(f)).values() for p in parts}
        gone = [f for f in there if f not in listed]
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/{f}"), True)
        return len(gone)

    def count_invoices(self) -> int:
        return self.table("invoices").count()

    def _fresh_vendors(self, rows: DataFrame) -> DataFrame:
        """Of rows, the vendors whose id is not there yet, with their place in the order of vendors."""
        fresh = rows.join(self.table("vendors").select("vendor_id"), "vendor_id", "left_anti").dropDuplicates(["vendor_id"])
        return numbered(fresh, "ord", (self.table("vendors").agg(F.max("ord")).first()[0] or 0) + 1)

    def _safely(self, work: Callable[[State], object], *tables: str, tries: int = 10):
        """work(parts of the tables), again from the start where another writer changed one of them meanwhile."""
        for k in range(tries):
            now = self._state()[1]
            try:
                return work({t: now.get(t, []) for t in tables})
            except Conflict:
                if k == tries - 1:
                    raise

    def add_vendors(self, rows: DataFrame) -> None:
        """Append vendors whose id is not there yet."""

        def work(seen: State) -> None:
            part = self._new_part("vendors", self._fresh_vendors(rows))
            self._commit(lambda now: {"vendors": [*now.get("vendors", []), part]}, seen)

        self._safely(work, "vendors")

    def _import_parts(self, rows: DataFrame, source: str) -> tuple[int, dict[str, str]]:
        """(number of rows that are not in the records yet, the new part of each table)."""
        with scope(self.spark):
            fresh, added = ingest.import_rows(rows, self.table("vendors"), self.table("invoices"), source, self.settings)
            first = (self.table("invoices").agg(F.max("id")).first()[0] or 0) + 1
            fresh = written(numbered(fresh, "id", first).withColumn("imported_at", F.current_timestamp()), "fresh")
            n = fresh.count()
            return n, {"vendors": self._new_part("vendors", self._fresh_vendors(added)), "invoices": self._new_part("invoices", fresh)} if n else {}

    def import_records(self, rows: DataFrame, source: str = "import") -> int:
        """Append rows that are not in the records, and their new vendors, all at once. Returns the number of rows."""

        def work(seen: State) -> int:
            n, parts = self._import_parts(rows, source)
            if parts:
                self._commit(lambda now: {t: [*now.get(t, []), p] for t, p in parts.items()}, seen)
            return n

        return self._safely(work, "vendors", "invoices")

    def merge_split_vendors(self, generated_only: bool = False) -> int:
        from ..operators.vendors import merge_split_vendors

        def work(seen: State) -> int:
            kept, moved, moves = merge_split_vendors(self.table("vendors"), self.table("invoices"), generated_only)
            n = moves.count()
            if n:
                parts = {"invoices": self._new_part("invoices", moved), "vendors": self._new_part("vendors", kept)}
                self._commit(lambda now: {t: [p] for t, p in parts.items()}, seen)
            return n

        return self._safely(work, "vendors", "invoices")

    # workloads

    def audit(self, rates: DataFrame | None = None) -> dict:
        merged = self.merge_split_vendors()
        results, _, _, summary = audits.audit(self.table("vendors"), self.table("invoices"), rates, self.settings)
        if summary["records"]:
            self.replace(detection_results=results.withColumn("detected_at", F.current_timestamp()))
            summary["vendor_ids_merged"] = merged
        return summary

    def check(self, new: DataFrame, rates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        return checks.check(self.table("invoices"), self.table("vendors"), new, rates, self.settings)

    def add_to_records(self, results: DataFrame, source: str = "receipt-check") -> int:
        """Checked invoices as records, so that later copies of them are found. Suspicious ones are refused."""
        if "verdict" in results.columns and results.where("verdict = 'SUSPICIOUS'").head(1):
            raise ValueError("suspicious invoices cannot become records")
        return self.import_records(results.select(*checks.INPUT), source)

    def _log_part(self, results: DataFrame, *how) -> str:
        first = (self.table("receipt_checks").agg(F.max("id")).first()[0] or 0) + 1
        return self._new_part("receipt_checks", numbered(check_log(results, *how), "id", first).withColumn("checked_at", F.current_timestamp()))

    def log_checks(self, results: DataFrame, source: str, file_name: str | None = None, tamper_score: float | None = None, verdict=None, checked_by: str | None = None) -> None:
        """Append checked invoices to the log, with who ran the check; verdict, a column, stands in for theirs."""

        def work(seen: State) -> None:
            part = self._log_part(results, source, file_name, tamper_score, verdict, checked_by)
            self._commit(lambda now: {"receipt_checks": [*now.get("receipt_checks", []), part]}, seen)

        self._safely(work, "receipt_checks")

    def log_batch(self, results: DataFrame, name: str, added: DataFrame | None = None, source: str = "stream") -> bool:
        """Log a batch under its name and add the invoices `added` to the records, in one state: both or none. False if
        the name is logged already."""

        def work(seen: State) -> bool:
            if self.table("receipt_checks").where(F.col("source") == F.lit(name)).head(1):
                return False
            parts = self._import_parts(added.select(*checks.INPUT), source)[1] if added is not None else {}
            parts["receipt_checks"] = self._log_part(results, name)
            self._commit(lambda now: {t: [*now.get(t, []), p] for t, p in parts.items()}, seen)
            return True

        return self._safely(work, "receipt_checks", "vendors", "invoices")

    def backup(self, keep: int = 30) -> str:
        """A snapshot of all tables: the lists of their parts, which are never changed. The newest `keep` stay."""
        name = f"backup-{time.strftime('%Y%m%d-%H%M%S')}-{time.time_ns() % 10**9:09d}.json"
        now = self._state()[1]
        self._write(name, json.dumps({t: now.get(t, []) for t in TABLES}))
        for f in self._names("backup-")[:-keep]:
            self._fs.delete(self._path(f"{self.path}/{f}"), False)
        return name

    def restore(self, name: str) -> None:
        parts = json.loads(self._read(name))
        self._commit(lambda now: parts)

    def report(self, most: int = 500) -> DataFrame:
        """The records that the last audit flagged, the strongest first."""
        found = self.table("detection_results").where("risk_category <> 'LOW'")
        return found.join(self.table("invoices"), F.col("invoice_row_id") == F.col("id")).orderBy(F.desc("final_score"), "id").limit(most)

    def recent(self, name: str, most: int) -> DataFrame:
        return self.table(name).orderBy(F.desc("id")).limit(most)


def check_log(results: DataFrame, source: str, file_name: str | None = None, tamper_score: float | None = None, verdict=None, checked_by: str | None = None) -> DataFrame:
    """results in the columns of the check log."""
    return results.select(
        F.lit(source).alias("source"), F.lit(file_name).cast("string").alias("file_name"), "invoice_id", "vendor_name", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "amount", "currency",
        "final_score", "risk_category", "flags", F.lit(tamper_score).cast("double").alias("tamper_score"), (F.col("verdict") if verdict is None else verdict).alias("verdict"), F.lit(checked_by).cast("string").alias("checked_by"),
    )


def csv_escaped(df: DataFrame) -> DataFrame:
    """df with text that a spreadsheet would run quoted; numbers are untouched."""
    return df.select(*[text.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_escaped(df).write.csv(path, header=True, mode="overwrite", escape='"')


def save_rates(rates: DataFrame, path: str) -> None:
    """A rate table with positive rates only, currencies in capitals."""
    rates.where("currency is not null and usd_per_unit > 0").select(F.upper(text.strip(F.col("currency"))).alias("currency"), "usd_per_unit").write.csv(path, header=True, mode="overwrite")


def read_rates(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """Saved rates over the default ones."""
    from ..operators.cleaning import usd_rates

    return usd_rates(spark, spark.read.csv(path, header=True, schema="currency string, usd_per_unit double"), settings)
