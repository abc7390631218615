"""Ingest: loosely structured exports into the invoice schema, and new rows into the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import parse_date
from ..operators import vendors
from ..settings import DEFAULT, Settings

REQUIRED = ["invoice_id", "vendor_name", "invoice_date", "amount"]
#: The column headings that exports use for each field.
ALIASES = {
    "invoice_id": ["invoice id", "invoice no", "invoice number", "invoice", "inv no", "document number", "doc no", "receipt no", "receipt number", "bill no", "bill number", "reference", "ref"],
    "vendor_name": ["vendor name", "vendor", "supplier", "supplier name", "payee", "company", "merchant", "seller"],
    "vendor_id": ["vendor id", "vendor code", "supplier id", "supplier code", "vendor number"],
    "invoice_date": ["invoice date", "date", "document date", "posting date", "bill date", "receipt date"],
    "amount": ["amount", "total", "invoice amount", "gross amount", "total amount", "amount paid", "value"],
    "currency": ["currency", "curr", "ccy"],
    "po_number": ["po number", "po", "purchase order", "po no"],
    "due_date": ["due date", "payment due"],
    "department": ["department", "dept", "cost center", "cost centre"],
    "payment_status": ["payment status", "status"],
    "erp_source": ["erp source", "erp", "source system"],
    "is_anomaly": ["is anomaly", "is fraud", "fraud", "label"],
    "anomaly_type": ["anomaly type", "fraud type"],
}
IMPORT_KEY = ["vendor_id", "invoice_id", "invoice_date", "amount"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns (values keep leading zeros), or an Excel file by its ending, which needs openpyxl."""
    if path.lower().endswith((".xlsx", ".xlsm", ".xls")):
        import pandas as pd

        try:
            sheet = pd.read_excel(path, dtype=str)
        except ImportError as e:
            raise RuntimeError("reading Excel files needs the openpyxl library, which is not installed") from e
        return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None), ", ".join(f"`{c}` string" for c in sheet.columns))
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def map_columns(columns: list[str]) -> dict[str, str]:
    """field -> column, the first column that names a field."""
    fields = {alias: field for field, names in ALIASES.items() for alias in [field.replace("_", " "), *names]}
    out: dict[str, str] = {}
    for c in columns:
        field = fields.get(text.header_name(c))
        if field and field not in out:
            out[field] = c
    return out


def day_first_evidence(dates: DataFrame, column: str) -> DataFrame:
    """One row: day_first, and a warning (or null): what the first two numbers of dates like 03/01/2024 show."""
    pattern = r"(?U)^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}\b"
    part = lambda g: F.try_to_number(F.nullif(F.regexp_extract(F.col(column).cast("string"), pattern, g), F.lit("")), F.lit("99"))
    found = dates.agg(F.coalesce(F.bool_or(part(1) > 12), F.lit(False)).alias("d"), F.coalesce(F.bool_or(part(2) > 12), F.lit(False)).alias("m"), F.count(part(1)).alias("n"))
    both = "Some dates can only be day-first and others only month-first; each was read in the order that fits it. Look through the dates before you rely on them."
    neither = "No date shows whether day or month comes first; months were taken to come first. Import again as day-first if that is wrong."
    return found.select(F.col("d").alias("day_first"), F.when(F.col("d") & F.col("m"), both).when(~F.col("d") & ~F.col("m") & (F.col("n") > 0), neither).alias("warning"))


def coerced(raw: DataFrame, found: dict[str, str], day_first: bool) -> DataFrame:
    """The mapped columns of raw with their types, and `bad` for rows without number, vendor, date or amount."""
    c = {f: F.col(f"`{col}`").cast("string") for f, col in found.items()}
    cols = {"invoice_id": text.strip(c["invoice_id"]), "vendor_name": text.strip(c["vendor_name"]), "amount": F.regexp_replace(c["amount"], r"[^\d.\-]", "").try_cast("double")}
    cols |= {f: parse_date(c[f], day_first) for f in ("invoice_date", "due_date") if f in c}
    cols["currency"] = F.upper(F.coalesce(c["currency"], F.lit("USD"))) if "currency" in c else F.lit("USD")
    if "is_anomaly" in c:
        cols["is_anomaly"] = c["is_anomaly"].try_cast("double").cast("int")
    cols |= {f: x for f, x in c.items() if f not in cols}
    rows = raw.select(*[x.alias(f) for f, x in cols.items()])
    blank = lambda f: F.col(f).isNull() | F.col(f).isin("", "nan")
    return rows.withColumn("bad", blank("invoice_id") | blank("vendor_name") | F.col("invoice_date").isNull() | F.col("amount").isNull())


def normalize(raw: DataFrame, day_first: bool | None = None) -> tuple[DataFrame, list[str]]:
    """(valid rows in the invoice schema, problems found)."""
    found = map_columns(raw.columns)
    missing = [f for f in REQUIRED if f not in found]
    if missing:
        empty = raw.limit(0).select(*[F.col(f"`{c}`").alias(f) for f, c in found.items()])
        return empty, [f"Missing required column(s): {', '.join(missing)}. Found: {', '.join(raw.columns)}"]
    problems = []
    if day_first is None:
        day_first, warning = day_first_evidence(raw, f"`{found['invoice_date']}`" if "`" not in found["invoice_date"] else found["invoice_date"]).first()
        problems += [warning] if warning else []
    rows = coerced(raw, found, day_first)
    bad = rows.where("bad").count()
    if bad:
        problems.append(f"Skipped {bad} row(s) with a missing or unreadable invoice number, vendor, date or amount.")
    return rows.where("not bad").drop("bad"), problems


def not_recorded(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows whose vendor, number, date and amount no record has yet; repeats inside rows stay."""
    have = records.select(*[F.col(k).alias(f"_{k}") for k in IMPORT_KEY]).distinct()
    on = [F.col(k).cast("string") == F.col(f"_{k}").cast("string") for k in ("vendor_id", "invoice_id", "invoice_date")]
    return rows.join(have, [*on, F.col("amount").cast("double") == F.col("_amount").cast("double")], "left_anti")


def import_rows(rows: DataFrame, vendor_table: DataFrame, records: DataFrame, source: str = "import", settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(new invoices, new vendors) to append. Where a new vendor comes in several rows, its first name by number is kept."""
    if "vendor_id" not in rows.columns:
        rows = rows.withColumn("vendor_id", F.lit(None).cast("string"))
    fresh = not_recorded(vendors.resolve_vendors(rows, vendor_table, settings), records).withColumn("source", F.lit(source))
    erp = F.col("erp_source") if "erp_source" in fresh.columns else F.lit(None).cast("string")
    named = fresh.groupBy("vendor_id").agg(F.min_by(F.struct("vendor_name", erp.alias("erp_source")), F.struct("invoice_date", "invoice_id")).alias("v"))
    added = named.select("vendor_id", "v.vendor_name", text.vendor_clean(F.col("v.vendor_name")).alias("vendor_name_normalized"), "v.erp_source")
    return fresh, added.join(vendor_table.select("vendor_id"), "vendor_id", "left_anti")
