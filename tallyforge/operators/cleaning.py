"""Cleaning: dates, amounts in USD, and the keys that matching uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..settings import DEFAULT, Settings


def usd_rates(spark: SparkSession, table: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """(currency, usd_per_unit): the default rates, overridden by a table of the same columns where one is given.

    Of several rates of a currency the highest counts. There are as many rows as currencies, so the result is small."""
    default = spark.createDataFrame(sorted(settings.rates.items()), "currency string, usd_per_unit double")
    if table is None:
        return default
    own = table.select(F.upper(text.strip(F.col("currency"))).alias("currency"), F.col("usd_per_unit").cast("double").alias("usd_per_unit"))
    own = own.groupBy("currency").agg(F.max("usd_per_unit").alias("usd_per_unit"))
    return own.union(default.join(own, "currency", "left_anti"))


def clean(invoices: DataFrame, rates: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """invoices with amount_usd, vendor_name_clean, invoice_key, and invoice_date (due_date) as dates.

    An amount in a currency without a rate counts as USD; a null amount is 0. Rates of a table are joined; the default
    ones are a constant expression.
    """
    if rates is None:
        rate = F.lit(None).cast("double")
        for code, usd in settings.rates.items():
            rate = F.when(F.col("currency") == code, F.lit(usd)).otherwise(rate)
        out = invoices.withColumn("amount_usd", F.coalesce(F.col("amount") * F.coalesce(rate, F.lit(1.0)), F.lit(0.0)))
    else:
        table = rates.select(F.col("currency").alias("_currency"), F.col("usd_per_unit").alias("_rate"))
        out = invoices.join(table, F.col("currency") == F.col("_currency"), "left")
        out = out.withColumn("amount_usd", F.coalesce(F.col("amount") * F.coalesce("_rate", F.lit(1.0)), F.lit(0.0))).drop("_currency", "_rate")
    dates = {c: F.col(c).cast("date") for c in ("invoice_date", "due_date") if c in out.columns}
    return out.withColumns(dates | {"amount": F.coalesce("amount", F.lit(0.0)), "vendor_name_clean": text.vendor_clean(F.col("vendor_name")), "invoice_key": text.invoice_key(F.col("invoice_id"))})
