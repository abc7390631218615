"""Invoices made from order tables, with known faults put in: what the registered queries run on.

The SQL is plain enough for Spark and other engines alike, so both can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STEM = "substr('bakelomiruvatesonidupaqexywozifuhacejogelinurasitomevu', CAST(1 + 2 * ({k} % 25) AS INT), 2)"
_NAME = " || ".join(_STEM.format(k=k) for k in ("c", "(CAST(floor(c / 25) AS BIGINT) * 7 + c)", "(CAST(floor(c / 625) AS BIGINT) * 11 + c * 3)", "(c * 5 + 2)"))

#: Placeholders: {orders}.
INVOICES = f"""
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_totalprice AS a, 'INV-' || lpad(CAST(o_orderkey AS STRING), 7, '0') AS num
  FROM {{orders}}),
named AS (
  SELECT k, d, a, num, 'C' || CAST(c AS STRING) AS vid,
    {_NAME} || CASE c % 4 WHEN 0 THEN ' supplies' WHEN 1 THEN ' logistics' WHEN 2 THEN ' services' ELSE ' trading' END AS stem,
    CASE c % 5 WHEN 0 THEN ' Ltd' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' GmbH' WHEN 3 THEN ' Sdn. Bhd. (77-M)' ELSE ' Co' END AS form,
    CASE WHEN k % 50 = 9 THEN 'XYZ' WHEN c % 3 = 0 THEN 'USD' WHEN c % 3 = 1 THEN 'EUR' ELSE 'INR' END AS cur,
    CASE WHEN k % 4 = 0 THEN 'PO-' || CAST(c AS STRING) END AS po
  FROM base)
SELECT k * 10 + j AS id,
  CASE j WHEN 1 THEN replace(num, '-', '') WHEN 2 THEN replace(num, 'INV-0', 'INV-O') WHEN 4 THEN 'OV' || CAST(k AS STRING) WHEN 5 THEN 'B1-' || CAST(k AS STRING) WHEN 6 THEN 'B2-' || CAST(k AS STRING) WHEN 7 THEN 'B3-' || CAST(k AS STRING) WHEN 8 THEN 'RN' || CAST(k AS STRING) WHEN 9 THEN num || 'A' ELSE num END AS invoice_id,
  CASE j WHEN 9 THEN 'V-' || vid ELSE vid END AS vendor_id,
  CASE j WHEN 1 THEN upper(stem || form) WHEN 2 THEN 'The ' || stem || form WHEN 9 THEN stem || ' limited' ELSE stem || form END AS vendor_name,
  d + CAST(CASE j WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 9 WHEN 8 THEN 30 ELSE 0 END AS INT) AS invoice_date,
  CASE j WHEN 8 THEN CAST(5000000 AS DOUBLE) ELSE a * CAST(CASE j WHEN 3 THEN 1.06 WHEN 4 THEN 5 WHEN 5 THEN 1.1 WHEN 6 THEN 1.2 WHEN 7 THEN 1.3 ELSE 1 END AS DOUBLE) END AS amount,
  CASE j WHEN 8 THEN 'USD' ELSE cur END AS currency,
  CASE WHEN j IN (5, 6, 7) THEN 'PB' || CAST(k AS STRING) ELSE po END AS po_number,
  CASE j WHEN 0 THEN 0 ELSE 1 END AS is_anomaly,
  CASE j WHEN 1 THEN 'copy' WHEN 2 THEN 'misread' WHEN 3 THEN 'rebilled' WHEN 4 THEN 'overpaid' WHEN 5 THEN 'burst' WHEN 6 THEN 'burst' WHEN 7 THEN 'burst' WHEN 8 THEN 'round' WHEN 9 THEN 'other id' END AS anomaly_type
FROM named JOIN (VALUES (0, 1), (1, 97), (2, 101), (3, 103), (4, 107), (5, 109), (6, 109), (7, 109), (8, 113), (9, 127)) AS v(j, every) ON k % every = 0
"""

#: About 600 invoices a vendor. Placeholders: {lineitem}.
LARGE = """
SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 20000 + l_suppkey AS id,
  'L' || CAST(l_orderkey AS STRING) AS invoice_id, 'S' || CAST(l_suppkey AS STRING) AS vendor_id, 'supplier ' || CAST(l_suppkey AS STRING) AS vendor_name,
  CAST(max(l_shipdate) AS DATE) AS invoice_date, max(l_extendedprice) AS amount, 'USD' AS currency, CAST(NULL AS STRING) AS po_number
FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
"""

#: Receipt texts. Placeholders: {invoices}.
RECEIPTS = """
SELECT id, 'WELCOME' || chr(10) || vendor_name || chr(10) || 'LOT 3, JALAN PELABUR 23/1' || chr(10) || 'Tel: 03-5511' || chr(10)
  || CASE WHEN id % 3 = 0 THEN 'TAX INVOICE' || chr(10) || 'INV NO.: ' ELSE 'Receipt No : ' END || replace(invoice_id, '-', '') || chr(10)
  || 'Date: ' || CASE WHEN id % 20 = 0 THEN CAST(invoice_date AS STRING) ELSE substr(CAST(invoice_date AS STRING), 9, 2) || '/' || substr(CAST(invoice_date AS STRING), 6, 2) || '/' || substr(CAST(invoice_date AS STRING), 1, 4) END || chr(10)
  || 'SUB TOTAL ' || CASE currency WHEN 'EUR' THEN 'EUR ' WHEN 'INR' THEN 'Rs. ' ELSE '$' END || '1.25' || chr(10)
  || CASE WHEN id % 7 = 0 THEN 'TOTAL' || chr(10) ELSE 'Total ' END || CAST(CAST(floor(amount) AS BIGINT) AS STRING) || '.' || lpad(CAST(id % 100 AS STRING), 2, '0') AS receipt
FROM {invoices}
"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INVOICES.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))


def large_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LARGE.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECEIPTS.format(invoices=f"({INVOICES.format(orders=f'parquet.`{sf_dir}/orders.parquet`')})"))
