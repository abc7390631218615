"""Check: score new invoices against the records that can affect them, and say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules, vendors
from ..settings import DEFAULT, Settings
from ..sources.scratch import written
from .audit import Scored, score

INPUT = {"invoice_id": "string", "vendor_name": "string", "invoice_date": "date", "amount": "double", "currency": "string", "vendor_id": "string", "po_number": "string"}
#: New rows up to which their keys are broadcast to the history.
BROADCAST_ROWS = 100_000


def numbered(rows: DataFrame, name: str, start: int = 1, step: int = 1) -> DataFrame:
    """rows with a gapless number in input order. The partitions' first places are joined: a row for each partition."""
    rows = written(rows.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    place = F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(F.broadcast(first), part == F.col("_p")).withColumn(name, F.lit(start) + F.lit(step) * place)
    return out.drop("_m", "_p", "_first")


def prepare(new: DataFrame) -> DataFrame:
    """new with the columns of INPUT (missing ones null), currency in capitals (USD if null) and ids -1, -2, ..."""
    rows = new.select(*[(F.col(c).cast(t) if c in new.columns else F.lit(None).cast(t)).alias(c) for c, t in INPUT.items()], *(["id"] if "id" in new.columns else []))
    rows = rows.withColumn("currency", F.upper(F.coalesce("currency", F.lit("USD"))))
    return rows if "id" in new.columns else numbered(rows, "id", -1, -1)


def relevant_history(history: DataFrame, new: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The records that can change a new row's score: those of its vendor id, or of a name in its block."""
    few = new.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    block = lambda: text.name_block(text.vendor_clean(F.col("vendor_name")), settings.block_length)
    ids = new.select(F.col("vendor_id").alias("_v")).distinct()
    blocks = new.select(block().alias("_b")).where("_b <> ''").distinct()
    marked = history.withColumn("_block", block())
    marked = marked.join(small(ids.withColumn("_by_id", F.lit(True))), F.col("vendor_id") == F.col("_v"), "left")
    marked = marked.join(small(blocks.withColumn("_by_name", F.lit(True))), F.col("_block") == F.col("_b"), "left")
    return marked.where("_by_id or _by_name").select(*history.columns)


def related_records(done: Scored) -> DataFrame:
    """(new_id, record_id, similarity, match_type, and the record's invoice_id, vendor_name, invoice_date, amount): what
    each new row copies. A copy inside the batch counts against its earlier row; an exact or same-number match goes
    before a near one of the same record."""
    rows = done.rows
    new = rows.where("id < 0")
    near = done.pairs.where("record_b_id < 0").select(F.col("record_b_id").alias("new_id"), F.col("record_a_id").alias("record_id"), F.col("similarity_score").alias("similarity"), "match_type", F.lit(1).alias("source"))
    a = new.where("invoice_key <> ''").select(F.col("id").alias("new_id"), "vendor_id", "invoice_key", F.col("amount_usd").alias("a"), F.col("flags").contains("same_number").alias("again"))
    b = rows.select(F.col("id").alias("record_id"), "vendor_id", "invoice_key", F.col("amount_usd").alias("b"))
    same = a.join(b, ["vendor_id", "invoice_key"]).where("(record_id > 0 or record_id > new_id) and (a = b or again)")
    same = same.select("new_id", "record_id", F.lit(1.0).alias("similarity"), F.when(F.col("a") == F.col("b"), "exact").otherwise("same number").alias("match_type"), F.lit(0).alias("source"))
    best = same.union(near).groupBy("new_id", "record_id").agg(F.min_by(F.struct("similarity", "match_type", "source"), "source").alias("m"))
    details = rows.select(F.col("id").alias("record_id"), "invoice_id", "vendor_name", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "amount")
    return best.join(details, "record_id", "left").select("new_id", "record_id", "m.similarity", "m.match_type", "m.source", "invoice_id", "vendor_name", "invoice_date", "amount")


def match_text() -> Column:
    """One match in words, over the columns of related_records()."""
    who = F.when(F.col("record_id") < 0, "another invoice in this batch").otherwise(F.concat(F.lit("record #"), F.col("record_id").cast("string")))
    percent = F.concat(F.bround(F.col("similarity") * 100, 0).cast("int").cast("string"), F.lit("%"))
    what = (
        F.when(F.col("match_type") == "exact", F.concat(F.lit("Exact duplicate of "), who))
        .when(F.col("match_type") == "same number", F.concat(F.lit("Same invoice number as "), who, F.lit(", different amount")))
        .otherwise(F.concat(F.lit("Near-duplicate ("), percent, F.lit(" similar) of "), who))
    )
    return F.concat(what, F.lit(": "), F.col("invoice_id"), F.lit(", "), F.col("vendor_name"), F.lit(", "), F.col("invoice_date"), F.lit(", "), F.format_number("amount", 2))


def reasons(rows: DataFrame, related: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """rows with a column reasons. rows need flags, known_vendor, closest (or null), has_rate beside the scores."""
    listed = related.groupBy(F.col("new_id").alias("_n")).agg(F.sort_array(F.collect_list(F.struct("source", (-F.col("record_id")).alias("o"), match_text().alias("t")))).alias("_m"))
    rows = rows.join(listed, F.col("id") == F.col("_n"), "left")
    fired = lambda name: F.array_contains(F.split("flags", ","), name)
    new_vendor = F.concat(F.lit("New vendor: no payment history to compare against"), F.coalesce(F.concat(F.lit(". Did you mean '"), F.col("closest"), F.lit("'? Correct the name or set its vendor ID to compare")), F.lit("")))
    parts = F.concat(
        F.coalesce(F.col("_m.t"), F.array().cast("array<string>")),
        F.array(
            F.when(fired("overpayment"), F.concat(F.lit("Amount is "), F.format_string("%.1f", "amount_to_vendor_median"), F.lit("x this vendor's usual (median) invoice"))),
            F.when(fired("rapid_fire"), F.lit(f"{settings.burst}+ invoices from this vendor on the same PO and date")),
            F.when(fired("round_number"), F.lit("Large round-number amount, well above this vendor's usual")),
            F.when(~F.col("known_vendor"), new_vendor),
            F.when(~F.col("has_rate"), F.concat(F.lit("No exchange rate for "), F.col("currency"), F.lit(": amount compared as if it were USD (add one under Exchange rates)"))),
        ),
    )
    said = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ")
    return rows.withColumn("reasons", F.when(said == "", "No issues found against existing records").otherwise(said)).drop("_n", "_m")


def check(history: DataFrame, vendor_table: DataFrame, new: DataFrame, rates: DataFrame | None = None, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(a result for each new invoice, first of the batch first; the records that each one copies)."""
    rows = written(vendors.resolve_vendors(prepare(new), vendor_table, settings), "batch")
    past = relevant_history(history, rows, settings)
    done = score(past.unionByName(rows, allowMissingColumns=True), rates, settings)
    done = Scored(written(done.rows, "scored"), done.pairs, done.candidates)
    related = written(related_records(done), "related")
    found = done.rows.where("id < 0")
    seen = done.rows.where("id > 0").select(F.col("vendor_id").alias("_v")).distinct().withColumn("_known", F.lit(True))
    found = found.join(seen, F.col("vendor_id") == F.col("_v"), "left").withColumn("known_vendor", F.coalesce("_known", F.lit(False)))
    strangers = found.where(~F.col("known_vendor")).select("vendor_name")
    if strangers.head(1):
        nearest = vendors.closest_vendors(strangers, vendor_table, settings).select(F.col("vendor_name").alias("_name"), "closest")
        found = found.join(nearest, F.col("vendor_name") == F.col("_name"), "left")
    else:
        found = found.withColumn("closest", F.lit(None).cast("string"))
    if rates is None:
        found = found.withColumn("has_rate", F.col("currency").isin(*settings.rates))
    else:
        found = found.join(rates.select(F.col("currency").alias("_cur"), F.lit(True).alias("_has")), F.col("currency") == F.col("_cur"), "left").withColumn("has_rate", F.coalesce("_has", F.lit(False)))
    told = reasons(found, related, settings).withColumn("verdict", rules.verdict(F.col("risk_category")))
    out = told.select(*INPUT, "id", "final_score", "risk_category", "verdict", "flags", "reasons", "amount_to_vendor_median", "vendor_history_count")
    return out.orderBy(F.desc("id")), related
