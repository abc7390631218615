"""Audit: score all records. score() is shared with the check of new invoices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, pairs, rules, stats, vendors
from ..settings import DEFAULT, Settings
from ..sources.scratch import written


@dataclass(frozen=True)
class Scored:
    rows: DataFrame
    pairs: DataFrame
    candidates: DataFrame


def score(invoices: DataFrame, rates: DataFrame | None = None, settings: Settings = DEFAULT) -> Scored:
    """clean, match, compare with the vendor's usual, apply the rules. Rows with an id below 0 are new.

    Every step reads the cleaned rows, so they are written once, as are the pairs.
    """
    cleaned = written(cleaning.clean(invoices, rates, settings), "cleaned")
    found = pairs.candidates(cleaned, settings)
    confirmed = written(pairs.new_side_last(pairs.confirm(found, settings)), "pairs")
    featured = stats.add_features(cleaned, settings)
    return Scored(rules.apply_rules(featured, confirmed, settings, keys=cleaned), confirmed, found)


def evaluate(rows: DataFrame) -> DataFrame:
    """Precision and recall of the HIGH tier against is_anomaly, over labelled rows; 0 where there is nothing to divide."""
    truth, flagged = F.col("is_anomaly") != 0, F.col("risk_category") == "HIGH"
    sums = rows.where("is_anomaly is not null").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(truth).alias("known_bad"), F.count_if(flagged).alias("flagged"), F.count_if(truth & flagged).alias("hits"))
    part = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    return sums.select("labelled", "known_bad", "flagged", part("hits", "flagged").alias("precision"), part("hits", "known_bad").alias("recall"))


def recall_by_type(rows: DataFrame) -> DataFrame:
    """(anomaly_type, recall): share of each type's bad rows that is HIGH, to 3 decimals."""
    bad = rows.where("is_anomaly <> 0 and anomaly_type is not null")
    return bad.groupBy("anomaly_type").agg(F.round(F.avg((F.col("risk_category") == "HIGH").cast("double")), 3).alias("recall"))


def audit(vendor_table: DataFrame, invoices: DataFrame, rates: DataFrame | None = None, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(results, vendors, invoices, summary): split vendors merged, all records scored.

    results has invoice_row_id, final_score, risk_category, flags. The summary reads the written scores.
    """
    kept, moved, moves = vendors.merge_split_vendors(vendor_table, invoices)
    if not moved.head(1):
        return moved.select(F.col("id").alias("invoice_row_id"), F.lit(0.0).alias("final_score"), F.lit("").alias("risk_category"), F.lit("").alias("flags")), kept, moved, {"records": 0}
    done = score(moved, rates, settings)
    rows = written(done.rows, "scored")
    tiers = {r[0]: r[1] for r in rows.groupBy("risk_category").count().collect()}
    summary = {
        "records": sum(tiers.values()),
        "vendors": rows.agg(F.count_distinct("vendor_id")).first()[0],
        "vendor_ids_merged": moves.count(),
        "near_duplicate_candidates": done.candidates.agg(pairs.candidate_count(done.candidates)).first()[0],
        "near_duplicates": done.pairs.count(),
        **tiers,
    }
    if "is_anomaly" in rows.columns:
        accuracy = evaluate(rows).first().asDict()
        if accuracy["labelled"]:
            if "anomaly_type" in rows.columns:
                accuracy["recall_by_type"] = {r[0]: r[1] for r in recall_by_type(rows).collect()}
            summary["accuracy"] = accuracy
    results = rows.select(F.col("id").alias("invoice_row_id"), "final_score", "risk_category", "flags")
    return results, kept, moved, summary
