"""The rules: each scores an invoice from 0 to 1; the strongest decides its tier.

What repeats is found by grouping first and keeping the groups of more than one, so a shuffle carries few columns and a
key that very many invoices share is combined map-side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings


def sequence() -> Column:
    """Input order: stored records by id, then new rows by the order of their batch (ids -1, -2, ...)."""
    return F.struct((F.col("id") < 0).alias("new"), F.abs("id").alias("n"))


def repeated(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, uses, first_seq) of the groups of at least two rows; nulls in keys group together."""
    return cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"), F.min(sequence()).alias("first_seq")).where("uses > 1")


def _flag(cleaned: DataFrame, groups: DataFrame, keys: list[str], where: Column, flag: str) -> DataFrame:
    """(_id, flag) of the rows of groups where `where` holds."""
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "uses", "first_seq")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    slim = cleaned.select("id", *keys, sequence().alias("seq"))
    return slim.join(groups, on).where(where).select(F.col("id").alias("_id"), F.lit(True).alias(flag))


def exact_duplicates(cleaned: DataFrame) -> DataFrame:
    """(_id, exact): later copies of one vendor, number and amount."""
    keys = ["vendor_id", "invoice_key", "amount_usd"]
    return _flag(cleaned, repeated(cleaned, keys), keys, F.col("seq") != F.col("first_seq"), "exact")


def rebilled(cleaned: DataFrame) -> DataFrame:
    """(_id, again): the second of exactly two uses of one vendor's number."""
    keys = ["vendor_id", "invoice_key"]
    groups = repeated(cleaned.where("invoice_key <> ''"), keys).where("uses = 2")
    return _flag(cleaned, groups, keys, F.col("seq") != F.col("first_seq"), "again")


def bursts(cleaned: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(_id, burst): all invoices of a vendor, order and date that has several. A null order number has none."""
    keys = ["vendor_id", "po_number", "invoice_date"]
    known = cleaned.where(F.col("po_number").isNotNull() & F.col("invoice_date").isNotNull())
    groups = known.groupBy(*keys).agg(F.count("invoice_id").alias("uses"), F.min(sequence()).alias("first_seq")).where(F.col("uses") >= settings.burst)
    return _flag(known, groups, keys, F.lit(True), "burst")


@dataclass(frozen=True)
class Rule:
    """A named score, as a column over the joined facts; rules of one's own can be added to RULES."""

    name: str
    score: Callable[[Settings], Column]


def _overpayment(s: Settings) -> Column:
    ratio, z = F.col("amount_to_vendor_median"), F.col("amount_robust_z")
    known = F.col("vendor_history_count") >= s.over_history
    strong = F.greatest(F.lit(0.85), F.least(F.greatest(ratio - 1, F.lit(0.0)), F.lit(5.0)) / 5)
    return F.when(known & (ratio >= s.over_ratio) & (z >= s.over_z), strong).when(known & (ratio >= s.review_ratio) & (z >= s.review_z), 0.7).otherwise(0.0)


def _round_number(s: Settings) -> Column:
    a = F.col("amount_usd")
    return F.when((a >= s.round_least) & (F.pmod(a, F.lit(s.round_step)) == 0) & (F.col("amount_to_vendor_median") >= s.round_ratio), 0.65).otherwise(0.0)


RULES = [
    Rule("exact_dup", lambda s: F.when(F.col("_exact"), 1.0).otherwise(0.0)),
    Rule("near_dup", lambda s: F.coalesce("_near", F.lit(0.0))),
    Rule("same_number", lambda s: F.when(F.col("_again") & ~F.col("_exact"), 0.6).otherwise(0.0)),
    Rule("overpayment", _overpayment),
    Rule("rapid_fire", lambda s: F.when(F.col("_burst"), 0.9).otherwise(0.0)),
    Rule("round_number", _round_number),
]


def tier(score: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(score >= settings.high, "HIGH").when(score >= settings.medium, "MEDIUM").otherwise("LOW")


def verdict(category: Column, tampered: Column | None = None) -> Column:
    """SUSPICIOUS for HIGH; REVIEW for MEDIUM, or where the image looks edited; else OK."""
    review = category == "MEDIUM" if tampered is None else (category == "MEDIUM") | F.coalesce(tampered, F.lit(False))
    return F.when(category == "HIGH", "SUSPICIOUS").when(review, "REVIEW").otherwise("OK")


def apply_rules(featured: DataFrame, pairs: DataFrame, settings: Settings = DEFAULT, rules: list[Rule] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """featured with final_score, risk_category and flags (the rules that fired, comma-joined; none: "none"). keys: the
    same rows before the features, where those need not be computed for grouping."""
    rules = RULES if rules is None else rules
    keys = featured if keys is None else keys
    near = pairs.groupBy(F.col("record_b_id").alias("_id")).agg(F.max("similarity_score").alias("near"))
    facts = featured
    for found, name in ((exact_duplicates(keys), "exact"), (near, "near"), (rebilled(keys), "again"), (bursts(keys, settings), "burst")):
        found = found.select(F.col("_id").alias(f"_id_{name}"), F.col(name).alias(f"_{name}"))
        facts = facts.join(found, F.col("id") == F.col(f"_id_{name}"), "left").drop(f"_id_{name}")
    facts = facts.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_exact", "_again", "_burst")})
    facts = facts.withColumns({f"_s{i}": r.score(settings) for i, r in enumerate(rules)})
    scores = [F.col(f"_s{i}") for i in range(len(rules))]
    fired = F.concat_ws(",", *[F.when(s > 0, r.name) for s, r in zip(scores, rules, strict=True)])
    facts = facts.withColumn("final_score", F.least(F.greatest(*scores, F.lit(0.0)), F.lit(1.0)))
    facts = facts.withColumns({"risk_category": tier(F.col("final_score"), settings), "flags": F.when(fired == "", "none").otherwise(fired)})
    return facts.drop("_exact", "_near", "_again", "_burst", *[f"_s{i}" for i in range(len(rules))])
