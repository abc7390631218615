"""Near-duplicate pairs: a band join on amounts and dates inside vendor blocks, then similarity.

Amounts within the tolerance fall into the same or the next cell of a logarithmic grid, and dates within the window
into neighbouring cells of days; the smaller amount's row is sent to all cells that its partner can be in, so the join
is an equi-join on (block, amount cell, day cell) with an exact residual. A block that holds every vendor is thus still
spread over many keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import pair_similarity
from ..settings import DEFAULT, Settings

PAIRS = "record_a_id bigint, record_b_id bigint, similarity_score double, levenshtein_score double, jaro_winkler_score double, match_type string"


def _cell(amount: Column, settings: Settings) -> Column:
    """The grid cell of an amount; null below -slack/tolerance, where no amount is within the window of a smaller one."""
    shift = settings.amount_slack / settings.amount_tolerance
    width = math.log(1 + settings.amount_tolerance) * 1.000001
    return F.when(amount >= -shift, F.floor(F.log(F.greatest(amount + shift, F.lit(1e-9))) / width))


def candidates(cleaned: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Pairs (i_*, j_*) within the amount and date windows that share a name block or a vendor id, each once.

    i is the smaller by (amount, id). by_block tells which blocking found it; the pairs of one vendor id and one block,
    which both find, are those with same_vendor among the first.
    """
    days = settings.date_window + 1
    w = cleaned.select(
        "id", "vendor_id", F.col("invoice_id").alias("raw_id"), F.col("vendor_name_clean").alias("name"), F.col("amount_usd").alias("amount"),
        F.unix_date("invoice_date").alias("day"), text.clean_id(F.col("invoice_id")).alias("clean_id"), text.name_block(F.col("vendor_name_clean"), settings.block_length).alias("block"),
    ).withColumns({"cell": _cell(F.col("amount"), settings), "week": F.floor(F.col("day") / days)})
    w = w.withColumn("shape", text.id_shape(F.col("clean_id"))).where("cell is not null and day is not null")
    small = w.select(*[F.col(c).alias(f"i_{c}") for c in w.columns if c not in ("cell", "week")], F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"), "week")
    small = small.withColumn("week", F.explode(F.array(F.col("week") - 1, "week", F.col("week") + 1)))
    large = w.select(*[F.col(c).alias(f"j_{c}") for c in w.columns if c not in ("cell", "week")], "cell", "week")

    def joined(key: str, more: Column) -> DataFrame:
        i, j = small.withColumn("k", F.col(f"i_{key}")), large.withColumn("k", F.col(f"j_{key}"))
        window = F.col("j_amount") <= F.col("i_amount") * (1 + settings.amount_tolerance) + settings.amount_slack
        order = (F.col("i_amount") < F.col("j_amount")) | ((F.col("i_amount") == F.col("j_amount")) & (F.col("i_id") < F.col("j_id")))
        near = F.abs(F.col("j_day") - F.col("i_day")) <= settings.date_window
        copy = (F.col("i_raw_id") == F.col("j_raw_id")) & (F.col("i_vendor_id") == F.col("j_vendor_id"))
        return i.join(j, ["k", "cell", "week"]).where(window & order & near & ~copy & more).drop("k", "cell", "week")

    by_name = joined("block", F.col("i_block") != "").withColumn("by_block", F.lit(True))
    by_vendor = joined("vendor_id", (F.col("i_block") != F.col("j_block")) | (F.col("i_block") == "")).withColumn("by_block", F.lit(False))
    return by_name.union(by_vendor).withColumn("same_vendor", F.col("i_vendor_id") == F.col("j_vendor_id"))


def candidate_count(found: DataFrame) -> Column:
    """The number of candidates, one found by both blockings counting twice; an aggregate over candidates()."""
    return F.count(F.lit(1)) + F.count_if(F.col("by_block") & F.col("same_vendor"))


def confirm(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The candidates that are one invoice entered twice: see PAIRS. record_b is the later by (date, id)."""
    s = settings
    same_id = F.col("same_vendor") & (F.col("i_clean_id") == F.col("j_clean_id"))
    # Numbers that differ in digits alone, on different days, are a vendor's next invoice.
    rest = found.withColumn("same_id", same_id).where(F.col("same_id") | (F.col("i_shape") != F.col("j_shape")) | (F.col("i_day") == F.col("j_day")))
    scored = rest.withColumn("s", pair_similarity(F.col("i_clean_id"), F.col("j_clean_id"), F.col("i_name"), F.col("j_name")))
    scored = scored.withColumn("name_sim", s.ratio_weight * F.col("s.name_ratio") + s.jaro_winkler_weight * F.col("s.name_jw"))
    similar = F.col("same_vendor") & (F.col("s.id_ratio") >= s.id_match)
    variant = (F.col("name_sim") >= s.name_same_vendor) & (F.col("same_vendor") | (F.col("name_sim") >= s.name_any_vendor))
    kept = scored.withColumn("similar", similar).where(F.col("same_id") | F.col("similar") | (variant & (F.col("s.id_ratio") >= s.id_support)))
    later = (F.col("j_day") > F.col("i_day")) | ((F.col("j_day") == F.col("i_day")) & (F.col("j_id") > F.col("i_id")))
    number = F.when(F.col("similar"), F.col("s.id_ratio")).otherwise(F.when(F.col("same_id"), F.lit(1.0)).otherwise(0.0))
    return kept.select(
        F.when(later, F.col("i_id")).otherwise(F.col("j_id")).alias("record_a_id"), F.when(later, F.col("j_id")).otherwise(F.col("i_id")).alias("record_b_id"),
        F.bround(F.greatest("name_sim", number), 4).alias("similarity_score"), F.bround("s.name_ratio", 4).alias("levenshtein_score"), F.bround("s.name_jw", 4).alias("jaro_winkler_score"),
        F.when(F.col("same_id") | F.col("similar"), "cross_erp_id").otherwise("vendor_variant").alias("match_type"),
    )


def new_side_last(pairs: DataFrame) -> DataFrame:
    """Pairs in which a new row (id below 0) is record_b when the other one is a stored record."""
    flip = (F.col("record_a_id") < 0) & (F.col("record_b_id") > 0)
    a, b = F.col("record_a_id"), F.col("record_b_id")
    return pairs.select(F.when(flip, b).otherwise(a).alias("record_a_id"), F.when(flip, a).otherwise(b).alias("record_b_id"), *pairs.columns[2:])
