"""A vendor's usual amount: medians and median deviations of its other invoices.

Vendors of up to 500 invoices are gathered in arrays, bounded by that number; removing one value from a sorted array
moves the middle by at most one place, so no array is sorted again for the medians. Larger vendors use all their
invoices: an exact median found by narrowing to a thin band of ranks, so that no task sorts a whole vendor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import bound
from ..settings import DEFAULT, Settings
from ..sources.scratch import written

#: Relative rank error of the approximate quantiles that bound a median.
_ACCURACY = 10_000


def others_median(ordered: Column, own: Column) -> Column:
    """Median of a sorted array without one element of value `own`; null if nothing is left."""

    def middle(o: Column) -> Column:
        n = F.size(o)

        def at(k: Column) -> Column:
            here = F.get(o, k)
            return F.when(own > here, here).otherwise(F.get(o, k + 1))

        half = F.floor((n - 1) / 2).cast("int")
        even = at(F.floor((n - 2) / 2).cast("int"))
        return F.when(n < 2, F.lit(None).cast("double")).when(n % 2 == 0, even).otherwise((at(half - 1) + at(half)) / 2)

    return bound(ordered, middle)


def group_median(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): the exact median of each group.

    Approximate quantiles just below and above the middle bound it; what lies below is counted, and only the band is
    ranked. The band holds about 4 / _ACCURACY of a group and its ties with the bounds, which are counted, not listed.
    """
    near = [0.5 - 2 / _ACCURACY, 0.5 + 2 / _ACCURACY]
    bounds = rows.groupBy(key).agg(F.percentile_approx(value, near, _ACCURACY).alias("_q"), F.count(value).alias("_n"))
    bounds = bounds.select(F.col(key).alias("_k"), F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_n")
    placed = rows.join(bounds, F.col(key) == F.col("_k")).where(F.col(value) <= F.col("_hi"))
    counts = placed.groupBy("_k", "_n", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda k: (F.col("_from") <= k) & (k < F.col("_to"))
    return ranked.groupBy(F.col("_k").alias(key)).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(out))


def add_features(cleaned: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """cleaned with vendor_history_count, amount_to_vendor_median and amount_robust_z, all double.

    The ratio is 1 without a positive median. z is on a log scale, by 1.4826 deviations; a vendor that always bills the
    same has deviation 0, and another amount is then 50 away, the most that z can be.
    """
    most = settings.leave_one_out_most
    rows = cleaned.withColumn("_log", F.log(F.greatest("amount_usd", F.lit(0.01))))
    sizes = cleaned.groupBy(F.col("vendor_id").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    rows = rows.join(sizes, F.col("vendor_id") == F.col("_v")).drop("_v")
    any_large = bool(sizes.where(F.col("_m") > most).head(1))

    members = rows.where(F.col("_m") <= most).groupBy("vendor_id").agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    members = members.select(F.array_sort(F.col("_rows.amount_usd")).alias("_amounts"), F.array_sort(F.col("_rows._log")).alias("_logs"), F.explode("_rows").alias("_r"))
    log, logs = F.col("_r._log"), F.col("_logs")
    away = lambda m: F.array_sort(F.transform(logs, lambda x: F.abs(x - m)))
    by_log = bound(others_median(logs, log), lambda m: F.struct(m.alias("_lmed"), others_median(away(m), F.abs(log - m)).alias("_lmad")))
    # Through a generator, so that filters on the features don't compute them once more.
    judged = members.select("_r", F.explode(F.array(F.struct(others_median(F.col("_amounts"), F.col("_r.amount_usd")).alias("_med"), by_log.alias("_l")))).alias("_f"))
    small = judged.select("_r.*", "_f._med", "_f._l._lmed", "_f._l._lmad")

    if not any_large:
        return _judged(small)
    large = written(rows.where(F.col("_m") > most), "large")
    middle = group_median(large, "vendor_id", "amount_usd", "_med").join(group_median(large, "vendor_id", "_log", "_lmed"), "vendor_id")
    deviations = large.join(middle, "vendor_id").select("vendor_id", F.abs(F.col("_log") - F.col("_lmed")).alias("_d"))
    middle = middle.join(group_median(deviations, "vendor_id", "_d", "_lmad"), "vendor_id")
    large = large.join(middle.withColumnRenamed("vendor_id", "_v"), F.col("vendor_id") == F.col("_v")).drop("_v")
    return _judged(small.unionByName(large))


def _judged(rows: DataFrame) -> DataFrame:
    """The features, from the medians and deviations of each row's vendor."""
    ratio = F.when(F.col("_med") > 0, F.col("amount_usd") / F.col("_med")).otherwise(1.0)
    off = F.col("_log") - F.col("_lmed")
    close = F.abs(off) <= 1e-8 + 1e-5 * F.abs("_lmed")
    z = F.when((F.col("_lmad") == 0) & close, 0.0).when(F.col("_lmad") == 0, F.signum(off) * 50).otherwise(off / (1.4826 * F.col("_lmad")))
    return rows.withColumns({
        "vendor_history_count": (F.col("_m") - 1).cast("double"),
        "amount_to_vendor_median": F.coalesce(ratio, F.lit(1.0)),
        "amount_robust_z": F.when(z.isNull(), 0.0).otherwise(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))),
    }).drop("_log", "_m", "_med", "_lmed", "_lmad")
