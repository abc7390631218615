"""Helpers that several operators share: shared storage, Arrow batch bounds, distributed ranks and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.scratch import dropped as unstash
from ..sources.scratch import scope, setting, shared_dir, written

#: A word, as Python and Spark regular expressions write it: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that one Arrow batch may bring to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20
#: Rows (about) of a range or bucket that one task puts in order.
ROWS_OF_A_RANGE = 50_000

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "WORD", "free_name", "give_back", "hex64", "in_order", "ranked", "scope", "shared_dir", "small_batches", "stash", "unstash", "with_column", "with_fields"]


def stash(df: DataFrame, label: str = "part") -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and a lost executor costs no recomputation."""
    return written(df, label)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that very long texts don't gather in a Python worker. An open scope()
    puts the settings back."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what the allocators of this Python worker hold unused: workers outlive their tasks, and idle
    ones count in an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def free_name(taken: list[str], name: str) -> str:
    """name, with as many underscores behind it as keep it apart from the names taken (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a further column: free_name(df.columns, name), so that no column of df is lost."""
    return df.withColumn(free_name(df.columns, name), value)


def hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def in_order(df: DataFrame, by: str, sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """df (as a table) with, for each of sums, the total of that value over all rows before, and for each of latest the
    greatest value that isn't null up to and with the row, in order of by (a column without ties).

    Rows are dealt by ranges, each is put in order alone, and what the ranges before bring comes from one row for each.
    """
    sums, latest = sums or {}, latest or {}
    held = {**{f"_s{i}": c for i, c in enumerate(sums.values())}, **{f"_m{i}": c for i, c in enumerate(latest.values())}}
    rows = stash(df.withColumns(held), "rows") if held else stash(df, "rows")
    parts = max(1, -(-rows.count() // ROWS_OF_A_RANGE))
    dealt = stash(rows.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), "ranges")
    unstash(rows)
    before, upto = (W.partitionBy("_part").orderBy(by).rowsBetween(W.unboundedPreceding, end) for end in (-1, 0))
    past = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    each = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)), *[F.sum(c).alias(c) for c in held if c[1] == "s"], *[F.max(c).alias(c) for c in held if c[1] == "m"])
    base = each.select("_p", *[(F.sum(c) if c[1] == "s" else F.max(c)).over(past).alias(f"_b{c}") for c in held])
    zero = F.lit(0).cast("long")
    out = dealt.join(F.broadcast(base), F.col("_part") == F.col("_p"))  # a row for each range
    cols = [(F.coalesce(F.sum(f"_s{i}").over(before), zero) + F.coalesce(f"_b_s{i}", zero)).alias(n) for i, n in enumerate(sums)]
    cols += [F.coalesce(F.max(f"_m{i}").over(upto), f"_b_m{i}").alias(n) for i, n in enumerate(latest)]
    done = stash(out.select(*df.columns, *cols), "ordered")
    unstash(dealt)
    return done


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, rows_per_bucket: int = ROWS_OF_A_RANGE) -> DataFrame:
    """df with a gapless rank (long, from 0) in each group, without a task that holds a whole group.

    Rows equal in all columns are counted first and dealt out again at the end. The others fall by a hash of their
    order columns into buckets of about rows_per_bucket rows; a window ranks them inside (group, bucket), and the
    bucket's first rank comes from the counts of the buckets before it. The rank follows (bucket, order columns): any
    fixed order will do where only a gapless numbering is asked for.
    """
    cols = df.columns
    once = stash(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")), "ranked")
    buckets = max(1, -(-once.count() // rows_per_bucket))
    once = once.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = once.groupBy(*group, "_b").agg(F.sum("_n").alias("_m"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0).cast("long"))).drop("_m")
    inside = W.partitionBy(*group, "_b").orderBy(*order, *[c for c in cols if c not in order])
    mine = once.withColumn("_r", F.coalesce(F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    on = [mine[c].eqNullSafe(first[c]) for c in [*group, "_b"]]
    out = mine.join(first, on, "left").select(*[mine[c] for c in cols], (F.col("_first") + F.col("_r")).alias("_at"), "_n")
    return out.select(*cols, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1)).alias(rank))


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of df with more fields, for mapInArrow."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out
