"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Rows' metadata (no texts) are a table. On each level one aggregate measures every open node's extent in each dimension;
then histograms of bytes narrow its cut, in passes over all nodes at once: first along the dimension to one value, then, among
rows that tie there, along a hash. Only histograms reach the driver: nodes x BINS rows, whatever the corpus holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, ranked, stash, unstash

#: Bins of a histogram, and the passes that narrow a cut along the hash.
BINS, TIE_PASSES = 512, 2
_TIE = 1 << 40


@dataclass(frozen=True)
class Cut:
    """Left of it: dimension (by number) below value, or equal to it with a tie hash below tie."""

    dim: int
    value: float
    tie: int


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each open node, ready to be joined to the rows by _node: as many rows as shards at most."""
    return F.broadcast(spark.createDataFrame(rows, f"_n int, {schema}"))


def _at(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of open nodes, with what their node brings and _v, their value in its dimension."""
    return rows.join(nodes, F.col("_node") == F.col("_n")).withColumn("_v", F.get("_dims", F.col("_dim")))


def _histogram(rows: DataFrame, nodes: dict[int, tuple[float, float]], value: str) -> dict[int, dict[int, tuple]]:
    """(bytes, least, greatest value) by node and bin of rows with columns _n, value. nodes: node -> (low, high); bin -1
    is below low, BINS above high."""
    bounds = _table(rows.sparkSession, [(n, lo, hi, (hi - lo) / BINS or 1.0) for n, (lo, hi) in nodes.items()], "_low double, _high double, _width double").withColumnRenamed("_n", "_k")
    v = F.col(value).cast("double")
    inner = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((v - F.col("_low")) / F.col("_width")).cast("int")))
    place = F.when(v < F.col("_low"), -1).when(v > F.col("_high"), BINS).otherwise(inner)
    found = rows.join(bounds, F.col("_n") == F.col("_k")).groupBy("_n", place.cast("int").alias("_bin")).agg(F.sum("_size"), F.min(v), F.max(v))
    out: dict[int, dict[int, tuple]] = {n: {} for n in nodes}
    for n, b, *what in found.collect():
        out[n][b] = tuple(what)
    return out


def _narrow(low: float, high: float, bins: dict[int, tuple], below: float, nearest: bool = False) -> tuple[float, float]:
    """The bounds of the bin in which `below` bytes are reached; with nearest, the bin before it as upper bound if its
    end is nearer to them."""
    width, seen = (high - low) / BINS or 1.0, bins.get(-1, (0,))[0]
    for b in range(BINS):
        more = bins.get(b, (0,))[0]
        if seen + more >= below:
            if nearest and below - seen < seen + more - below:
                return low + (b - 1) * width, low + b * width
            return low + b * width, low + (b + 1) * width
        seen += more
    return low + (BINS - 1) * width, high


def cuts(rows: DataFrame, overall: list[float], nodes: dict[int, float]) -> dict[int, Cut]:
    """A cut for each node (node -> share of its bytes that goes left) along its widest dimension.

    rows: _node, _dims (array of double), _size, _tie. Width is the standard deviation over that of all rows (overall), so
    that dimensions of any unit compare; ties go to the first. A node of equal rows is cut by the hash alone.
    """
    spark, dims = rows.sparkSession, range(len(overall))
    d = lambda i: F.col("_dims")[i]
    open_rows = rows.join(F.broadcast(spark.createDataFrame([(n,) for n in nodes], "_k int")), F.col("_node") == F.col("_k"))
    per = open_rows.groupBy("_node").agg(F.sum("_size").alias("m"), *[F.stddev_pop(d(i)).alias(f"s{i}") for i in dims], *[f(d(i)).alias(f"{n}{i}") for i in dims for n, f in (("lo", F.min), ("hi", F.max))])
    axis, bounds, want = {}, {}, {}
    for r in per.collect():
        wide = [(r[f"s{i}"] or 0) / overall[i] if overall[i] else 0.0 for i in dims]
        i = wide.index(max(wide))
        n = r["_node"]
        axis[n], bounds[n], want[n] = i, (float(r[f"lo{i}"]), float(r[f"hi{i}"])), nodes[n] * r["m"]
    if not axis:
        return {n: Cut(0, 0.0, 0) for n in nodes}
    placed = _at(rows, _table(spark, [*axis.items()], "_dim int"))
    at: dict[int, float] = {}
    left: dict[int, int] = {}
    # Bounds close in on values that rows have, however far apart they lie, until one value is left: the cut's.
    while bounds:
        found_in = _histogram(placed, bounds, "_v")
        for n, (lo, hi) in [*bounds.items()]:
            below = found_in[n].get(-1, (0, lo, lo))[0]
            for k in sorted(k for k in found_in[n] if 0 <= k < BINS):
                more, first, last = found_in[n][k]
                if below + more >= want[n]:
                    break
                below += more
            if first < last and (first, last) != (lo, hi):
                bounds[n] = (first, last)
            else:
                at[n], left[n] = last, below
                del bounds[n]
    tied = _at(rows, _table(spark, [(n, axis[n], v) for n, v in at.items()], "_dim int, _value double")).where("_v = _value")
    ties = {n: (0.0, float(_TIE)) for n in at}
    for k in range(TIE_PASSES):
        bins = _histogram(tied, ties, "_tie")
        ties = {n: _narrow(lo, hi, bins[n], want[n] - left[n], k == TIE_PASSES - 1) for n, (lo, hi) in ties.items()}
    out = {n: Cut(axis[n], at[n], int(ties[n][1] if want[n] > left[n] else 0)) for n in at}
    return {n: out.get(n, Cut(0, 0.0, 0)) for n in nodes}


def kd_tree(rows: DataFrame, dims: list[str], size: str, tie: list[str], shards: int | None = None, target_bytes: int | None = None, out: str = "shard") -> tuple[DataFrame, dict[int, Cut]]:
    """(rows with a column shard, the cut of each inner node): see kd_shards(). The root is node 1, the children of node
    n are 2n and 2n + 1; ties are parted by _tie = pmod(xxhash64(tie columns), 2**40)."""
    names = rows.columns
    spark = rows.sparkSession
    sizes = F.sum(F.col(size).cast("long"))
    least = rows.agg(*[F.min(F.col(d).cast("double")) for d in dims], sizes).first()
    if shards is None:
        shards = max(1, -(-(least[-1] or 0) // max(1, target_bytes or 1)))
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]
    axes = F.array(*[F.coalesce(F.col(d).cast("double"), F.lit(least[i] or 0.0)) for i, d in enumerate(dims)])
    plain = rows.select(*own, axes.alias("_dims"), F.col(size).cast("long").alias("_size"), F.pmod(F.xxhash64(*tie), F.lit(_TIE)).alias("_tie"), F.lit(1).alias("_node"))
    overall = [x or 0.0 for x in plain.agg(*[F.stddev_pop(F.col("_dims")[i]) for i in range(len(dims))]).first()]
    written_at = None
    made: dict[int, Cut] = {}
    leaves = {1: (0, shards)}  # node -> its shards, from and to
    while any(b - a > 1 for a, b in leaves.values()):
        shares = {n: math.ceil((b - a) / 2) / (b - a) for n, (a, b) in leaves.items() if b - a > 1}
        found = cuts(plain, overall, shares)
        made |= found
        cut = F.broadcast(spark.createDataFrame([(n, c.dim, c.value, c.tie) for n, c in found.items()], "_n int, _dim int, _value double, _limit long"))
        v = F.get("_dims", F.col("_dim"))
        left = (v < F.col("_value")) | ((v == F.col("_value")) & (F.col("_tie") < F.col("_limit")))
        child = F.when(F.col("_n").isNull(), F.col("_node")).when(left, F.col("_node") * 2).otherwise(F.col("_node") * 2 + 1)
        plain = plain.join(cut, F.col("_node") == F.col("_n"), "left").withColumn("_node", child.cast("int")).drop("_n", "_dim", "_value", "_limit")
        plain, before = stash(plain, "nodes"), written_at
        unstash(before)
        written_at = plain
        grown = {}
        for n, (a, b) in leaves.items():
            if n in found:
                middle = a + math.ceil((b - a) / 2)
                grown |= {2 * n: (a, middle), 2 * n + 1: (middle, b)}
            else:
                grown[n] = (a, b)
        leaves = grown
    number = F.broadcast(spark.createDataFrame([(n, a) for n, (a, _) in leaves.items()], "_n int, _shard int"))
    done = plain.join(number, F.col("_node") == F.col("_n"))
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_shard").alias(free_name(names, out))), made


def kd_shards(rows: DataFrame, dims: list[str], size: str, tie: list[str], shards: int | None = None, target_bytes: int | None = None, out: str = "shard") -> DataFrame:
    """rows with an int column shard: leaves of nearly equal sums of size, so many as shards says, or so many that a leaf
    has about target_bytes at most.

    dims: numeric columns; a null counts as the least value of all. Rows that tie in a dimension are parted by a hash of
    the tie columns, so equal values, however many, can be split; rows equal in those too stay together. All columns are
    carried along; where one is named as out is, out gets underscores behind it. An empty table gives an empty one.
    """
    return kd_tree(rows, dims, size, tie, shards, target_bytes, out)[0]


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text, lang, source), in so many shards, or
    in so many that each has about target_bytes at most.

    size is the text's UTF-8 bytes plus 1 (null text: 1, and checksum 0 as of an empty text). The dimensions are the
    length on a log scale, doc_id, and numbers for language and source. slot numbers the rows of a shard from 0, by
    buckets of a hash. Null columns, repeated rows, very long texts and an empty table give rows, or none, like any
    others; other columns, whatever their names, are not read.
    """
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("double")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), number("lang").alias("m_lang"), number("source").alias("m_source"))
    rows = stash(rows.withColumn("m_log", F.log(F.col("size").cast("double"))), "metadata")
    parted = kd_shards(rows, ["m_log", "doc_id", "m_lang", "m_source"], "size", ["doc_id", "text_crc32", "size"], shards if target_bytes is None else None, target_bytes)
    return ranked(parted.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op9(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_law(spark, sf_dir: str) -> DataFrame:
    """One row: what the law and the numbering promise of op9's whole result."""
    out = op9(spark, sf_dir)
    per = out.groupBy("shard").agg(F.sum("size").alias("m"), F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("k"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.max("size").alias("most"))
    even = (F.max("m") - F.min("m") <= 4 * F.max("most")).alias("even")
    return per.agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("documents"), F.sum("m").alias("bytes"), F.expr("bool_and(n = k AND lo = 0 AND hi = n - 1)").alias("gapless"), even)


SHARD_LAW_SQL = "SELECT 8::BIGINT AS shards, count(*) AS documents, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, true AS gapless, true AS even FROM documents"
