"""Merkle fixity audit of WARC replicas.

A replica's records stand in order of key (null first) and digest, one behind the other, and each has an offset. A hash
of a record says whether a leaf begins at it, and whether nodes of higher levels do; so a node covers a range of ordered
offsets, and a replica's tree follows from its records alone, while damage moves no boundary but those it hits. Two
replicas whose roots agree hold the same bytes; otherwise the audit descends, level by level, only below nodes that
differ, and compares single records in the leaves it ends in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, stash

#: Bits of a record's hash that are zero where a leaf begins (64 records on average), and further bits for each level
#: above (16 nodes on average).
LEAF_BITS, BITS = 6, 4


def warc_record(url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record, as bytes; null url or payload: empty."""
    body = F.coalesce(payload, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, body, F.lit("\r\n\r\n")).cast("binary")


@dataclass(frozen=True)
class Tree:
    """records: key, digest, length, copies, place (what they are ordered by), offset, node (that of its leaf). levels:
    leaves first, root last, each (node, up, hash, bytes, records); a node goes by the place of its first record, "" for
    the first of all, up is the node above."""

    records: DataFrame
    levels: list[DataFrame]

    def root(self) -> str | None:
        """The hash of everything; null without a record."""
        row = self.levels[-1].select("hash").first()
        return row[0] if row else None


def _place(key: Column, digest: Column) -> Column:
    """A text that sorts as (key, digest), null keys first. The upper half of the key's digits starts from the sign."""
    flipped = key.bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.coalesce(F.lower(F.lpad(F.hex(flipped), 16, "0")), F.lit("-")), F.lit(" "), digest)


def replica_records(replica: DataFrame, key: str, record: Column) -> DataFrame:
    """(key, digest, length, copies): equal records of one key are counted, so that repeats don't crowd a leaf."""
    rows = replica.select(F.col(key).cast("long").alias("key"), record.alias("r"))
    rows = rows.select("key", F.sha2("r", 256).alias("digest"), F.octet_length("r").cast("long").alias("length"))
    return stash(rows.groupBy("key", "digest", "length").agg(F.count(F.lit(1)).alias("copies")), "records")


def levels_for(records: int) -> int:
    """Levels above the leaves for about so many records."""
    levels = 1
    while records >> (LEAF_BITS + BITS * levels) > 1:
        levels += 1
    return levels


def merkle_tree(records: DataFrame, levels: int) -> Tree:
    """The tree of one replica. Replicas that are to be compared need the same number of levels; nothing else of them is
    shared. One key with very many records is cut like any other run of records."""
    place = _place(F.col("key"), F.col("digest"))
    begins = lambda k: F.when(F.xxhash64("place").bitwiseAND(F.lit((1 << (LEAF_BITS + BITS * k)) - 1)) == 0, F.col("place"))
    names = [f"n{k}" for k in range(levels)]
    size = F.col("length") * F.col("copies")
    rows = in_order(records.withColumn("place", place), "place", {"offset": size}, {n: begins(k) for k, n in enumerate(names)})
    rows = rows.withColumns({n: F.coalesce(n, F.lit("")) for n in names}).withColumn(f"n{levels}", F.lit(""))
    entry = F.struct("place", "copies")
    text = lambda e: F.concat_ws(" ", e["place"], e["copies"].cast("string"))
    leaf = F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(entry)), text)), 256)
    above = [F.first(n).alias(n) for n in [*names[1:], f"n{levels}"]]
    now = stash(rows.groupBy("n0").agg(leaf.alias("hash"), F.sum(size).alias("bytes"), F.sum("copies").alias("records"), *above), "merkle")
    out = []
    for k in range(levels + 1):
        up = F.col(f"n{k + 1}") if k < levels else F.lit(None).cast("string")
        out.append(now.select(F.col(f"n{k}").alias("node"), up.alias("up"), "hash", "bytes", "records"))
        if k < levels:
            child = F.struct(f"n{k}", "hash")
            joined = F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(" ", c[f"n{k}"], c["hash"]))), 256)  # noqa: B023
            rest = [F.first(f"n{j}").alias(f"n{j}") for j in range(k + 2, levels + 1)]
            now = stash(now.groupBy(f"n{k + 1}").agg(joined.alias("hash"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"), *rest), "merkle")
    return Tree(rows.select("key", "digest", "length", "copies", "place", "offset", F.col("n0").alias("node")), out)


def compared_nodes(one: Tree, other: Tree) -> list[DataFrame]:
    """(node, differs) of the nodes that the descent compares, leaves first: the roots, and the children of nodes that
    differ. Where the roots agree, no level below them is read."""
    out: list[DataFrame] = []
    found = None
    for a, b in zip(reversed(one.levels), reversed(other.levels), strict=True):
        if found is not None:
            a, b = (x.join(found.withColumnRenamed("node", "_up"), F.col("up") == F.col("_up"), "left_semi") for x in (a, b))
        sides = [x.select("node", F.col("hash").alias(f"hash_{i}")) for i, x in enumerate((a, b))]
        out.append(stash(sides[0].join(sides[1], "node", "full").select("node", (~F.col("hash_0").eqNullSafe(F.col("hash_1"))).alias("differs")), "compared"))
        found = out[-1].where("differs").select("node")
        if len(out) == 1 and not found.head(1):
            break
    return out[::-1]


def fixity_audit(original: DataFrame, replica: DataFrame, key: str, record: Column) -> DataFrame:
    """(key, offset, length, digest, copies, leaf, found_digest, status) for every record of original, and for those
    that only the replica has.

    status: intact (its leaf's hashes agree, or the record is there), corrupt (the key is there with other bytes),
    missing, or extra (offset null). Records stand in order of key (any long, null first) and digest; equal records of
    one key are one row with their number of copies; a copy too few or too many makes a record corrupt. Null and empty
    urls or payloads are records like others, and so are very long ones. Other columns, whatever their names, are not
    read. Empty tables give no rows of their side.
    """
    rows = [replica_records(x, key, record) for x in (original, replica)]
    levels = levels_for(max(x.count() for x in rows))
    one, other = (merkle_tree(x, levels) for x in rows)
    bad = compared_nodes(one, other)[0].where("differs").select(F.col("node").alias("_n"))
    none = F.lit(None).cast("string")
    out = ["key", "offset", "length", "digest", "copies", "leaf", "found_digest", "status"]
    a, b = (x.records.withColumnRenamed("node", "leaf") for x in (one, other))
    fine = a.join(bad, F.col("leaf") == F.col("_n"), "left_anti").withColumns({"found_digest": none, "status": F.lit("intact")}).select(*out)
    mine, theirs = (x.join(bad, F.col("leaf") == F.col("_n"), "left_semi") for x in (a, b))
    theirs = theirs.select(*[F.col(c).alias(f"b_{c}") for c in ("key", "digest", "length", "copies", "place", "leaf")])
    same = stash(mine.join(theirs, (F.col("place") == F.col("b_place")) & (F.col("copies") == F.col("b_copies")), "full"), "matched")
    whole = same.where("digest is not null and b_digest is not null").withColumns({"found_digest": none, "status": F.lit("intact")}).select(*out)
    # What is left of a key on both sides is paired by the order of the digests.
    left = _rank_in_key(same.where("b_digest is null").select("key", "digest", "length", "copies", "place", "leaf", "offset"))
    right = _rank_in_key(same.where("digest is null").select(*[F.col(f"b_{c}").alias(c) for c in ("key", "digest", "length", "copies", "place", "leaf")]))
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in ("key", "digest", "length", "copies", "leaf", "k")])
    odd = left.join(right, F.col("key").eqNullSafe(F.col("b_key")) & (F.col("k") == F.col("b_k")), "full")
    extra = F.col("digest").isNull()
    odd = odd.select(
        F.when(extra, F.col("b_key")).otherwise(F.col("key")).alias("key"), "offset", *[F.coalesce(c, f"b_{c}").alias(c) for c in ("length", "digest", "copies", "leaf")],
        F.when(~extra, F.col("b_digest")).alias("found_digest"), F.when(F.col("b_digest").isNull(), "missing").when(extra, "extra").otherwise("corrupt").alias("status"),
    )
    return fine.union(whole).union(odd)


def _rank_in_key(rows: DataFrame) -> DataFrame:
    """rows with k, their number within their key in order of place, without a task that holds a whole key."""
    placed = in_order(rows, "place", {"_at": F.lit(1).cast("long")})
    first = placed.groupBy("key").agg(F.min("_at").alias("_first")).withColumnRenamed("key", "_key")
    return placed.join(first, F.col("key").eqNullSafe(F.col("_key"))).withColumn("k", F.col("_at") - F.col("_first")).drop("_at", "_first", "_key")


#: Damage that the query's replica holds, in a few stretches of records: page_id modulo STRETCH from and to.
STRETCH, ALTERED, LOST, ADDED = 2048, (40, 43), (90, 91), (130, 130)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with altered, lost and added records, for an audit to find; every other record is the same."""
    at = lambda how: F.coalesce(F.pmod("page_id", F.lit(STRETCH)).between(*how), F.lit(False))
    kept = pages.where(~at(LOST)).withColumn("html", F.when(at(ALTERED), F.concat(F.lit("~"), F.col("html"))).otherwise(F.col("html")))
    return kept.union(pages.where(at(ADDED)).withColumn("page_id", -1 - F.col("page_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = fixity_audit(pages, damaged(pages), "page_id", warc_record(F.col("url"), F.col("html")))
    return out.select(F.col("key").alias("page_id"), "offset", "length", "digest", "copies", "found_digest", "status")


_ALTERED, _LOST, _ADDED = (f"page_id % {STRETCH} BETWEEN {a} AND {b}" for a, b in (ALTERED, LOST, ADDED))
OP3_SQL = rf"""
WITH rec AS (
  SELECT page_id, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head
  FROM pages),
a AS (
  SELECT page_id, head || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM rec),
b AS (
  SELECT page_id, head || strlen('~' || html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || '~' || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM rec WHERE {_ALTERED}),
placed AS (
  SELECT page_id, CAST(coalesce(sum(strlen(r)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS digest
  FROM a)
SELECT page_id, "offset", length, digest, CAST(1 AS BIGINT) AS copies,
  CASE WHEN {_LOST} THEN NULL WHEN {_ALTERED} THEN (SELECT sha256(b.r) FROM b WHERE b.page_id = placed.page_id) END AS found_digest,
  CASE WHEN {_LOST} THEN 'missing' WHEN {_ALTERED} THEN 'corrupt' ELSE 'intact' END AS status
FROM placed
UNION ALL
SELECT -1 - page_id, NULL, CAST(strlen(r) AS BIGINT), sha256(r), CAST(1 AS BIGINT), NULL, 'extra' FROM a WHERE {_ADDED}
"""
