"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2 bits exactly if some value lies within 1 bit of both. So every distinct fingerprint
emits all values within half the radius (itself and 64 others), and a shuffle on those values brings linked ones
together. Around one value lie at most 65 fingerprints, so a bucket is bounded whatever the corpus holds; copies of a
document share a fingerprint and are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, hex64, small_batches, stash, with_column
from .components import connected_components

#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints link at this many differing bits or fewer; each emits what lies within half.
RADIUS = 2
_LANES = np.uint64(0x0101010101010101)
#: Bits of a long SimHash, and the weights of a shingle's places in it: unlike, so that small sets rarely tie.
BITS = 8192
_WEIGHTS = np.array([1.0, 0.83, 0.71, 0.59])
_SIDE = 64
#: Sums of which decided() keeps one, and the rounds of BITS sums that it draws.
GROUP, ROUNDS = 256, 8


def _hadamard(n: int) -> np.ndarray:
    at = np.arange(n)
    return 1 - 2 * (np.bitwise_count(at[:, None] & at) & 1).astype(np.float32)


_LEFT, _RIGHT = _hadamard(_SIDE), _hadamard(BITS // _SIDE)
_SIGNS = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (ROUNDS, BITS)) / np.sqrt(np.float32(BITS))


def _turned(at: np.ndarray) -> np.ndarray:
    return (_LEFT @ at.reshape(_SIDE, -1) @ _RIGHT).ravel()


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included, in order. bytes.lower() changes A-Z alone, and bytes.split()
    cuts at ASCII white space alone."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64)


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text as a signed 64-bit number; zero if a text has no word.

    Bits are counted in byte lanes of 64-bit numbers, for 255 shingles at a time so that no lane overflows.
    """
    hashes = [shingle_hashes(t, shingle) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out.view(np.int64)
    flat, sizes = np.concatenate([hashes[i] for i in full]), n[full]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parts = -(-sizes // 255)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (counts[:, byte] * 2 > sizes).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out.view(np.int64)


def long_sums(shingles: np.ndarray) -> np.ndarray:
    """The BITS sums of a long SimHash, each of what every shingle of a set of shingle hashes draws for it. Each shingle
    puts signed weights at four places that its hash chooses, and a Hadamard transform draws all sums from them at once,
    in a time that hardly depends on the length of the text."""
    at = np.zeros(BITS)
    for k, weight in enumerate(_WEIGHTS.tolist()):
        x = (shingles ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        sign = (x >> np.uint64(40) & np.uint64(1)).astype(np.float64) * (2 * weight) - weight
        at += np.bincount((x >> np.uint64(51)).astype(np.int64), sign, BITS)
    return _turned(at.astype(np.float32))


def long_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes in BITS booleans: a bit is the sign of its sum."""
    return long_sums(shingles) > 0


def decided(shingles: np.ndarray) -> np.ndarray:
    """The most decided bits of a SimHash of ROUNDS * BITS further sums: of each GROUP sums twice the place of the one
    furthest from zero, plus 1 if it is above. Few shared shingles can be lost before such a bit changes: two equal-sized
    sets of similarity 0.8 agree in one with a chance of 0.39, unlike sets with one of 1 in 2 * GROUP."""
    sums, out = long_sums(shingles), []
    for signs in _SIGNS:  # each round turns the sums before it anew
        sums = _turned(sums * signs)
        held = sums.reshape(-1, GROUP)
        far = np.abs(held).argmax(axis=1)
        out.append(2 * far + (held[np.arange(len(far)), far] > 0))
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with the SimHash of its text column; a null text counts as empty. A taken name gets underscores behind it."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series(np.concatenate([fingerprints(texts[i : i + 256], shingle) for i in range(0, len(texts), 256)] or [np.empty(0, np.int64)]))

    return with_column(docs, out, simhash(F.col(text)))


def fingerprint_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b) with a > b: verified links that connect every two fingerprints within RADIUS bits.

    Each bucket links its members to its least one; all members of a bucket are within the radius of each other, so no
    connection is lost and no bucket emits all its pairs. The fingerprints are dealt out before they emit: their table
    may have few files.
    """
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), fp)
    masks = F.array(F.lit(0).cast("long"), *[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in (1 << i for i in range(64))])
    balls = distinct.select(F.col(fp).alias("f"), F.explode(F.transform(masks, lambda m: F.col(fp).bitwiseXOR(m))).alias("v"))
    buckets = balls.groupBy("v").agg(F.collect_list("f").alias("m")).where(F.size("m") > 1)
    stars = buckets.select(F.array_min("m").alias("b"), F.explode("m").alias("a")).where("a <> b").distinct()
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")


def class_components(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of rows (doc_id, fp). classes: fp and its least doc_id; links: of fps."""
    found = stash(connected_components(links), "found")
    roots = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select(F.col("fp").alias("f"), "component_id")
    return rows.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least doc_id that links reach.

    Texts without a word have fingerprint zero and are linked like others. Rows with one doc_id count each by their own
    text; repeated rows give repeated rows; very long texts are read whole. A null doc_id is carried along; it is never a
    component_id unless no row of the component has another. Other columns, whatever their names, are not read. An empty
    table gives an empty result.
    """
    rows = stash(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", shingle=shingle).drop("_text"), "fps")
    classes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    return class_components(rows, classes, fingerprint_links(classes))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs (documents' columns) whose doc_id is its component's least: one document of each group stays.

    A repeated row (same doc_id) stays as often as it came; a null doc_id stays only if nothing else is in its group.
    """
    name = free_name(docs.columns, "_id")
    kept = simhash_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def op5(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
