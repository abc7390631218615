"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces fall into groups of bounded size by a hash; each group is packed best-fit
decreasing, and a piece that fits no open bin opens the bin size of least cost for each token that is left to fill it.
The packing is tried with every longest permitted length, the cheapest is taken, and finally every bin shrinks to the
least permitted length that holds its contents. A group loses at most a few part-filled bins, so packing groups apart
costs next to nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import with_token_count, with_tokens
from .common import stash

OUT = "doc_id long, text_hash long, copy long, piece int, first_token long, n_tokens int, bin_id string, bin_capacity int, bin_used int, bin_offset int"


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths (tokens), the cost of a bin beside its tokens, and pieces that are packed together."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096)
    per_bin: int = 32
    group: int = 20_000

    def cost(self, capacity: int) -> int:
        return capacity + self.per_bin


def best_fit(sizes: list[int], capacities: tuple[int, ...], lengths: Lengths) -> list[list[int]]:
    """Bins, each a list of places in sizes; sizes must be sorted downward and fit the largest of capacities.

    An open bin with least room that fits takes a piece; of those with equal room, the one opened first.
    """
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    left = sum(sizes)
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room = min((c for c in capacities if c >= size), key=lambda c: (lengths.cost(c) / min(c, left), c))
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            insort(rooms, (room - size, b))
        left -= size
    return bins


def pack(sizes: list[int], lengths: Lengths = Lengths()) -> list[tuple[int, list[int]]]:
    """(capacity, places in sizes) of each bin, by the cheapest of the packings tried; sizes must be sorted downward."""
    permitted = tuple(sorted(lengths.permitted))
    best: tuple | None = None
    for n in range(1, len(permitted) + 1):
        if sizes and permitted[n - 1] < sizes[0]:
            continue
        bins = best_fit(sizes, permitted[:n], lengths)
        sized = [(next(c for c in permitted if c >= sum(sizes[i] for i in b)), b) for b in bins]
        total = sum(lengths.cost(c) for c, _ in sized)
        if best is None or total < best[0]:
            best = total, sized
    return best[1] if best else []


def pieces(docs: DataFrame, n_tokens: Column, text_hash: Column, lengths: Lengths) -> DataFrame:
    """(doc_id, text_hash, copy, piece, first_token, n_tokens): documents cut at the largest permitted length, repeated
    rows numbered by copy. Rows are counted by (doc_id, text_hash, tokens) first, so that repeats don't meet in one task."""
    most = max(lengths.permitted)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), n_tokens.cast("long").alias("n")).where("n > 0")
    counted = counted.groupBy("doc_id", "text_hash", "n").count()
    copies = counted.select("doc_id", "text_hash", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy"))
    cut = copies.select("doc_id", "text_hash", "copy", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("piece", "first_token"))
    return cut.select("doc_id", "text_hash", "copy", "piece", "first_token", F.least(F.lit(most), F.col("n") - F.col("first_token")).cast("int").alias("n_tokens"))


def best_fit_packing(docs: DataFrame, n_tokens: Column, text_hash: Column | None = None, lengths: Lengths = Lengths()) -> DataFrame:
    """A row for each piece of each document, with its bin: see OUT. bin_offset is where the piece starts in its bin.

    Rows of docs need doc_id (null is carried along); n_tokens gives their length: rows of null or no tokens go into no
    bin and have no row. text_hash (null if not given) tells texts of one doc_id apart. Documents of any length are cut
    at the largest permitted one; full pieces are bins by themselves. Repeated rows are packed each. Equal lengths are
    packed in order of doc_id, text_hash, copy, piece; the result depends on the rows alone, not on their partitions.
    Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    cut = stash(pieces(docs, n_tokens, F.lit(None).cast("long") if text_hash is None else text_hash, lengths), "pieces")
    groups = max(1, -(-cut.count() // lengths.group))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(groups)).cast("int"))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "text_hash", "copy", "piece"], ascending=[False, True, True, True, True], ignore_index=True)
        sizes = pdf["n_tokens"].tolist()
        rows = []
        for b, (capacity, places) in enumerate(pack(sizes, lengths)):
            used, offset = sum(sizes[i] for i in places), 0
            for i in places:
                rows.append((i, f"{key[0]}-{b}", capacity, used, offset))
                offset += sizes[i]
        more = pd.DataFrame(rows, columns=["i", "bin_id", "bin_capacity", "bin_used", "bin_offset"]).set_index("i")
        return pdf.join(more)[[c.split()[0] for c in OUT.split(", ")]]

    return cut.groupBy("g").applyInPandas(packed, OUT)


def pack_texts(docs: DataFrame, path: str, lengths: Lengths = Lengths()) -> DataFrame:
    """The packing of docs (doc_id, text) by the BPE tokens of the tokenizer file at path: see best_fit_packing()."""
    counted = with_token_count(docs.select("doc_id", "text"), path, out="n_tokens")
    return best_fit_packing(counted, F.col("n_tokens"), F.xxhash64("text"), lengths)


def packed_sequences(docs: DataFrame, path: str, lengths: Lengths = Lengths()) -> DataFrame:
    """(bin_id, capacity, tokens: array of int, starts: array of (doc_id, offset)): the training sequences themselves,
    for the docs (doc_id, text) packed by pack_texts(). tokens are not padded to the capacity."""
    ids = with_tokens(docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"), "text"), path, out="ids").select("_d", "_h", "ids")
    ids = ids.dropDuplicates(["_d", "_h"])
    placed = stash(pack_texts(docs, path, lengths), "placed")
    here = placed.join(ids, placed["doc_id"].eqNullSafe(ids["_d"]) & (placed["text_hash"] == ids["_h"]))
    part = F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens"))
    bins = here.groupBy("bin_id").agg(F.first("bin_capacity").alias("capacity"), F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", part.alias("ids")))).alias("p"))
    return bins.select("bin_id", "capacity", F.flatten("p.ids").alias("tokens"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["bin_offset"].alias("offset"))).alias("starts"))


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
