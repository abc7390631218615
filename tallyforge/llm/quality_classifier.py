"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and pairs of words, and the shapes of these (runs of capitals, small letters, digits and
other signs), hashed into a fixed number of places; each kind has length one together. The model is fitted on a bounded
hash sample of labelled rows, streamed through one task; scoring is a sparse dot product, map-only over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_column

#: Places that features are hashed into: the size of the model, whatever the corpus holds.
BITS = 18
#: Bytes of text whose features are made together.
AT_ONCE = 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ftrl:
    """sample: labelled rows (expected number) to fit on, an upper bound where more are labelled; updates: their
    number at least, so that few rows are passed over more often, within most_epochs; alpha, beta: learning rate; l1, l2: penalties."""

    sample: int = 8000
    updates: int = 20_000
    most_epochs: int = 30
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def _hashes(values: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the values of each word. word: number of each value's word; starts: first value of each."""
    place = np.arange(len(values)) - starts[word]
    powers = np.cumprod(np.full(int(place.max()) + 1, _P))
    return _mixed(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[place], starts))


_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = 1, 2, 3, 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text, places rising; a null or blank text has none. Letters beyond ASCII count as small."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    doc_of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    solid = ~_SPACE[b]
    first = solid & np.concatenate(([True], ~solid[:-1]))
    none = (np.empty(0, np.int64), np.empty(0))
    if not first.any():
        return [none] * len(texts)
    at = np.flatnonzero(solid)
    word = np.cumsum(first)[at] - 1
    starts = np.flatnonzero(first[at])
    low = np.where((b[at] >= 65) & (b[at] <= 90), b[at] + 32, b[at])
    words = _hashes(low, word, starts)
    kind = _KIND[b[at]]
    turn = first[at] | np.concatenate(([True], kind[1:] != kind[:-1]))
    shapes = _hashes(kind[turn], word[turn], np.flatnonzero(first[at][turn]))
    doc = doc_of[at[starts]]
    together = doc[1:] == doc[:-1]
    sets = []
    for salt, h in enumerate((words, shapes)):
        pairs = _mixed(h[:-1] * _P + h[1:])[together]
        for k, x in enumerate((h, pairs)):
            sets.append((_mixed(x + np.uint64(2 * salt + k + 1)), doc if k == 0 else doc[1:][together], salt))
    # A pair that came before in its text: the share of such pairs is a feature of its own.
    key = np.lexsort((sets[1][0], sets[1][1]))
    p, d = sets[1][0][key], sets[1][1][key]
    again = np.bincount(d[1:][(p[1:] == p[:-1]) & (d[1:] == d[:-1])], minlength=len(raw)) / np.maximum(np.bincount(d, minlength=len(raw)), 1) if len(p) else np.zeros(len(raw))
    parts = []
    for salt in (0, 1):
        h = np.concatenate([x for x, _, s in sets if s == salt])
        d = np.concatenate([y for _, y, s in sets if s == salt])
        flat, n = np.unique((d.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)), return_counts=True)
        owner = (flat >> np.uint64(BITS)).astype(np.int64)
        value = n / np.sqrt(np.bincount(owner, n.astype(float) ** 2, len(raw)))[owner]
        parts.append((flat, value))
    extra = np.flatnonzero(again > 0)
    parts.append(((extra.astype(np.uint64) << np.uint64(BITS)) | np.uint64(1), again[extra]))
    flat, value = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
    flat, inverse = np.unique(flat, return_inverse=True)
    value = np.bincount(inverse, value)
    owner = (flat >> np.uint64(BITS)).astype(np.int64)
    place = (flat & np.uint64((1 << BITS) - 1)).astype(np.int64)
    cut = np.searchsorted(owner, np.arange(len(raw) + 1))
    return [(place[i:j], value[i:j]) for i, j in zip(cut, cut[1:], strict=False)]


def in_blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """features() of any number of texts, a bounded number of bytes at a time."""
    some: list[str | None] = []
    size = 0
    for t in texts:
        if some and size + len(t or "") > AT_ONCE:
            yield from features(some)
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield from features(some)


class Model:
    """FTRL-proximal logistic regression; place 2**BITS is the bias."""

    def __init__(self, how: Ftrl = Ftrl()):
        self.how, self.z, self.n = how, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, h = self.z[at], self.how
        return np.where(np.abs(z) <= h.l1, 0.0, -(z - np.sign(z) * h.l1) / ((h.beta + np.sqrt(self.n[at])) / h.alpha + h.l2))

    def update(self, place: np.ndarray, value: np.ndarray, label: float) -> None:
        at, x = np.append(place, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        root = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (root - np.sqrt(self.n[at])) / self.how.alpha * w
        self.n[at] += g * g


def fit(rows: DataFrame, label: str, text: str, how: Ftrl = Ftrl()) -> np.ndarray:
    """The weights (2**BITS + 1 doubles) fitted on rows (bounded by the caller), in the order of a hash of the text."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [*in_blocks(b.column("text").to_pylist())]
            yield pa.record_batch([b.column("label"), b.column("order"), pa.array([x for x, _ in f], pa.list_(pa.int64())), pa.array([y for _, y in f], pa.list_(pa.float64()))], ["label", "order", "place", "value"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for b in batches:
            place, value = b.column("place"), b.column("value")
            cut = place.offsets.to_numpy()
            p, v = place.values.to_numpy().astype(np.int32), value.values.to_numpy().astype(np.float32)
            kept += [(y, p[i:j], v[i:j]) for y, i, j in zip(b.column("label").to_pylist(), cut, cut[1:], strict=False)]
        model = Model(how)
        for _ in range(min(how.most_epochs, -(-how.updates // max(1, len(kept))))):
            for y, p, v in kept:
                model.update(p, v, y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["at", "w"])

    chosen = rows.select(F.col(label).cast("double").alias("label"), F.xxhash64(text).alias("order"), F.col(text).alias("text"))
    ready = chosen.mapInArrow(made, "label double, order long, place array<long>, value array<double>")
    found = ready.repartition(1).sortWithinPartitions("order", "label").mapInArrow(train, "at long, w double").toPandas()
    out = np.zeros((1 << BITS) + 1)
    out[found["at"].to_numpy()] = found["w"].to_numpy()
    return out


def with_score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the chance of label 1 for its text column; a null or blank text gets what the bias alone says.
    A taken name gets underscores behind it."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for s in batches:
            margin = np.array([w[p] @ v for p, v in in_blocks(s.tolist())]) + w[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    return with_column(docs, out, score(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, text, y): about how.sample labelled rows of docs outside the held-out part.

    A doc_id labelled more than once counts by its mean, 0.5 as 1; labels other than 0 and 1 are left out. The sample
    goes by a hash of doc_id; it is broadcast if it has no more than twice the rows asked for, and is otherwise joined
    by a shuffle. Rows of one doc_id and text count once.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.where(~held_out(F.col("id")))
    rate = min(1.0, how.sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
    few = known.limit(2 * how.sample + 1).count() <= 2 * how.sample
    found = docs.select("doc_id", "text").join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id", F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"), F.first("y").alias("y")).drop("_h")


def quality_scores(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), at_least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs. Without labelled rows every score is 0.5.

    Null and empty texts get what the bias says; texts of any length are read whole; repeated rows score alike, and equal
    scores are fine: nothing is ranked. A null doc_id is carried along as held out. Other columns of docs and labels,
    whatever their names, are not read. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    weights = fit(training_rows(docs, labels, how), "y", "text", how)
    scored = with_score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))


def op10(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
