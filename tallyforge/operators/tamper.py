"""Edited images: block features of files, a boosted-tree model of blocks, a score for each image."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images

_MAPS = ["gray_std", "gray_mean", *[f"{m}_{s}" for m in ("ela75", "ela90", "ela95", "noise", "edge") for s in ("mean", "std", "max")]]
FEATURES = [f"{m}{form}" for m in _MAPS for form in ("", "_rel", "_nb")] + ["ink_share"]


def assessments(files: DataFrame) -> DataFrame:
    """(path, quality, reason) of binary files: JPEG quality, and why a file cannot be judged."""

    @F.pandas_udf("quality int, reason string")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(images.jpeg_quality(bytes(b)), images.cannot_assess(bytes(b))) for b in content], columns=["quality", "reason"]).astype({"quality": "Int64"})

    return files.select("path", read("content").alias("r")).select("path", "r.*")


def blocks(files: DataFrame) -> DataFrame:
    """(path, by, bx, FEATURES) of the inked blocks of image files. Needs an image library on the executors."""
    schema = "path string, by int, bx int, " + ", ".join(f"{f} double" for f in FEATURES)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = images.block_features(*images.decode(bytes(data)))
                if rows:
                    yield pd.DataFrame(rows).assign(path=path)[["path", "by", "bx", *FEATURES]]

    return files.select("path", "content").mapInPandas(each, schema)


def edited(block_rows: DataFrame, regions: DataFrame) -> DataFrame:
    """block_rows with label 1 where a block touches a region (path, x, y, width, height) of its image, else 0."""
    r = regions.select(F.col("path").alias("_p"), *[F.floor(F.col(a) / images.BLOCK).alias(f"_{a}0") for a in ("x", "y")], *[F.floor((F.col(a) + F.col(s)) / images.BLOCK).alias(f"_{a}1") for a, s in (("x", "width"), ("y", "height"))])
    touched = block_rows.select("path", "by", "bx").join(r, (F.col("path") == F.col("_p")) & F.col("bx").between(F.col("_x0"), F.col("_x1")) & F.col("by").between(F.col("_y0"), F.col("_y1")))
    touched = touched.select("path", "by", "bx").distinct().withColumn("label", F.lit(1.0))
    return block_rows.join(touched, ["path", "by", "bx"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def by_image(scored: DataFrame, probability: Column) -> DataFrame:
    """(path, score, by, bx): each image's most suspicious block."""
    return scored.groupBy("path").agg(F.max_by(F.struct(probability.alias("score"), "by", "bx"), F.struct(probability, -F.col("by"), -F.col("bx"))).alias("t")).select("path", "t.*")


def best_threshold(scores: DataFrame) -> float:
    """The score from which flagging gives the best F1; scores: score, label, a row for each image."""
    counted = scores.groupBy("score").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).toPandas()
    hits, n = counted["hits"].cumsum(), counted["n"].cumsum()
    f1 = 2 * hits / (n + counted["hits"].sum())
    return float(counted["score"][f1.idxmax()])


def image_scores(files: DataFrame, model, thresholds: dict[str, float]) -> DataFrame:
    """(path, format, score, suspicious, x, y, width, height, reason): what the model says of image files (path, content).

    thresholds: "jpeg" and "scan", the score from which a file of that format is suspicious. The box is the most
    suspicious block. reason says why there is no score: a JPEG file too strongly compressed, or no ink.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    told = assessments(files)
    fit = files.join(told.where("reason is null").select("path"), "path", "left_semi")
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(blocks(fit)))
    return image_verdicts(told, by_image(scored, vector_to_array("probability")[1]), thresholds)


def image_verdicts(told: DataFrame, scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """assessments() and by_image() as the result of image_scores()."""
    rows = told.join(scores, "path", "left").withColumn("format", F.when(F.col("quality").isNull(), "scan").otherwise("jpeg"))
    limit = F.when(F.col("format") == "jpeg", F.lit(thresholds["jpeg"])).otherwise(F.lit(thresholds["scan"]))
    has = F.col("score").isNotNull()
    corner = lambda c: F.when(has, F.col(c) * images.BLOCK)
    side = F.when(has, F.lit(images.BLOCK))
    reason = F.coalesce("reason", F.when(~has, "not checked: the image holds no ink"))
    return rows.select("path", "format", "score", F.when(has, F.col("score") >= limit).alias("suspicious"), corner("bx").alias("x"), corner("by").alias("y"), side.alias("width"), side.alias("height"), reason.alias("reason"))


def report(scores: DataFrame, threshold: float) -> DataFrame:
    """One row over images (score, label): images, edited, roc_auc, precision, recall, f1 at the threshold.

    The area under the curve counts, for each edited image, the others of a lower score, equal ones by half; only counts
    by score are put in order. Where there is nothing to divide, a measure is 0.
    """
    counted = scores.groupBy("score").agg(F.sum("label").cast("double").alias("bad"), F.sum(1 - F.col("label")).cast("double").alias("good"))
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("under", F.coalesce(F.sum("good").over(below), F.lit(0.0)))
    at = F.col("score") >= threshold
    sums = ranked.agg(F.sum(F.col("bad") + F.col("good")).cast("long").alias("images"), F.sum("bad").alias("b"), F.sum("good").alias("g"), F.sum(F.col("bad") * (F.col("under") + F.col("good") / 2)).alias("won"), F.sum(F.when(at, F.col("bad"))).alias("hits"), F.sum(F.when(at, F.col("bad") + F.col("good"))).alias("flagged"))
    part = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    return sums.select("images", F.col("b").cast("long").alias("edited"), part("won", F.col("b") * F.col("g")).alias("roc_auc"), part("hits", "flagged").alias("precision"), part("hits", "b").alias("recall"), part(2 * F.col("hits"), F.col("flagged") + F.col("b")).alias("f1"))


def folds_of(labelled: DataFrame, folds: int) -> DataFrame:
    """(path, fold): all blocks of an image in one fold, and as many edited images in each as can be: images of each kind
    are dealt out in the order of a hash."""
    kinds = labelled.groupBy("path").agg(F.max("label").alias("_kind"))
    return kinds.select("path", F.pmod(F.row_number().over(Window.partitionBy("_kind").orderBy(F.xxhash64("path"), "path")) - 1, F.lit(folds)).alias("fold"))


def train(labelled: DataFrame, folds: int = 5, **params):
    """(model, threshold): boosted trees over FEATURES, classes balanced by weight; the threshold has the best F1 on
    images scored by models that have not seen them (all blocks of an image are in one fold)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    share = labelled.agg(F.avg("label")).first()[0] or 0.5
    rows = labelled.withColumns({"weight": F.when(F.col("label") > 0, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)), }).join(folds_of(labelled, folds), "path")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).persist()
    trees = GBTClassifier(labelCol="label", weightCol="weight", seed=7, **params)
    held = None
    for k in range(folds):
        part = rows.where(F.col("fold") == k)
        if part.head(1):
            scored = trees.fit(rows.where(F.col("fold") != k)).transform(part)
            scored = scored.groupBy("path").agg(F.max(vector_to_array("probability")[1]).alias("score"), F.max("label").alias("label"))
            held = scored if held is None else held.union(scored)
    model, threshold = trees.fit(rows), best_threshold(held)
    rows.unpersist()
    return model, threshold


def save(model, threshold: float, path: str) -> None:
    model.write().overwrite().save(path + "/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"threshold": threshold, "features": FEATURES}),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")


def load(spark, path: str):
    """(model, threshold), or None if nothing usable is there."""
    from pyspark.ml.classification import GBTClassificationModel

    try:
        meta = json.loads(spark.read.text(path + "/meta").first()[0])
        return GBTClassificationModel.load(path + "/model"), meta["threshold"]
    except Exception:  # a missing model is an expected state: images then go unscored
        return None
