"""Scores of pictures from embeddings: prompt banks, linear probes, their training and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp, r4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def zero_shot(vector: Column, harm_bank: Column, safe_bank: Column) -> Column:
    """The best harmful prompt against the best harmless one, scaled to 0..1."""
    best = lambda bank: F.array_max(F.transform(bank, lambda b: dot(vector, b)))
    return r4(clamp((best(harm_bank) - best(safe_bank) + 0.15) / 0.45))


def probe(vector: Column, coef: Column, intercept: Column, multimodal: Column | None = None, has_text: Column | None = None) -> Column:
    """Struct of score and calibrated. Another dimension gives 0, uncalibrated; a probe that needs text abstains without any: 0,
    as calibrated as before."""
    z = dot(vector, coef) + intercept
    p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    fits = F.size(vector) == F.size(coef)
    abstains = F.lit(False) if multimodal is None or has_text is None else multimodal & ~has_text
    return F.struct(F.when(fits & ~abstains, r4(p)).otherwise(0.0).alias("score"), (fits | abstains).alias("calibrated"))


def admitted(models: DataFrame, enabled: bool = True) -> DataFrame:
    """Probes that may score: switched on, above the bar, with coefficients."""
    return models.where(F.lit(enabled) & F.col("meets_bar") & (F.size("coef") > 0))


def branch(has_picture: Column, has_probe: Column, has_text: Column, multimodal: Column) -> Column:
    """Which reading a picture gets, and the note on it."""
    kind = F.when(~has_picture, "none").when(has_probe & (~multimodal | has_text), "probe").when(has_probe, "abstain").otherwise("zero_shot")
    note = F.when(kind == "none", "no_picture_region").when(kind == "abstain", "probe_needs_text").when(kind == "zero_shot", "vision_uncalibrated")
    return F.struct(kind.alias("kind"), note.alias("note"))


def auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """One row: area under the curve with ties at their mean rank, accuracy at 0.5, and the spread of scores.

    Scores are counted by value first; cumulative counts over values run within ranges of the score and over the ranges.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(target)).alias("p"), F.count_if(~F.col(target)).alias("n"), F.count("*").alias("m"))
    counts = counts.withColumn("part", F.floor(F.col("s") * 256))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.groupBy("part").agg(F.sum("n").alias("all_n"))
    parts = parts.select("part", F.coalesce(F.sum("all_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part")
    wins = F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2))
    right = F.sum(F.when(F.col("s") >= 0.5, F.col("p")).otherwise(F.col("n")))
    p, n = F.sum("p"), F.sum("n")
    return both.agg(r4(F.when((p == 0) | (n == 0), 0.5).otherwise(wins / (p * n))).alias("auc"), r4(right / F.sum("m")).alias("accuracy"), (F.max("s") - F.min("s")).alias("spread"), F.sum("m").alias("rows"))


def paired(images: DataFrame, captions: DataFrame, key: str, dim: int) -> DataFrame:
    """Image and caption vectors of each row; a missing caption is a zero vector, an unreadable image goes."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    both = images.where(F.col("image").isNotNull()).join(captions, key, "left")
    return both.select(key, "image", F.coalesce("caption", zero).alias("caption"), F.concat("image", F.coalesce("caption", zero)).alias("both"))


def train_probe(df: DataFrame, vector: str, target: str, bar: float = 0.65, iterations: int = 200, judged_on: DataFrame | None = None) -> DataFrame:
    """(kind, dim, coef, intercept, auc, accuracy, train_rows, meets_bar): class-balanced logistic regression, judged on the
    rows of ``judged_on``, else on its own."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = lambda some: some.select(array_to_vector(F.col(vector)).alias("features"), F.col(target).cast("double").alias("y"), F.col(target).alias("t"))
    n, positive = df.agg(F.count("*"), F.count_if(F.col(target))).first()
    own = rows(df).withColumn("w", F.when(F.col("t"), n / (2.0 * max(1, positive))).otherwise(n / (2.0 * max(1, n - positive))))
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / max(1, n), maxIter=iterations).fit(own)
    scored = model.transform(own if judged_on is None else rows(judged_on)).select(r4(F.get(vector_to_array("probability"), 1)).alias("score"), "t")
    found = auc(scored, "score", "t")
    coef = F.lit([float(c) for c in model.coefficients.toArray()])
    return found.select(F.lit(vector).alias("kind"), F.size(coef).alias("dim"), coef.alias("coef"), F.lit(float(model.intercept)).alias("intercept"), "auc", "accuracy", F.lit(n).alias("train_rows"), (F.col("auc") >= bar).alias("meets_bar"))


def choose_probe(train: DataFrame, dev: DataFrame, image: str, text: str, target: str, bar: float = 0.65, iterations: int = 200) -> DataFrame:
    """One row: the probe over image and text together, or over the image alone where its area on ``dev`` is strictly larger,
    with the areas of all three."""
    both = [x.withColumn("multimodal", F.concat(image, text)) for x in (train, dev)]
    probes = {k: train_probe(both[0], k, target, bar, iterations, both[1]) for k in (image, text, "multimodal")}
    areas = {k: p.first()["auc"] for k, p in probes.items()}
    best = image if areas[image] > areas["multimodal"] else "multimodal"
    return probes[best].select("*", *[F.lit(areas[k]).alias(f"auc_{n}") for k, n in ((image, "image_only"), (text, "text_only"), ("multimodal", "multimodal"))])
