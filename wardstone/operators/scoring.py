"""Scores of models and of parts of a text: windows, label distributions, corroboration, combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import r4
from .decide import mapped
from .rules import GENERIC, HARMFUL, LABEL_CATEGORY, SAFE

MODEL_SKIP, GAME_CAP, MODEL_CATEGORY = 0.88, 0.30, 0.55


def _cut(text: Column, size: int, step: int, most: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / step)).cast("int"))
    parts = F.transform(at, lambda i: F.struct(i.alias("window_no"), text.substr(i * step + 1, F.lit(size)).alias("part")))
    return F.slice(F.filter(parts, lambda p: F.trim(p["part"]) != ""), 1, most)


def windows(text: Column, size: int = 300, overlap: int = 60, most: int = 16) -> Column:
    """Overlapping windows that are not blank; a short text is one."""
    whole = F.filter(F.array(F.struct(F.lit(0).alias("window_no"), text.alias("part"))), lambda p: F.trim(p["part"]) != "")
    return F.when(F.length(text) <= size, whole).otherwise(_cut(text, size, size - overlap, most))


def chunks(text: Column, size: int = 400, step: int = 200) -> Column:
    """All overlapping chunks of a text that are not blank. They are cut in one pass: a substring is counted off from the
    text's beginning each time."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), 1), lambda p: F.trim(p) != "")


def worst_window(df: DataFrame, key: str, number: str, score: Column) -> DataFrame:
    """The window of the highest score for each key, the first of equals."""
    best = F.max_by(F.struct(F.col(number), score.alias("score")), F.struct(score, -F.col(number)))
    return df.groupBy(key).agg(best.alias("b")).select(key, f"b.{number}", "b.score")


def harm(labels: Column) -> Column:
    """The largest harmful score, else what the safe labels leave, else null."""
    bad = F.array_max(F.transform(F.filter(labels, lambda x: x["label"].isin(HARMFUL)), lambda x: x["score"]))
    good = F.array_max(F.transform(F.filter(labels, lambda x: x["label"].isin(SAFE)), lambda x: x["score"]))
    return r4(F.coalesce(bad, 1 - good))


def ranked(labels: Column) -> Column:
    """Labels by score, the earlier of equals first."""
    placed = F.transform(labels, lambda x, i: F.struct((-x["score"]).alias("key"), i.alias("place"), x["label"].alias("label"), x["score"].alias("score")))
    return F.array_sort(placed)


def label_category(labels: Column, least: float = 0.5) -> Column:
    """Category of the strongest label that has one; a generic label yields to the first specific one."""
    fit = F.filter(ranked(labels), lambda x: (x["score"] >= least) & x["label"].isin(list(LABEL_CATEGORY)))
    specific = F.filter(fit, lambda x: ~x["label"].isin(GENERIC))
    top = F.get(fit, 0)["label"]
    return mapped(LABEL_CATEGORY, F.when(top.isin(GENERIC), F.coalesce(F.get(specific, 0)["label"], top)).otherwise(top))


def top_labels(labels: Column, k: int = 3) -> Column:
    return F.transform(F.slice(ranked(labels), 1, k), lambda x: F.struct(x["label"].alias("label"), r4(x["score"]).alias("score")))


def corroborated(*heads: Column) -> Column:
    """One trusted head or agreement of all keeps the best score, else it is damped; one reading stands as it is."""
    best, least = F.greatest(*heads), F.least(*heads)
    several = sum((h.isNotNull().cast("int") for h in heads), F.lit(0)) > 1
    return F.when(several & (best < 0.90) & (least < 0.50), r4(best * 0.70)).otherwise(best)


def combined(lexicon: Column, category: Column, has_hits: Column, in_game: Column, model: Column, model_category: Column, is_framed: Column) -> Column:
    """Struct of model_score, score, category and discounted_from; a null model score means that no model was asked."""
    m = F.when(lexicon >= MODEL_SKIP, F.lit(None).cast("double")).when(in_game, F.least(model, F.lit(GAME_CAP))).otherwise(model)
    mc = F.when((lexicon >= MODEL_SKIP) | in_game, F.lit(None).cast("string")).otherwise(model_category)
    score = F.greatest(lexicon, F.coalesce(m, F.lit(0.0)))
    cat = F.when(~has_hits & F.coalesce(m >= MODEL_CATEGORY, F.lit(False)), F.coalesce(mc, F.lit("bullying"))).otherwise(category)
    cut = is_framed & (cat != "sexual_harassment") & (score > 0.5)
    final = F.when(cut, 0.5).otherwise(score)
    return F.struct(m.alias("model_score"), final.alias("score"), F.when(cut & (final < 0.55), "none").otherwise(cat).alias("category"), F.when(cut, score).alias("discounted_from"))


def assembled(*parts: Column) -> Column:
    """Readings joined by spaces, blank ones left out."""
    return F.trim(F.concat_ws(" ", *[F.when(F.trim(p) != "", p) for p in parts]))


def channel(read: Column, picture: Column) -> Column:
    """The picture's reading leads only where it scores strictly higher."""
    return F.when(picture > read, "picture").otherwise("read")


def nothing(*texts: Column) -> Column:
    return F.concat(*[F.trim(F.coalesce(t, F.lit(""))) for t in texts]) == ""


def notes(**when: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in when.items()]))
