"""Decisions by age: thresholds, fusion of signals, categories, actions, explanations and stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import r4
from .rules import CATEGORIES, LEGACY, SUMMARY

GATE = 0.35


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def band(age: Column) -> Column:
    return F.when(age <= 10, "child").when(age <= 13, "preteen").otherwise("teen")


def threshold(age: Column) -> Column:
    return F.when(age <= 10, 0.55).when(age <= 13, 0.65).otherwise(0.75)


def canonical(category: Column) -> Column:
    """A known category as it is, an older name as its new one, any other as bullying; null is none."""
    return F.when(category.isNull(), "none").when(category.isin(CATEGORIES), category).otherwise(F.coalesce(mapped(LEGACY, category), F.lit("bullying")))


def action(category: Column, score: Column) -> Column:
    return F.when(category == "profanity", "notify_only").when((category == "threat") | (score >= 0.9), "block").when(score >= 0.7, "blur_region").otherwise("notify_only")


def summary(category: Column) -> Column:
    return F.coalesce(mapped(SUMMARY, category), F.lit(SUMMARY["none"]))


def escalates(text: Column, vision: Column, calibrated: Column) -> Column:
    return (text >= GATE) | (calibrated & (vision >= GATE))


def fused(text: Column, vision: Column, calibrated: Column) -> tuple[Column, Column]:
    """Score and mode of two signals: a weighted mean with a bonus for agreement, never under the strongest that counts."""
    agree = text.between(0.35, 0.85) & (text < 0.85) & vision.between(0.35, 0.85) & (vision < 0.85)
    both = F.least(F.lit(1.0), F.greatest(0.6 * text + 0.4 * vision + F.when(agree, 0.15).otherwise(0.0), text, vision))
    has_text, has_vision = text > 0, calibrated & (vision > 0)
    score = F.when(has_text & has_vision, both).when(has_text, text).when(has_vision, vision).otherwise(0.0)
    mode = F.when(has_text & has_vision & agree, "multimodal_agreement").when(has_text & has_vision, "multimodal").when(has_text, "text_only").when(has_vision, "vision_only").otherwise("idle")
    return r4(score), mode


def fuse_signals(signals: Column) -> Column:
    """The same over an array of (name, score, calibrated). Text weighs 0.6 and vision 0.4; signals of other names only set
    the floor and take part in the agreement. Struct of fused, mode, floor, weighted, agreement, contributing, ignored."""
    used = F.filter(signals, lambda s: s["calibrated"] & (s["score"] > 0))
    strongest = F.coalesce(F.array_max(F.transform(used, lambda s: s["score"])), F.lit(0.0))
    first = lambda name: F.coalesce(F.get(F.filter(used, lambda s: s["name"] == name), 0)["score"], F.lit(0.0))
    several = F.size(used) > 1
    weighted = F.when(several, 0.6 * first("text") + 0.4 * first("vision")).otherwise(strongest)
    agreement = several & F.forall(used, lambda s: (s["score"] >= 0.35) & (s["score"] < 0.85))
    value = F.least(F.lit(1.0), F.greatest(weighted + F.when(agreement, 0.15).otherwise(0.0), strongest))
    names = F.transform(used, lambda s: s["name"])
    mode = F.when(F.size(used) == 0, "idle").when(~several, F.concat(F.get(names, 0), F.lit("_only"))).when(agreement, "multimodal_agreement").otherwise("multimodal")
    ignored = F.filter(signals, lambda s: ~s["calibrated"] & (s["score"] > 0))
    return F.struct(r4(value).alias("fused"), mode.alias("mode"), r4(strongest).alias("floor"), r4(F.least(F.lit(1.0), weighted)).alias("weighted"), agreement.alias("agreement"), names.alias("contributing"), F.transform(ignored, lambda s: s["name"]).alias("ignored"))


def shares(text: Column, vision: Column, has_ocr: Column, has_asr: Column) -> dict[str, Column]:
    """Shares of text, audio and vision of the evidence, three places; all zero without evidence."""
    t = F.when(has_ocr & has_asr, 0.55 * text).when(has_asr, 0.0).otherwise(text)
    a = F.when(has_ocr & has_asr, 0.45 * text).when(has_asr, text).otherwise(0.0)
    total = t + a + vision
    return {n: F.when(total < 1e-6, 0.0).otherwise(r4(x / total, 3)) for n, x in (("text_share", t), ("audio_share", a), ("vision_share", vision))}


def decided(df: DataFrame) -> DataFrame:
    """Adds threshold, category, decision, action, reason and topic to rows with age, text_score, vision_score,
    vision_calibrated and category."""
    score, mode = fused(F.col("text_score"), F.col("vision_score"), F.col("vision_calibrated"))
    out = df.withColumn("category", canonical(F.col("category"))).withColumn("fused", score).withColumn("mode", mode)
    out = out.withColumn("threshold", threshold(F.col("child_age"))).withColumn("escalated", escalates(F.col("text_score"), F.col("vision_score"), F.col("vision_calibrated")))
    hate = F.col("escalated") & (F.col("fused") >= F.col("threshold")) & (F.col("category") != "none")
    out = out.withColumn("decision", F.when(hate, "hate").otherwise("not-hate"))
    out = out.withColumn("reason", F.when(hate | ~F.col("escalated"), F.lit(None).cast("string")).when(F.col("fused") < F.col("threshold"), "below_persona_threshold").otherwise("category_none"))
    out = out.withColumn("action", F.when(hate, action(F.col("category"), F.col("fused"))).otherwise("none"))
    topic = F.when(hate, "hate.detected").when(F.col("escalated"), "hate.cleared")
    return out.withColumn("topic", topic).withColumn("risk", F.when(hate, F.col("fused")).otherwise(r4(F.col("text_score"))))


def protection(decision: Column, escalated: Column, notes: Column) -> Column:
    return F.when(decision == "hate", "threat").when(F.exists(notes, lambda n: F.contains(n, F.lit("failed:"))), "degraded").when(escalated, "reviewing").otherwise("protected")


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", r4(F.coalesce(x, F.lit(0.0)), 2))


def explanation(*, decision: Column, escalated: Column, has_ocr: Column, has_asr: Column, hits: Column, model: Column, framing: Column, vision: Column, vision_calibrated: Column, fused: Column) -> Column:
    """One sentence for each fact that moved the decision: outcome, channels, rules (four at most), model, framing, a picture
    score that doesn't count, and the risk. The wording is a fixed value."""
    channels = F.array_compact(F.array(F.when(has_ocr, "on-screen text"), F.when(has_asr, "speech")))
    parts = [
        F.when(decision == "hate", "Flagged after multimodal scoring.").when(escalated, "Escalated to Stage 2 but stayed below this child's age threshold.").otherwise("Stage-1 screen — nothing escalated."),
        F.when(F.size(channels) > 0, F.concat(F.lit("Read from "), F.array_join(channels, " and "), F.lit("."))),
        F.when(F.size(hits) > 0, F.concat(F.lit("Matched rule(s): "), F.array_join(F.slice(hits, 1, 4), ", "), F.lit("."))),
        F.when(model > 0, F.concat(F.lit("Language model scored "), two_places(model), F.lit("."))),
        F.when(F.coalesce(framing, F.lit("")) != "", "Score reduced — the text looks like it is reporting or quoting harm, not committing it."),
        F.when((vision > 0) & ~vision_calibrated, F.concat(F.lit("Image branch read "), two_places(vision), F.lit(" but is uncalibrated, so it did not affect the score."))),
        F.concat(F.lit("Final risk "), two_places(fused), F.lit(".")),
    ]
    return F.concat_ws(" ", *parts)


def detected_payload(df: DataFrame) -> Column:
    """What a detection tells, of a decided row with text_share, vision_share and audio_share, app_exe, app_category,
    ocr_text, transcript and hits."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.struct(
        r4(F.col("fused")).alias("score"), F.col("category"), F.lit(2).alias("stage"),
        F.struct(F.col("text_share").alias("text"), F.col("vision_share").alias("image"), F.col("audio_share").alias("audio")).alias("modalities"),
        F.struct(F.coalesce("app_exe", F.lit("unknown")).alias("exe"), F.coalesce("app_category", F.lit("other")).alias("category")).alias("app"), F.lit("").alias("window_title_hash"),
        F.struct(F.substring(text("ocr_text"), 1, 200).alias("ocr_snippet"), F.substring(text("transcript"), 1, 200).alias("transcript_snippet"), F.slice("hits", 1, 10).alias("lexicon_hits"), F.array().cast("array<string>").alias("top_tokens")).alias("evidence"),
        F.coalesce(mapped(SUMMARY, F.col("category")), F.lit(SUMMARY["bullying"])).alias("child_safe_summary"), action(F.col("category"), F.col("fused")).alias("recommended_action"), F.col("threshold").alias("persona_threshold"),
    )


def cleared_payload(df: DataFrame) -> Column:
    """What a row that escalated and was cleared tells: both scores and the reason."""
    return F.struct(r4(F.greatest("text_score", "vision_score")).alias("stage1_score"), r4(F.col("fused")).alias("stage2_score"), F.col("reason"))


def envelopes(df: DataFrame) -> DataFrame:
    """(topic, key, value) of decided rows that have a topic: the key is the correlation id, the value the payload as JSON."""
    payload = F.when(F.col("topic") == "hate.detected", F.to_json(detected_payload(df))).otherwise(F.to_json(cleared_payload(df)))
    return df.where(F.col("topic").isNotNull()).select("topic", F.col("id").cast("string").alias("key"), payload.alias("value"))
