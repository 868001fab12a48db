"""What a check leaves behind: notes, marked regions, evidence, the steps of its trace; and reports of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, r4

REGION = "array<struct<kind:string,box:array<double>,text:string,conf:double,score:double,category:string,hits:array<string>,scored_by:string>>"
STEP = "array<struct<step:string,label:string,status:string,ms:double,detail:string>>"
#: Steps of a trace in order, and their labels.
STEPS = [("capture", "Screen grab"), ("audio", "Loopback audio"), ("ocr", "OCR text"), ("clip", "Image embed (CLIP)"), ("vlm", "Image meaning"), ("stage1", "Stage-1 scan"), ("stage2", "Fusion"), ("decide", "Decision")]


def run_notes(*, ocr: Column, transcript: Column, picture: Column, has_image: Column, escalated: Column, picture_led: Column, vision_score: Column, vision_calibrated: Column, vision_escalates: Column, found_more: Column, failed: Column) -> Column:
    """Notes of a run in the order in which its steps leave them; ``failed`` is an array of notes on failed steps."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    o, t, p = has(ocr), has(transcript), has(picture)
    when = {
        "picture_reading_led": picture_led,
        "vision_uncalibrated_excluded": (vision_score > 0) & ~vision_calibrated,
        "multimodal_ocr_asr": o & t,
        "asr_primary": t & ~o,
        "ocr_primary": o & ~t,
        "picture_text_read": p,
        "image_without_readable_text": has_image & ~o & ~p,
        "vision_only_escalation": vision_escalates & ~o & ~t & ~p,
        "stopped_at_stage1": ~escalated,
        "stage2_found_more_in_full_text": escalated & found_more,
    }
    return F.concat(failed, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in when.items()])))


def marked(regions: Column, crop: Column, caption: Column, width: Column, height: Column) -> Column:
    """The scored text regions of a frame and, after them, the picture that was read, in shares of the frame. ``crop`` is
    (left, top, right, bottom) in pixels; without it, or in a frame without a size, there is no picture."""
    side = lambda i, size: r4(clamp(F.get(crop, i) / size))
    box = F.array(side(0, width), side(1, height), side(2, width), side(3, height))
    none = F.array().cast("array<string>")
    one = F.array(F.struct(F.lit("picture").alias("kind"), box.alias("box"), F.left(F.coalesce(caption, F.lit("")), F.lit(120)).alias("text"), F.lit(0.0).alias("conf"), F.lit(0.0).alias("score"), F.lit("none").alias("category"), none.alias("hits"), F.lit("vision-language model").alias("scored_by"))).cast(REGION)
    return F.when(crop.isNull() | (width <= 0) | (height <= 0), regions).otherwise(F.concat(regions, one))


def evidence(*, lexicon: Column, model: Column, labels: Column, framing: Column, before_framing: Column, calibrated: Column, mode: Column, escalated: Column, explanation: Column, detections: Column) -> Column:
    """Why a run scored what it did, as it is stored: null scores stay null, missing texts are empty, no mode is idle."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        r4(F.coalesce(lexicon, F.lit(0.0))).alias("lexicon_score"), r4(model).alias("model_score"), F.coalesce(labels, F.create_map().cast("map<string,double>")).alias("model_labels"),
        text(framing).alias("framing_reason"), r4(before_framing).alias("score_before_framing"), F.coalesce(calibrated, F.lit(False)).alias("vision_calibrated"),
        F.when(text(mode) == "", "idle").otherwise(mode).alias("fusion_mode"), F.coalesce(escalated, F.lit(False)).alias("escalated"), text(explanation).alias("explanation"), detections.alias("detections"),
    )


def _step(name: str, status: Column | str, ms: Column | float, detail: Column | str, label: str | Column | None = None) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown = c(dict(STEPS)[name] if label is None else label)
    return F.struct(F.lit(name).alias("step"), shown.alias("label"), c(status).alias("status"), F.coalesce(c(ms).cast("double"), F.lit(0.0)).alias("ms"), c(detail).alias("detail"))


def trace(*, outcome: Column, error: Column, had_frame: Column, screen_ok: Column, size: Column, ocr: Column, transcript: Column, notes: Column, ms: Column, clip: Column, vlm: Column, text_score: Column, vision_score: Column, fused: Column, decision: Column, risk: Column) -> Column:
    """Steps of a check that was analysed, skipped as a repeat, or failed at its capture. ``ms`` is a map of times by
    step, ``size`` the frame's size as text, ``vlm`` the backend that reads pictures (none: no such step)."""
    noted = lambda start: F.exists(notes, lambda n: n.startswith(start))
    number = lambda c: F.format_string("%.2f", r4(F.coalesce(c, F.lit(0.0)), 2))
    chars = lambda c: F.concat(F.length(c).cast("string"), F.lit(" chars"))
    at = lambda k: F.try_element_at(ms, F.lit(f"{k}_ms"))
    dash, escalated = "—", ~F.array_contains(notes, "stopped_at_stage1")
    o, t, e = (F.coalesce(c, F.lit("")) for c in (ocr, transcript, error))
    hate = decision == "hate"
    has_vlm = ~F.coalesce(vlm, F.lit("none")).isin("none", "")
    read = F.array_contains(notes, "vision_meaning_used") | F.array_contains(notes, "vision_meaning_read")
    lost = F.array_contains(notes, "vision_meaning_unavailable")
    vlm_status = F.when(read, "ok").when(lost, "fail").when(at("vlm").isNotNull(), "ok").otherwise("skip")
    vlm_detail = F.when(read, F.replace(vlm, F.lit("lmstudio:"), F.lit(""))).when(lost, "model unreachable").when(at("vlm").isNotNull(), "no added signal").otherwise("gate closed")
    analysed = F.array(
        _step("capture", F.when(had_frame & screen_ok, "ok").when(had_frame, "warn").when(e != "", "fail").otherwise("skip"), at("capture"), F.when(had_frame, F.coalesce(size, F.lit(dash))).when(e != "", F.left(e, F.lit(80))).otherwise("not a screen check")),
        _step("audio", F.when(t != "", "ok").otherwise("skip"), F.when(t != "", at("asr")), F.when(t != "", chars(t)).otherwise("silent")),
        _step("ocr", F.when(noted("ocr_failed"), "fail").when((o == "") & ~had_frame, "skip").otherwise("ok"), at("ocr"), F.when(o != "", chars(o)).when(had_frame, "empty").otherwise(dash)),
        _step("clip", F.when(~had_frame, "skip").when(noted("clip_failed"), "fail").otherwise("ok"), at("clip"), F.coalesce(clip, F.lit(dash))),
    )
    rest = F.array(
        _step("stage1", "ok", at("stage1"), F.concat(F.lit("text "), number(text_score), F.lit(" · vision "), number(vision_score))),
        _step("stage2", "ok", at("stage2"), F.when(fused.isNull(), dash).otherwise(F.concat(F.lit("fused "), number(fused))), F.when(escalated, "Fusion (Stage-2)").otherwise("Fusion preview")),
        _step("decide", F.when(hate, "warn").otherwise("ok"), 0.0, F.concat(F.when(hate, "Alert").otherwise("Clear"), F.lit(" · risk "), number(risk))),
    )
    meaning = F.when(has_vlm, F.array(_step("vlm", vlm_status, at("vlm"), vlm_detail))).otherwise(F.array().cast(STEP))
    done = F.concat(analysed, meaning, rest)
    same = "duplicate frame, no new audio"
    repeat = F.array(_step("capture", "ok", 0.0, "same frame as last tick"), _step("audio", "skip", 0.0, "silent"), _step("ocr", "skip", 0.0, "skipped — no change"), *[_step(n, "skip", 0.0, dash) for n in ("clip", "vlm", "stage1", "stage2")], _step("decide", "skip", 0.0, F.when(e == "", same).otherwise(e)))
    broken = F.array(_step("capture", "fail", at("capture"), F.left(e, F.lit(80))), _step("audio", "skip", 0.0, dash), _step("ocr", "skip", 0.0, "no input"), *[_step(n, "skip", 0.0, dash) for n in ("clip", "stage1", "stage2")], _step("decide", "skip", 0.0, "waiting for capture"))
    return F.when(outcome == "skipped", repeat).when(outcome == "capture_failed", broken).otherwise(done).cast(STEP)


def live_or_stored(live: DataFrame, stored: DataFrame, device: str = "device_id") -> DataFrame:
    """The live trace of each device, else the one of its newest stored run."""
    newest = stored.groupBy(device).agg(F.max_by(F.struct("*"), F.struct("ts", "id")).alias("r")).select("r.*")
    return live.unionByName(newest.join(live.select(device).distinct(), device, "left_anti"))


def tidy(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(*by, metric, value): one row for each number of a report."""
    return metrics.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(by, values, "metric", "value")


def markdown(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(*by, line): each row as a line of a table, shares in percent with a decimal."""
    cell = lambda c: F.format_string("%.1f%%", F.round(F.col(c) * 1000) / 10)
    cells = [F.col(c).cast("string") for c in by] + [cell(v) for v in values]
    return metrics.select(*by, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def heading(by: list[str], values: list[str]) -> str:
    """The two lines above the lines of ``markdown``."""
    return f"| {' | '.join([*by, *values])} |\n{'|---' * (len(by) + len(values))}|"


def as_json(metrics: DataFrame, scorer: str, persona: str, values: list[str]) -> DataFrame:
    """(scorer, report): a JSON object of each scorer's numbers by persona; personas are few."""
    one = F.struct(F.col(persona).alias("key"), F.to_json(F.struct(*values)).alias("value"))
    rows = metrics.groupBy(scorer).agg(F.array_sort(F.collect_list(one)).alias("all"))
    pairs = F.transform("all", lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"]))
    return rows.select(scorer, F.concat(F.lit('{"personas":{'), F.array_join(pairs, ","), F.lit("}}")).alias("report"))
