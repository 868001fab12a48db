"""Queries over checks, embeddings and regions: fusion, decisions, pictures and evidence."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import r4 as R
from ..operators import decide as D
from ..operators import evidence as E
from ..operators import lexicon as L
from ..operators import vision as V
from ..operators.rules import SUMMARY
from .fixtures import CHUNKS, FEATURES, REGIONS, RUNS, SEGMENTS, r4
from .registry import query
from .text_queries import _q, screened_sql

T2 = "case when child_age <= 10 then 0.55 when child_age <= 13 then 0.65 else 0.75 end"
_agree = "case when text_score >= 0.35 and text_score < 0.85 and vision_score >= 0.35 and vision_score < 0.85 then 0.15 else 0.0 end"
_v = "(vision_calibrated and vision_score > 0)"
FUSED = r4(f"case when text_score > 0 and {_v} then least(1.0, greatest(0.6*text_score + 0.4*vision_score + {_agree}, text_score, vision_score)) when text_score > 0 then text_score when {_v} then vision_score else 0.0 end")
MODE = f"case when text_score > 0 and {_v} then case when {_agree} > 0 then 'multimodal_agreement' else 'multimodal' end when text_score > 0 then 'text_only' when {_v} then 'vision_only' else 'idle' end"
ESC = "(text_score >= 0.35 or (vision_calibrated and vision_score >= 0.35))"
DECIDED = f"""f as (select *, {FUSED} as fused, {MODE} as mode, {T2} as threshold, {ESC} as escalated from {RUNS.sql} r),
 d as (select *, escalated and fused >= threshold and category <> 'none' as hit from f),
 decided as (select *, case when hit then 'hate' else 'not-hate' end as decision,
  case when hit or not escalated then null when fused < threshold then 'below_persona_threshold' else 'category_none' end as reason,
  case when not hit then 'none' when category = 'profanity' then 'notify_only' when category = 'threat' or fused >= 0.9 then 'block' when fused >= 0.7 then 'blur_region' else 'notify_only' end as action,
  case when hit then 'hate.detected' when escalated then 'hate.cleared' end as topic, case when hit then fused else {r4('text_score')} end as risk from d)"""


@query(f"""with {screened_sql('(select doc_id, text, cast(8 + doc_id % 8 as int) as child_age from documents)')},
 t as (select *, {T2} as threshold from scored)
 select doc_id, child_age, lexicon_score as score, category, case when lexicon_score >= 0.35 and lexicon_score >= threshold and category <> 'none' then 'hate' else 'not-hate' end as decision,
 case when not (lexicon_score >= 0.35 and lexicon_score >= threshold and category <> 'none') then 'none' when category = 'profanity' then 'notify_only' when category = 'threat' or lexicon_score >= 0.9 then 'block' when lexicon_score >= 0.7 then 'blur_region' else 'notify_only' end as action from t""")
def persona_decide(spark, d):
    """Flagship: text to rule hits, score, category, and the decision for the child's age."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", (8 + F.col("doc_id") % 8).cast("int").alias("child_age"))
    rows = L.screen(docs).select("doc_id", "child_age", F.col("lexicon_score").alias("text_score"), F.lit(0.0).alias("vision_score"), F.lit(False).alias("vision_calibrated"), "category")
    return D.decided(rows).select("doc_id", "child_age", F.col("fused").alias("score"), "category", "decision", "action")


@query(f"with {DECIDED} select id, fused, mode from decided")
def fuse_modalities(spark, d):
    return D.decided(RUNS.df(spark, d)).select("id", "fused", "mode")


_AUDIO = "case when id % 4 = 0 then cast((id*31) % 100 as double)/100 else 0.0 end"
_three = f"select id, text_score as t, case when vision_calibrated then vision_score else 0.0 end as v, {_AUDIO} as a, not vision_calibrated and vision_score > 0 as off from {RUNS.sql} r"


@query(f"""with s as ({_three}), n as (select *, (t > 0)::int + (v > 0)::int + (a > 0)::int as k, greatest(t, v, a) as f,
  (t = 0 or t >= 0.35 and t < 0.85) and (v = 0 or v >= 0.35 and v < 0.85) and (a = 0 or a >= 0.35 and a < 0.85) as mid from s),
 w as (select *, case when k > 1 then 0.6*t + 0.4*v else f end as weighted, k > 1 and mid as agree from n)
 select id, {r4('least(1.0, greatest(weighted + case when agree then 0.15 else 0.0 end, f))')} as fused, case when k = 0 then 'idle' when k = 1 then case when t > 0 then 'text_only' when v > 0 then 'vision_only' else 'audio_only' end when agree then 'multimodal_agreement' else 'multimodal' end as mode,
 {r4('f')} as floor, {r4('least(1.0, weighted)')} as weighted, agree as agreement,
 array_to_string(list_filter([case when t > 0 then 'text' end, case when v > 0 then 'vision' end, case when a > 0 then 'audio' end], lambda x: x is not null), '+') as contributing, case when off then 'vision' else '' end as ignored from w""")
def fuse_signal_arrays(spark, d):
    one = lambda n, s, c: F.struct(F.lit(n).alias("name"), F.col(s).alias("score"), c.alias("calibrated"))
    all_ = F.array(one("text", "text_score", F.lit(True)), one("vision", "vision_score", F.col("vision_calibrated")), one("audio", "audio_score", F.lit(True)))
    r = RUNS.df(spark, d).selectExpr("*", f"{_AUDIO} as audio_score").select("id", D.fuse_signals(all_).alias("f"))
    return r.select("id", "f.fused", "f.mode", "f.floor", "f.weighted", "f.agreement", F.array_join("f.contributing", "+").alias("contributing"), F.array_join("f.ignored", "+").alias("ignored"))


_t, _a = "case when has_ocr and has_asr then 0.55*text_score when has_asr then 0.0 else text_score end", "case when has_ocr and has_asr then 0.45*text_score when has_asr then text_score else 0.0 end"


@query(f"with s as (select id, {_t} as t, {_a} as a, vision_score as v from {RUNS.sql} r) select id, " + ", ".join(f"case when t + a + v < 1e-6 then 0.0 else {r4(f'{x} / (t + a + v)', 3)} end as {n}" for n, x in (("text_share", "t"), ("audio_share", "a"), ("vision_share", "v"))) + " from s")
def modality_shares(spark, d):
    s = D.shares(F.col("text_score"), F.col("vision_score"), F.col("has_ocr"), F.col("has_asr"))
    return RUNS.df(spark, d).select("id", *[c.alias(n) for n, c in s.items()])


@query(f"with {DECIDED} select id, threshold, decision, reason, action, risk from decided")
def decision_rows(spark, d):
    return D.decided(RUNS.df(spark, d)).select("id", "threshold", "decision", "reason", "action", "risk")


_oldsql = "case event_id % 7 when 0 then 'hate_speech' when 1 then 'cyberbullying' when 2 then 'Threat ' when 3 then 'odd name' when 4 then 'identity_attack' when 5 then 'threat' end"
_newsql = "case event_id % 7 when 0 then 'hate_identity' when 4 then 'hate_identity' when 5 then 'threat' when 6 then 'none' else 'bullying' end"


@query(f"with c as (select event_id, {_newsql} as category from events) select *, case category " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in SUMMARY.items()) + " end as summary from c")
def category_names(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_oldsql} as old")
    c = D.canonical(F.col("old"))
    return e.select("event_id", c.alias("category"), D.summary(c).alias("summary"))


@query(f"with {DECIDED} select id, case when decision = 'hate' then 'threat' when id % 17 = 0 then 'degraded' when escalated then 'reviewing' else 'protected' end as state from decided")
def protection_state(spark, d):
    notes = F.when(F.col("id") % 17 == 0, F.array(F.lit("ocr_failed: no reader"))).otherwise(F.array(F.lit("ocr_primary")))
    return D.decided(RUNS.df(spark, d)).select("id", D.protection(F.col("decision"), F.col("escalated"), notes).alias("state"))


_hits = "case when id % 6 = 0 then ['a/b', 'c/d', 'e/f', 'g/h', 'i/j'] when id % 3 = 0 then ['a/b'] else [] end"
_two = lambda x: f"printf('%.2f', {r4(x, 2)})"


def _hit_column():
    i = F.col("id")
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when(i % 6 == 0, some("a/b", "c/d", "e/f", "g/h", "i/j")).when(i % 3 == 0, some("a/b")).otherwise(F.array().cast("array<string>"))


@query(f"""with {DECIDED}, h as (select *, {_hits} as hits, case when id % 4 = 1 then text_score end as model from decided)
 select id, concat_ws(' ', case when decision = 'hate' then 'Flagged after multimodal scoring.' when escalated then 'Escalated to Stage 2 but stayed below this child''s age threshold.' else 'Stage-1 screen — nothing escalated.' end,
 case when has_ocr and has_asr then 'Read from on-screen text and speech.' when has_ocr then 'Read from on-screen text.' when has_asr then 'Read from speech.' end, case when len(hits) > 0 then 'Matched rule(s): ' || array_to_string(hits[1:4], ', ') || '.' end,
 case when model > 0 then 'Language model scored ' || {_two('model')} || '.' end, case when id % 8 = 0 then 'Score reduced — the text looks like it is reporting or quoting harm, not committing it.' end,
 case when vision_score > 0 and not vision_calibrated then 'Image branch read ' || {_two('vision_score')} || ' but is uncalibrated, so it did not affect the score.' end, 'Final risk ' || {_two('fused')} || '.') as sentence from h""")
def explanation(spark, d):
    r, i = D.decided(RUNS.df(spark, d)), F.col("id")
    named = {c: F.col(c) for c in ("decision", "escalated", "has_ocr", "has_asr", "vision_calibrated", "fused")}
    return r.select("id", D.explanation(hits=_hit_column(), model=F.when(i % 4 == 1, F.col("text_score")), framing=F.when(i % 8 == 0, "quoted_or_reported:meta"), vision=F.col("vision_score"), **named).alias("sentence"))


_shares = ", ".join(f"case when t + a + v < 1e-6 then 0.0 else {r4(f'{x} / (t + a + v)', 3)} end as {n}" for n, x in (("text_share", "t"), ("audio_share", "a"), ("vision_share", "v")))
_part = "case when has_ocr and has_asr then {0}*text_score when has_asr then {1} else {2} end"


@query(f"""with {DECIDED}, p as (select *, {_part.format('0.55', '0.0', 'text_score')} as t, {_part.format('0.45', 'text_score', '0.0')} as a, vision_score as v, {_hits} as hits from decided), s as (select *, {_shares} from p)
 select topic, cast(id as varchar) as key, case when topic = 'hate.detected' then to_json({{'score': fused, 'category': category, 'stage': 2, 'modalities': {{'text': text_share, 'image': vision_share, 'audio': audio_share}}, 'app': {{'exe': app_exe, 'category': 'other'}}, 'window_title_hash': '',
 'evidence': {{'ocr_snippet': case when has_ocr then left(repeat('read ', 100), 200) else '' end, 'transcript_snippet': case when has_asr then 'heard' else '' end, 'lexicon_hits': hits, 'top_tokens': cast([] as varchar[])}},
 'child_safe_summary': case category {' '.join(f'when {_q(k)} then {_q(v)}' for k, v in SUMMARY.items())} end, 'recommended_action': action, 'persona_threshold': cast(threshold as double)}})::varchar
 else to_json({{'stage1_score': {r4('greatest(text_score, vision_score)')}, 'stage2_score': fused, 'reason': reason}})::varchar end as value from s where topic is not null""")
def envelopes(spark, d):
    r = D.decided(RUNS.df(spark, d))
    shares = D.shares(F.col("text_score"), F.col("vision_score"), F.col("has_ocr"), F.col("has_asr"))
    r = r.select("*", *[c.alias(n) for n, c in shares.items()], F.lit(None).cast("string").alias("app_category"), F.when(F.col("has_ocr"), F.repeat(F.lit("read "), F.lit(100))).alias("ocr_text"), F.when(F.col("has_asr"), "heard").alias("transcript"), _hit_column().alias("hits"))
    return D.envelopes(r)


@query(f"with {DECIDED} select id, to_json({{'text': printf('%.4f', text_score), 'mode': mode}})::varchar as evidence_text, decision, risk, category, case when decision = 'hate' then 'Words' else '' end as mark from decided")
def evidence_rows(spark, d):
    r = D.decided(RUNS.df(spark, d))
    return r.select("id", F.to_json(F.struct(F.format_string("%.4f", F.col("text_score")).alias("text"), "mode")).alias("evidence_text"), "decision", "risk", "category", F.when(F.col("decision") == "hate", "Words").otherwise("").alias("mark"))


# --- pictures -------------------------------------------------------------------------------------------------------
def _banks(e):
    bank = lambda lo, hi: e.where(F.col("vec_id").between(lo, hi)).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("b")).select(F.transform("b", lambda x: x["embedding"]).alias("b"))
    return bank(0, 3), bank(4, 7)


@query(f"with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select e.vec_id, max(case when b.vec_id < 4 then list_dot_product(e.v, b.v) end) - max(case when b.vec_id >= 4 then list_dot_product(e.v, b.v) end) as m from e, e b where b.vec_id < 8 group by e.vec_id) select vec_id, {r4('greatest(0.0, least(1.0, (m + 0.15)/0.45))')} as score from s")
def zero_shot(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    harm, safe = _banks(e)  # one row of four vectors each
    both = F.broadcast(harm.withColumnRenamed("b", "harm").crossJoin(safe.withColumnRenamed("b", "safe")))
    return e.join(both, F.lit(True)).select("vec_id", V.zero_shot(F.col("embedding"), F.col("harm"), F.col("safe")).alias("score"))


_probe = "select e.vec_id, e.label, list_dot_product(list_transform(e.embedding, lambda x: x::double), list_transform(c.embedding, lambda x: x::double)) + 0.1 as z from embeddings e, (select embedding from embeddings where vec_id = 8) c"


def _scored(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    c = F.broadcast(e.where("vec_id = 8").select(F.col("embedding").alias("coef")))
    return e.join(c, F.lit(True)).select("vec_id", "label", V.probe(F.col("embedding"), F.col("coef"), F.lit(0.1)).alias("p")).select("vec_id", "label", "p.*")


@query(f"with s as ({_probe}) select vec_id, {r4('1/(1+exp(-z))')} as score, true as calibrated from s")
def probe_score(spark, d):
    return _scored(spark, d).select("vec_id", "score", "calibrated")


@query(f"with s as ({_probe}), p as (select {r4('1/(1+exp(-z))')} as s, label = 0 as y from s), k as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1)/2.0 as rk from p) select {r4('(sum(case when y then rk end) - count_if(y)*(count_if(y)+1)/2.0)/(count_if(y)*count_if(not y))')} as auc, {r4('avg(case when (s >= 0.5) = y then 1.0 else 0.0 end)')} as accuracy, max(s) - min(s) as spread, count(*) as rows from k")
def probe_auc(spark, d):
    return V.auc(_scored(spark, d).withColumn("y", F.col("label") == 0), "score", "y")


@query("select event_id, case when event_id % 3 = 0 then 'none' when event_id % 2 = 0 and (event_id % 5 <> 0 or event_id % 7 = 0) then 'probe' when event_id % 2 = 0 then 'abstain' else 'zero_shot' end as kind, case when event_id % 3 = 0 then 'no_picture_region' when event_id % 2 = 0 and (event_id % 5 <> 0 or event_id % 7 = 0) then null when event_id % 2 = 0 then 'probe_needs_text' else 'vision_uncalibrated' end as note from events")
def vision_branch(spark, d):
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(i, V.branch(i % 3 != 0, i % 2 == 0, i % 7 == 0, i % 5 == 0).alias("b")).select(i, "b.*")


@query()
def probe_train(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("y", F.col("label") == 0)
    return V.train_probe(e, "embedding", "y").select("kind", "dim", "auc", "meets_bar")


# --- evidence -------------------------------------------------------------------------------------------------------
@query(f"select frame_id, ord, {r4('greatest(0.0, least(1.0, least(x0, x1)/1.5))')} as x0, {r4('greatest(0.0, least(1.0, least(y0, y1)/0.5))')} as y0, {r4('greatest(0.0, least(1.0, greatest(x0, x1)/1.5))')} as x1, {r4('greatest(0.0, least(1.0, greatest(y0, y1)/0.5))')} as y1, {r4('conf', 3)} as conf, text from {REGIONS.sql} r")
def region_boxes(spark, d):
    r = REGIONS.df(spark, d)
    text, conf = E.region(F.col("text"), F.col("conf"))
    return r.select("frame_id", "ord", E.box_of(F.array("x0", "x1", "x1", "x0"), F.array("y0", "y0", "y1", "y1"), F.lit(1.5), F.lit(0.5)).alias("b"), conf.alias("conf"), text.alias("text")).select("frame_id", "ord", "b.*", "conf", "text")


@query(f"select frame_id, ord, {r4('greatest(0.0, least(1.0, ((ord % 3)*0.9 + least(1.0, x0))/2.8))')} as x0, {r4('greatest(0.0, least(1.0, ((ord % 2)*0.9 + least(1.0, y0))/2.8))')} as y0 from {REGIONS.sql} r")
def region_tiles(spark, d):
    r = REGIONS.df(spark, d)
    place = lambda v, t: E.from_tile(F.least(F.lit(1.0), F.col(v)), F.col("ord") % t, F.lit(3), F.lit(0.1))
    return r.select("frame_id", "ord", place("x0", 3).alias("x0"), place("y0", 2).alias("y0"))


IOU = """with r as (select * from REG x), p as (select a.frame_id, a.ord as ord_a, b.ord as ord_b, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i,
 (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) as s from r a join r b on a.frame_id = b.frame_id and KEY(a.text) = KEY(b.text) and a.ord < b.ord), q as (select frame_id, ord_a, ord_b, case when s - i > 0 then i/(s - i) else 0.0 end as iou from p)""".replace("REG", REGIONS.sql)
IOU = re.sub(r"KEY\((\w\.text)\)", r"trim(regexp_replace(lower(\1), '\\\\s+', ' ', 'g'))", IOU)


@query(f"{IOU} select frame_id, ord_a, ord_b, {r4('iou')} as iou from q where iou >= 0.1")
def region_overlaps(spark, d):
    o = E.overlaps(REGIONS.df(spark, d))
    return o.withColumn("iou", R(F.col("iou")))


@query()
def region_dedupe(spark, d):
    return E.deduped(REGIONS.df(spark, d))


@query(f"select frame_id, string_agg(text, ' ' order by round(cast(y0 as decimal(18,8)), 2), x0, ord) as text from {REGIONS.sql} r group by frame_id")
def reading_order(spark, d):
    return E.reading_order(REGIONS.df(spark, d))


_risk = "cast((frame_id*31 + ord*7) % 100 as double)/100"


@query(f"with r as (select *, {_risk} as score from {REGIONS.sql} x), k as (select *, row_number() over (partition by frame_id order by kind = 'picture' desc, score desc, length(trim(text)) desc, ord) as rank from r) select frame_id, ord, kind, rank from k where rank <= 3")
def evidence_topk(spark, d):
    return E.top_evidence(REGIONS.df(spark, d).selectExpr("*", f"{_risk} as score"), 3).select("frame_id", "ord", "kind", "rank")


@query(f"with r as (select frame_id, {_risk} as score, cast(8 + frame_id % 8 as int) as child_age from {REGIONS.sql} x), t as (select *, {T2} as lim from r) select child_age, case when score >= lim then 'high' when score >= lim*0.6 then 'medium' else 'low' end as tier, count(*) as n from t group by 1, 2")
def region_tiers(spark, d):
    r = REGIONS.df(spark, d).selectExpr("frame_id", f"{_risk} as score", "cast(8 + frame_id % 8 as int) as child_age")
    return r.groupBy("child_age", E.tier(F.col("score"), D.threshold(F.col("child_age"))).alias("tier")).agg(F.count("*").alias("n"))


@query(f"with {screened_sql('''(select doc_id, unnest(string_split(text, chr(10))) as text from documents)''')} select doc_id, max(lexicon_score) as risk, count_if(lexicon_score >= 0.35) as risky from scored group by doc_id")
def region_risk(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return L.screen(lines).groupBy("doc_id").agg(F.max("lexicon_score").alias("risk"), F.count_if(F.col("lexicon_score") >= 0.35).alias("risky"))


@query(f"select clip, string_agg(text, ' ' order by event_id) as transcript from {SEGMENTS.sql} s where no_speech_prob <= 0.6 and avg_logprob >= -1.0 group by clip")
def transcript_assembly(spark, d):
    return E.transcripts(SEGMENTS.df(spark, d))


@query(f"with c as (select * from {CHUNKS.sql} x), w as (select device_id, seq, sqrt(sum(sumsq) over k / sum(n) over k) as rms from c window k as (partition by device_id order by seq rows between 11 preceding and current row)) select device_id, seq, {r4('rms')} as rms, rms >= 0.05 as loud from w")
def audio_gate(spark, d):
    return E.sound_gate(CHUNKS.df(spark, d), least=0.05).select("device_id", "seq", R(F.col("rms")).alias("rms"), "loud")


@query(f"with f as (select label, vec_id, list_transform(embedding, lambda x: x::double*128) as px from embeddings), l as (select *, lag(px) over (partition by label order by vec_id) as b from f) select label, vec_id, case when b is null then 0.0 else {r4('list_sum(list_transform(list_zip(px, b), lambda z: abs(z[1] - z[2])))/len(px)/255*100', 2)} end as change from l")
def scene_change(spark, d):
    f = spark.read.parquet(f"{d}/embeddings.parquet").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") * 128).alias("px"))
    return E.scene_change(f, "label", "vec_id", "px").select("label", "vec_id", "change")


WORDS = {"adult": ["ring"], "weapon": ["bolt"], "violence": ["widget"], "cooking": ["plate"], "dancing": ["gear"]}
_n = {k: f"contains(lower(title), '{v[0]}')" for k, v in WORDS.items()}
_fr = f"""select frame_id, case when {_n['adult']} and not {_n['dancing']} then 0.89 when skin_ratio > 0.35 and not {_n['dancing']} and not {_n['cooking']} then 0.84 else 0.12 end as nsfw,
 case when {_n['weapon']} and not {_n['cooking']} then 0.91 when (long_shape or frame_id % 8 = 0) and has_person and not {_n['cooking']} then 0.81 else 0.15 end as weapons,
 case when {_n['violence']} and not {_n['dancing']} then 0.94 when motion > 12 and has_person and not {_n['dancing']} then 0.83 else 0.05 end as violence from {FEATURES.sql} f"""


def _frames(spark, d):
    f = FEATURES.df(spark, d)
    s = E.frame_scores(F.col("title"), F.col("skin_ratio"), F.col("motion"), F.col("has_person"), F.col("long_shape"), F.col("frame_id") % 8 == 0, WORDS)
    return f.select("frame_id", *[c.cast("double").alias(n) for n, c in s.items()])


@query(f"select frame_id, cast(nsfw as double) as nsfw, cast(weapons as double) as weapons, cast(violence as double) as violence from ({_fr})")
def frame_rules(spark, d):
    return _frames(spark, d)


@query(f"with s as ({_fr}) select frame_id, case when nsfw > 0.8 and nsfw >= (case when violence > 0.8 then violence else 0 end) and nsfw >= (case when weapons > 0.75 then weapons else 0 end) then 'adult_content' when violence > 0.8 and violence >= (case when weapons > 0.75 then weapons else 0 end) then 'violence' when weapons > 0.75 then 'weapons' else 'none' end as threat from s")
def frame_threat(spark, d):
    return _frames(spark, d).select("frame_id", E.frame_threat(F.col("nsfw"), F.col("violence"), F.col("weapons")).alias("threat"))


@query(f"select frame_id, count(*) as n, {r4('sum(x1 - x0)')} as width, {r4('sum(y1 - y0)')} as height from {REGIONS.sql} r where conf > 0.4 group by frame_id")
def object_filter(spark, d):
    r = REGIONS.df(spark, d).groupBy("frame_id").agg(F.collect_list(F.struct(F.col("text").alias("label"), "conf", "x0", "y0", "x1", "y1")).alias("found"))
    r = r.select("frame_id", E.objects(F.col("found")).alias("o")).where(F.size("o") > 0)
    total = lambda k: R(F.aggregate("o", F.lit(0.0), lambda s, o: s + o[k]))
    return r.select("frame_id", F.size("o").cast("long").alias("n"), total("w").alias("width"), total("h").alias("height"))


@query("with l as (select user_id as device_id, event_id // 2 as record, max(event_id) as event_id, arg_max(event_type, event_id) as state from events group by 1, 2), k as (select *, row_number() over (partition by device_id order by event_id desc) as rank from l) select device_id, record, state, rank from k where rank <= 20")
def frame_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("device_id"), F.floor(F.col("event_id") / 2).alias("record"), "event_id", F.col("event_type").alias("state"))
    return E.frame_log(e, "record", "event_id").select("device_id", "record", "state", "rank")


@query("select event_id, t in ('click', 'error') as playing, t = 'error' as fullscreen, case when t in ('click', 'error') then t else 'No active media session detected' end as title from (select event_id, case when event_id % 9 = 0 then ' ' else event_type end as t from events)")
def title_flags(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("t"))
    return e.select("event_id", E.media_flags(F.col("t"), ["click", "error"], ["error", "purchase"]).alias("m")).select("event_id", "m.*")
