"""Queries over what checks leave behind, reports, and operators on texts and lists that no table of checks holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dashboard as B
from ..operators import decide as D
from ..operators import evaluation as E
from ..operators import evidence as V
from ..operators import heads as H
from ..operators import report as P
from ..operators import vision as I
from .decision_queries import DECIDED
from .evaluation_queries import SCORED, _scored, counts, metrics
from .fixtures import RUNS, r4
from .registry import query

VALUES = ["accuracy", "precision", "recall", "f1", "fp_rate"]
PERSONAS = {"8-10": 0.55, "11-13": 0.65, "14-15": 0.75}
_p = ", ".join(f"('{k}', {v})" for k, v in PERSONAS.items())
_metrics = f"with {SCORED}, p(persona, theta) as (values {_p}), c as (select persona, scorer, {counts('score >= theta')} from u, p group by persona, scorer), x as (select persona, scorer, {metrics('')} from c)"


def _report(spark, d):
    return E.by_persona(_scored(spark, d), PERSONAS)


@query(f"{_metrics} unpivot (select persona, scorer, {', '.join(VALUES)} from x) on {', '.join(VALUES)} into name metric value value")
def report_tidy(spark, d):
    return P.tidy(_report(spark, d), ["persona", "scorer"], VALUES)


_cells = " || ' | ' || ".join(["persona", "scorer", *[f"printf('%.1f%%', round({v}*1000)/10)" for v in VALUES]])


@query(f"{_metrics} select persona, scorer, '| ' || {_cells} || ' |' as line from x")
def report_markdown(spark, d):
    return P.markdown(_report(spark, d), ["persona", "scorer"], VALUES)


@query(f"""{_metrics} select scorer, '{{"personas":{{' || string_agg('"' || persona || '":{{"tp":' || tp || ',"fp":' || fp || ',"tn":' || tn || ',"fn":' || fn || '}}', ',' order by persona) || '}}}}' as report from x group by scorer""")
def report_json(spark, d):
    return P.as_json(_report(spark, d), "scorer", "persona", ["tp", "fp", "tn", "fn"])


# --- runs -----------------------------------------------------------------------------------------------------------
_ocr, _asr, _pic = "has_ocr", "has_asr", "id % 7 = 0"
_notes = {
    "clip_failed:Error": "id % 17 = 0", "picture_reading_led": f"{_pic} and id % 3 = 1", "vision_uncalibrated_excluded": "vision_score > 0 and not vision_calibrated",
    "multimodal_ocr_asr": f"{_ocr} and {_asr}", "asr_primary": f"{_asr} and not {_ocr}", "ocr_primary": f"{_ocr} and not {_asr}", "picture_text_read": _pic,
    "image_without_readable_text": f"id % 4 <> 0 and not {_ocr} and not ({_pic})", "vision_only_escalation": f"vision_calibrated and vision_score >= 0.35 and not {_ocr} and not {_asr} and not ({_pic})",
    "stopped_at_stage1": "not escalated", "stage2_found_more_in_full_text": "escalated and id % 5 = 2",
}


def _noted(r):
    i = F.col("id")
    said = lambda c, t: F.when(c, t)
    return P.run_notes(
        ocr=said(F.col("has_ocr"), "read"), transcript=said(F.col("has_asr"), "heard"), picture=said(i % 7 == 0, "seen"), has_image=i % 4 != 0, escalated=F.col("escalated"), picture_led=(i % 7 == 0) & (i % 3 == 1),
        vision_score=F.col("vision_score"), vision_calibrated=F.col("vision_calibrated"), vision_escalates=F.col("vision_calibrated") & (F.col("vision_score") >= D.GATE), found_more=i % 5 == 2,
        failed=F.when(i % 17 == 0, F.array(F.lit("clip_failed:Error"))).otherwise(F.array().cast("array<string>")),
    )


@query(f"with {DECIDED} select id, concat_ws(',', {', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in _notes.items())}) as notes from decided")
def run_notes(spark, d):
    r = D.decided(RUNS.df(spark, d))
    return r.select("id", F.array_join(_noted(r), ",").alias("notes"))


@query(f"""with {DECIDED} select id, {r4('text_score')} as lexicon_score, case when vision_calibrated then {r4('vision_score')} end as model_score, case when id % 3 = 0 then 'quoted_or_reported:meta' else '' end as framing_reason,
 case when id % 3 = 0 then {r4('text_score')} end as score_before_framing, vision_calibrated, mode as fusion_mode, escalated, coalesce(reason, '') as explanation, 1 + cast(id % 4 = 0 as int) as detections from decided""")
def run_evidence(spark, d):
    r = D.decided(RUNS.df(spark, d))
    i, none = F.col("id"), F.lit(None).cast("double")
    regions = F.array(F.struct(F.lit("text").alias("kind"), F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)]).alias("box"), F.lit("t").alias("text"), F.lit(0.5).alias("conf"), F.lit(0.1).alias("score"), F.lit("none").alias("category"), F.array().cast("array<string>").alias("hits"), F.lit("lexicon").alias("scored_by"))).cast(P.REGION)
    found = P.marked(regions, F.when(i % 4 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))), F.lit("c"), F.lit(100.0), F.lit(100.0))
    e = P.evidence(lexicon=F.col("text_score"), model=F.when(F.col("vision_calibrated"), F.col("vision_score")).otherwise(none), labels=F.lit(None).cast("map<string,double>"), framing=F.when(i % 3 == 0, "quoted_or_reported:meta"), before_framing=F.when(i % 3 == 0, F.col("text_score")), calibrated=F.col("vision_calibrated"), mode=F.col("mode"), escalated=F.col("escalated"), explanation=F.col("reason"), detections=found)
    return r.select("id", e.alias("e")).select("id", "e.lexicon_score", "e.model_score", "e.framing_reason", "e.score_before_framing", "e.vision_calibrated", "e.fusion_mode", "e.escalated", "e.explanation", F.size("e.detections").alias("detections"))


_two = lambda x: f"printf('%.2f', {r4(x, 2)})"
_outcome = "case id % 10 when 8 then 'skipped' when 9 then 'capture_failed' else 'analyzed' end"
_frame = "id % 4 <> 0"


@query(f"""with {DECIDED}, o as (select *, {_outcome} as outcome, {_frame} as had_frame from decided),
 s as (select id, outcome, unnest(['capture', 'audio', 'ocr', 'clip', 'vlm', 'stage1', 'stage2', 'decide']) as step, had_frame, has_ocr, has_asr, escalated, decision, text_score, vision_score, fused, risk, total_ms from o),
 t as (select id, step, case when outcome = 'skipped' then case step when 'capture' then 'ok' else 'skip' end when outcome = 'capture_failed' then case step when 'capture' then 'fail' else 'skip' end else
  case step when 'capture' then case when had_frame then case when id % 6 = 0 then 'warn' else 'ok' end when id % 3 = 0 then 'fail' else 'skip' end when 'audio' then case when has_asr then 'ok' else 'skip' end
  when 'ocr' then case when not has_ocr and not had_frame then 'skip' else 'ok' end when 'clip' then case when not had_frame then 'skip' when id % 17 = 0 then 'fail' else 'ok' end when 'vlm' then 'skip' when 'decide' then case when decision = 'hate' then 'warn' else 'ok' end else 'ok' end end as status,
  case when outcome = 'skipped' then case step when 'capture' then 'same frame as last tick' when 'audio' then 'silent' when 'ocr' then 'skipped — no change' when 'decide' then case when id % 3 = 0 then 'no screen' else 'duplicate frame, no new audio' end else '—' end
  when outcome = 'capture_failed' then case step when 'capture' then case when id % 3 = 0 then 'no screen' else '' end when 'ocr' then 'no input' when 'decide' then 'waiting for capture' else '—' end else
  case step when 'capture' then case when had_frame then '10×10' when id % 3 = 0 then 'no screen' else 'not a screen check' end when 'audio' then case when has_asr then '5 chars' else 'silent' end when 'ocr' then case when has_ocr then '4 chars' when had_frame then 'empty' else '—' end
  when 'clip' then 'clip' when 'vlm' then 'gate closed' when 'stage1' then 'text ' || {_two('text_score')} || ' · vision ' || {_two('vision_score')} when 'stage2' then 'fused ' || {_two('fused')} else case when decision = 'hate' then 'Alert' else 'Clear' end || ' · risk ' || {_two('risk')} end end as detail,
  case when outcome = 'skipped' or (outcome = 'capture_failed' and step <> 'capture') then 0.0 when step = 'stage1' or (step = 'ocr') then total_ms else 0.0 end as ms, outcome from s)
 select id, step, status, detail, cast(ms as double) as ms from t where outcome <> 'capture_failed' or step <> 'vlm'""")
def trace_detail(spark, d):
    i = F.col("id")
    r = D.decided(RUNS.df(spark, d)).withColumn("had_frame", i % 4 != 0).withColumn("outcome", F.when(i % 10 == 8, "skipped").when(i % 10 == 9, "capture_failed").otherwise("analyzed"))
    ms = F.create_map(F.lit("ocr_ms"), F.col("total_ms"), F.lit("stage1_ms"), F.col("total_ms"))
    steps = P.trace(
        outcome=F.col("outcome"), error=F.when(i % 3 == 0, "no screen"), had_frame=F.col("had_frame"), screen_ok=i % 6 != 0, size=F.lit("10×10"), ocr=F.when(F.col("has_ocr"), "read"), transcript=F.when(F.col("has_asr"), "heard"), notes=_noted(r), ms=ms,
        clip=F.lit("clip"), vlm=F.lit("lmstudio:small"), text_score=F.col("text_score"), vision_score=F.col("vision_score"), fused=F.col("fused"), decision=F.col("decision"), risk=F.col("risk"),
    )
    return r.select("id", F.explode(steps).alias("s")).select("id", "s.step", "s.status", "s.detail", "s.ms")


@query("select vec_id, case when vec_id % 3 = 0 then null else least(1.0, vec_id % 50/40.0) end as x1, case when vec_id % 3 = 0 then 1 else 2 end as n, case when vec_id % 3 = 0 then '' else left(repeat('caption ', 20), 120) end as text from embeddings")
def picture_regions(spark, d):
    v = F.col("vec_id")
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    text = F.array(F.struct(F.lit("text").alias("kind"), F.array(*[F.lit(0.0)] * 4).alias("box"), F.lit("").alias("text"), F.lit(0.0).alias("conf"), F.lit(0.0).alias("score"), F.lit("none").alias("category"), F.array().cast("array<string>").alias("hits"), F.lit("lexicon").alias("scored_by"))).cast(P.REGION)
    crop = F.when(v % 3 != 0, F.array(F.lit(-3.0), F.lit(0.0), (v % 50).cast("double"), F.lit(20.0)))
    m = P.marked(text, crop, F.repeat(F.lit("caption "), F.lit(20)), F.lit(40.0), F.lit(20.0))
    last = F.try_element_at(m, F.lit(-1))
    return e.select("vec_id", F.when(last["kind"] == "picture", F.get(last["box"], 2)).alias("x1"), F.size(m).alias("n"), last["text"].alias("text"))


@query("with l as (select user_id as device_id, max(event_id) as event_id from events where event_id % 3 = 0 group by 1), s as (select user_id as device_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1) select device_id, event_id as id, true as live from l union all select device_id, event_id, false from s where device_id not in (select device_id from l)")
def trace_fallback(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("id"), "ts")
    live = e.where("id % 3 = 0").groupBy("device_id").agg(F.max("id").alias("id")).withColumn("ts", F.lit(None).cast(e.schema["ts"].dataType)).withColumn("live", F.lit(True))
    return P.live_or_stored(live, e.withColumn("live", F.lit(False))).select("device_id", "id", "live")


# --- small operators ------------------------------------------------------------------------------------------------
@query(f"select doc_id, case doc_id % 5 when 0 then 'text ' || doc_id when 1 then '' when 2 then 'a b' when 3 then 'Sure! no colon here' else '\"quoted\"' end as reply, case when doc_id % 2 = 0 then 'happy' else 'neutral' end as emotion, doc_id % 2 = 0 or doc_id % 5 = 0 as agreed from documents")
def reply_texts(spark, d):
    i = F.col("doc_id")
    raw = F.when(i % 5 == 0, F.concat(F.lit("  Sure, here's the transcription: **text** - "), i.cast("string"))).when(i % 5 == 1, " None. ").when(i % 5 == 2, "Here is a list: `a`\n b").when(i % 5 == 3, "Sure! no colon here").otherwise('"quoted"')
    model = F.when(i % 2 == 0, F.concat(F.lit('```json\n{"reply": "r", "emotion": "happy", "agreed": true}\n```'))).when(i % 5 == 0, "yes, I will").otherwise("{broken")
    j = T.reply_json(model, ["yes"])
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.reply_text(raw).alias("reply"), j["emotion"].alias("emotion"), j["agreed"].alias("agreed"))


@query("""with p as (select p_partkey as pid, p_partkey % 6 as k from part), f as (select pid, k in (0, 1, 4) as is_browser, case when k in (1, 4) then 'Browser binary running from non-standard directory' when k in (2, 5) then 'Running from temporary/shared directory' end as reason from p)
 select pid, is_browser, reason, reason is not null as is_anomaly from f order by 4 desc, 2 desc, 1 limit 40""")
def process_list(spark, d):
    k = F.col("p_partkey") % 6
    name = F.when(k.isin(0, 1), "Google Chrome.exe").when(k == 4, "firefox").otherwise("tool.exe")
    exe = F.when(k == 0, "C:\\Program Files\\Google\\chrome.exe").when(k == 1, "C:\\Users\\x\\chrome.exe").when(k == 2, "C:\\Windows\\Temp\\tool.exe").when(k == 4, "/tmp/firefox").when(k == 5, "/home/public/tool").otherwise("")
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("pid"), name.alias("name"), exe.alias("exe"))
    return V.process_flags(rows).select("pid", "is_browser", "reason", "is_anomaly")


@query("select event_id, concat_ws(',', case when event_id % 3 = 0 then 'asr' end, case when event_id % 5 = 0 then 'clip' end) as degraded from events")
def degraded_backends(spark, d):
    i = F.col("event_id")
    status = F.create_map(F.lit("ocr"), F.lit("ok"), F.lit("asr"), F.when(i % 3 == 0, "failed").otherwise("ready"), F.lit("clip"), F.when(i % 5 != 0, "ok"))
    return spark.read.parquet(f"{d}/events.parquet").select(i, F.array_join(B.degraded(status), ",").alias("degraded"))


@query("select vec_id as id, label % 2 = 0 as meets_bar from embeddings where label % 2 = 0 and vec_id % 7 <> 0")
def probe_admission(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), (F.col("label") % 2 == 0).alias("meets_bar"), F.when(F.col("vec_id") % 7 != 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("coef"))
    return I.admitted(e).select("id", "meets_bar")


@query(f"select vec_id, 2 * len(embedding) as dim, {r4('list_sum(list_transform(embedding, lambda x: cast(x as double))) + case when vec_id % 3 = 0 then 0.0 else list_sum(list_transform(embedding, lambda x: cast(x as double))) end', 2)} as total from embeddings where vec_id % 5 <> 0")
def paired_vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    images = e.select("vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("image"))
    captions = e.where("vec_id % 3 <> 0").select("vec_id", F.col("embedding").alias("caption"))
    dim = len(e.select("embedding").first()[0])
    both = I.paired(images, captions, "vec_id", dim)
    return both.select("vec_id", F.size("both").alias("dim"), T.r4(F.aggregate("both", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"))


@query("select set, count(*) as cases, count_if(hate) as harmful from (select 'dev' as set, toxic = 1 as hate from documents join labels using (doc_id) union all select 'held_out', quality = 0 from documents join labels using (doc_id)) group by set")
def case_sets(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    both = docs.join(labels, "doc_id")
    one = lambda name, hate: both.select(F.col("doc_id").alias("case_id"), "text", hate.alias("hate"), F.lit("bullying").alias("category"), F.lit(name).alias("bucket"))
    cases = E.union_cases(one("dev", F.col("toxic") == 1), one("held_out", F.col("quality") == 0))
    return cases.groupBy(F.col("bucket").alias("set")).agg(F.count("*").alias("cases"), F.count_if("hate").alias("harmful"))


@query()
def probe_choice(spark, d):
    """Image, text or both, learned on two thirds of the vectors and judged on the others."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("y", F.col("label") == 0)
    half = F.size("embedding") / 2
    e = e.select("vec_id", "y", F.slice("embedding", F.lit(1), half.cast("int")).alias("image"), F.slice("embedding", half.cast("int") + 1, half.cast("int")).alias("text"))
    dev = F.crc32(F.col("vec_id").cast("string").cast("binary")) % 3 == 1
    return I.choose_probe(e.where(~dev), e.where(dev), "image", "text", "y").select("kind", "dim", "auc", "accuracy", "train_rows", "meets_bar", "auc_image_only", "auc_text_only", "auc_multimodal")


def _letters():
    """A stand-in for an embedder: how often a page holds each of four letters."""

    def embed(content: bytes) -> list[float]:
        if len(content) % 7 == 0:
            raise ValueError("unreadable")
        return [float(content.count(c)) for c in (b"a", b"e", b"i", b"o")]

    return embed


_count = lambda c: f"(octet_length(encode(html)) - octet_length(encode(replace(html, '{c}', ''))))"


@query(f"select page_id, 8 as dim, cast({' + '.join(_count(c) for c in 'aeio')} as double) as total from pages where octet_length(encode(html)) % 7 <> 0")
def embedded_pictures(spark, d):
    """Pages as pictures: vectors of binary content, unreadable ones left out, zero captions beside them."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").cast("binary").alias("content"))
    found = H.embedded(pages, "content", _letters, "image")
    captions = found.where("false").select("page_id", F.col("image").alias("caption"))
    both = I.paired(found.select("page_id", "image"), captions, "page_id", 4)
    return both.select("page_id", F.size("both").alias("dim"), F.aggregate("both", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


def _speaker():
    """A stand-in for a transcriber: lines are segments, short ones hardly speech."""

    def hear(content: bytes) -> list[dict]:
        return [{"text": t, "no_speech_prob": 0.9 if len(t) < 40 else 0.1, "avg_logprob": -0.5} for t in content.decode().split("\n")]

    return hear


@query("with s as (select conv_id, turn, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from conversations) select conv_id * 1000 + turn as clip, md5(string_agg(trim(t), ' ' order by i)) as transcript from s where length(t) >= 40 group by 1")
def transcribed_clips(spark, d):
    """Turns as sound: segments heard in binary content, joined to transcripts."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip"), F.col("text").cast("binary").alias("content"))
    found = V.transcripts(H.transcribed(c, "content", "clip", _speaker), order="place")
    return found.select("clip", F.md5("transcript").alias("transcript"))
