"""Queries over the table of runs and the dashboard's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import r4 as R
from ..operators import dashboard as B
from ..operators import decide as D
from ..operators import store as S
from ..operators.rules import MOOD, THREAT_TYPE
from .decision_queries import DECIDED, T2
from .fixtures import NOW, RUNS, TICKS, TURNS, r4
from .registry import query
from .text_queries import _q


def _runs(spark, d):
    return D.decided(RUNS.df(spark, d)).withColumnRenamed("risk", "score")


DEC = DECIDED + ", runs as (select * exclude (risk), risk as score from decided)"


@query(f"with {DEC} select id, ts, decision, score from runs order by ts desc, id desc limit 200")
def runs_recent(spark, d):
    return S.newest(_runs(spark, d), 500).select("id", "ts", "decision", "score")


@query(f"with {DEC} select child_age, max(ts) as ts, arg_max(id, ts) as id, arg_max(decision, ts) as decision from runs group by child_age")
def runs_latest(spark, d):
    r = _runs(spark, d).select("child_age", "ts", "id", "decision")
    return S.latest(r, "child_age")


@query(f"with {DEC} select id, decision, category, score from runs where id = 77")
def run_by_id(spark, d):
    return _runs(spark, d).where("id = 77").select("id", "decision", "category", "score")


@query(f"with {DEC} select count(*) as total, count_if(decision = 'hate') as hate, count_if(decision <> 'hate') as not_hate from runs")
def run_stats(spark, d):
    hate = F.col("decision") == "hate"
    return _runs(spark, d).agg(F.count("*").alias("total"), F.count_if(hate).alias("hate"), F.count_if(~hate).alias("not_hate"))


@query(f"with {DEC} select child_age, count(*) as n from runs where decision = 'hate' group by child_age")
def harm_by_age(spark, d):
    return _runs(spark, d).where("decision = 'hate'").groupBy("child_age").agg(F.count("*").alias("n"))


_thumb = f"with r as (select id, ts, app_exe as thumb from {RUNS.sql} x)"


@query(f"{_thumb}, k as (select *, row_number() over (order by ts desc, id desc) as rn from r where ts >= timestamp '{NOW}' - interval 30 days) select id, case when ts >= timestamp '{NOW}' - interval 24 hours then thumb end as thumb from k where rn <= 5000")
def retention_prune(spark, d):
    r = RUNS.df(spark, d).select("id", "ts", F.col("app_exe").alias("thumb"))
    return S.retained(r, F.to_timestamp(F.lit(NOW))).select("id", "thumb")


@query(f"{_thumb} select count_if(ts >= timestamp '{NOW}' - interval 10 days and ts < timestamp '{NOW}' - interval 24 hours) as thumbs, count_if(ts < timestamp '{NOW}' - interval 10 days) as expired, greatest(0, count_if(ts >= timestamp '{NOW}' - interval 10 days) - 1000) as over_cap from r")
def retention_report(spark, d):
    r = RUNS.df(spark, d).select("id", "ts", F.col("app_exe").alias("thumb"))
    return S.retention_report(r, F.to_timestamp(F.lit(NOW)), days=10, rows=1000)


@query(f"with {DEC} select id, decision, app_exe as mark from runs where decision = 'hate'")
def list_view(spark, d):
    r = _runs(spark, d).where("decision = 'hate'").withColumn("evidence", F.struct(F.col("app_exe").alias("mark"), F.array("score").alias("detections"))).withColumn("thumb_jpeg", F.lit(None).cast("binary"))
    return S.list_view(r).select("id", "decision", "evidence.mark")


_json = """case id % 4 when 0 then '{"image": 0.2, "audio": 0.04}' when 1 then '{"audio": 0.3}' when 2 then 'not json' end"""
_envelope = """case id % 5 when 0 then '{"payload": {"persona_threshold": 0.42}}' when 1 then '{"payload": {"persona_threshold": "0"}}' when 2 then '{"threshold": 0.3}' when 3 then 'not json' end"""
_stored = f"""select cast(id as varchar) as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, case when id % 9 = 0 then null else child_age end as child_age, case when id % 7 = 0 then '' else decision end as decision, case when id % 8 <> 0 then score end as score,
 case when id % 5 = 0 then null else category end as category, case when has_ocr then 'read' else '  ' end as ocr_snippet, case when has_asr then 'heard' end as transcript_snippet, {_json} as modalities_json, case when id % 6 = 0 then '' else app_exe end as app_exe, {_envelope} as envelope_json from runs"""
_flag = {"ocr": "trim(coalesce(ocr_snippet, '')) <> ''", "asr": "(trim(coalesce(transcript_snippet, '')) <> '' or coalesce(id::bigint % 4 = 1, false))", "vision": "id::bigint % 4 = 0"}


def _stored_runs(spark, d):
    i = F.col("id")
    r = _runs(spark, d)
    return r.select(
        i.cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.when(i % 9 != 0, F.col("child_age")).alias("child_age"), F.when(i % 7 == 0, "").otherwise(F.col("decision")).alias("decision"), F.when(i % 8 != 0, F.col("score")).alias("score"),
        F.when(i % 5 != 0, F.col("category")).alias("category"), F.when(F.col("has_ocr"), "read").otherwise("  ").alias("ocr_snippet"), F.when(F.col("has_asr"), "heard").alias("transcript_snippet"), F.expr(_json).alias("modalities_json"), F.when(i % 6 == 0, "").otherwise(F.col("app_exe")).alias("app_exe"), F.expr(_envelope).alias("envelope_json"),
    )


@query(f"""with {DEC}, s as ({_stored}) select id, ts as timestamp, strftime(cast(ts as timestamp), '%I:%M %p') as time_str, coalesce(child_age, 10) as child_age, case when decision = '' then 'not-hate' else decision end as decision, coalesce(score, 0.0) as risk_score,
 case when decision = 'hate' and coalesce(category, 'none') = 'none' then 'hate_identity' else coalesce(category, 'none') end as category, ocr_snippet as ocr_text, coalesce(transcript_snippet, '') as transcript, '' as overlay_text,
 {', '.join(f'{v} as {k}' for k, v in _flag.items())}, case when app_exe = '' then 'unknown' else app_exe end as app_exe, case when app_exe = '' then 'unknown' else app_exe end as session_hint, '' as child_safe_summary, '' as recommended_action,
 cast(case when id::bigint % 5 = 0 then 0.42 else {T2.replace('child_age', 'coalesce(child_age, 10)')} end as double) as persona_threshold from s""")
def dashboard_rows(spark, d):
    return S.dashboard_row(_stored_runs(spark, d)).select("*", "source.ocr", "source.asr", "source.vision").drop("source")


@query(f"with {DEC}, s as ({_stored}) select id, {', '.join(f'{v} as {k}' for k, v in _flag.items())}, false as overlay from s")
def source_flags(spark, d):
    r = _stored_runs(spark, d)
    share = S.decoded(F.col("modalities_json"), "image double, audio double", F.struct(F.lit(0.0).alias("image"), F.lit(0.0).alias("audio")))
    return r.select("id", S.source_flags(F.col("ocr_snippet"), F.col("transcript_snippet"), share["image"], share["audio"]).alias("f")).select("id", "f.*")


@query(f"select id, cast(case when id % 5 = 0 then 0.42 else {T2} end as double) as threshold from {RUNS.sql} x")
def effective_threshold(spark, d):
    return RUNS.df(spark, d).select("id", S.effective_threshold(F.expr(_envelope), F.col("child_age")).alias("threshold"))


@query(f"""with {DEC}, q as (select event_id as request, case event_id % 3 when 0 then null when 1 then event_id else event_id + 1000000000 end as run_id from events),
 last as (select arg_max(id, ts) as id from runs), j as (select q.request, r.* from q left join runs r on r.id = coalesce(q.run_id, (select id from last)))
 select request, id as found, coalesce(decision = 'hate', false) as verdict, case when decision = 'hate' then score else 0.0 end as harm, case when decision = 'hate' then category else 'none' end as category from j""")
def verdicts(spark, d):
    q = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id as request", "case event_id % 3 when 0 then null when 1 then event_id else event_id + 1000000000 end as run_id")
    return S.verdicts(q, _runs(spark, d))


_weapons = "cast((id*31) % 100 as double)/100"
_named = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in THREAT_TYPE.items()) + " else 'hate_speech' end"


@query(f"""with {DEC}, t as (select *, decision = 'hate' and id % 2 = 0 as asked from runs), k as (select *, case when greatest(text_score, vision_score/2) > 0.8 then 1 when vision_score > 0.8 then 2 when asked or fused*0.9 > 0.8 then 3 when {_weapons} > 0.75 then 4 else 5 end as k from t)
 select id, case k when 1 then 'adult_content' when 2 then 'violence' when 3 then case when asked then {_named} else 'hate_speech' end when 4 then 'weapons' else 'none' end as threat,
 cast(case k when 1 then greatest(text_score, vision_score/2) when 2 then vision_score when 3 then case when asked then score else fused*0.9 end when 4 then {_weapons} else 0.0 end as double) as risk from k""")
def trigger_class(spark, d):
    asked = (F.col("decision") == "hate") & (F.col("id") % 2 == 0)
    t = S.trigger(nsfw=F.col("text_score"), adult=F.col("vision_score") / 2, violence=F.col("vision_score"), weapons=F.expr(_weapons), hate=F.col("fused") * 0.9, verdict=asked, verdict_category=F.col("category"), verdict_score=F.col("score"))
    return _runs(spark, d).select("id", t.alias("t")).select("id", "t.*")


@query(f"with r as (select device_id, id from {RUNS.sql} x), live as (select * from r), old as (select device_id + 5 as device_id, id from r) select device_id, count(*) as n from (select * from live union all select * from old where device_id not in (select device_id from live)) group by device_id")
def source_of_truth(spark, d):
    r = RUNS.df(spark, d).select("device_id", "id")
    return S.preferred(r, r.withColumn("device_id", F.col("device_id") + 5), "device_id").groupBy("device_id").agg(F.count("*").alias("n"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k from events")
def json_columns(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", S.decoded(F.col("props"), "k bigint", F.struct(F.lit(-1).cast("long").alias("k")))["k"].alias("k"))


# --- dashboard ------------------------------------------------------------------------------------------------------
_minutes = f"select child_age, cast(floor(sum(total_ms)/60000) as bigint) as minutes from {RUNS.sql} m group by child_age"


@query(f"""with {DECIDED}, u as (select child_age, 1 as s, 0 as h, 0 as m from (select distinct session_id, child_age from {TURNS.sql} t) union all select child_age, 0, 1, 0 from decided where decision = 'hate' union all select child_age, 0, 0, minutes from ({_minutes}))
 select child_age, cast(sum(s) as bigint) as content_intercepted, cast(sum(h) as bigint) as high_severity_alerts, cast(sum(h) as bigint) as hate_speech_detected, cast(sum(m) as bigint) as screen_time_minutes from u group by grouping sets ((child_age), ())""")
def summary_cards(spark, d):
    runs = RUNS.df(spark, d)
    minutes = runs.groupBy("child_age").agg(F.floor(F.sum("total_ms") / 60000).alias("minutes"))
    return B.cards(D.decided(runs), TURNS.df(spark, d).select("session_id", "child_age").distinct(), minutes)


TURN = f"(select *, timestamp '2024-01-01' + to_hours(cast(session_id*5 as int)) as ts from {TURNS.sql} t)"


def _turns(spark, d):
    return TURNS.df(spark, d).withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(session_id*5 as int), 0, 0)"))


@query(f"with t as (select session_id, turn, child_response, contains(child_response, 'yes') as agreed, child_turn >= 3 as completed from {TURNS.sql} x) select session_id, count(*) as turns, arg_max(completed, turn) as completed, arg_max(agreed, turn) as agreed, md5(string_agg(child_response, '|' order by turn)) as texts from t group by session_id")
def session_rollup(spark, d):
    t = TURNS.df(spark, d)
    t = t.union(t.withColumn("session_id", F.col("session_id") + 1_000_000_000))  # turns of sessions that nobody knows
    t = t.withColumn("agreed", F.contains("child_response", F.lit("yes"))).withColumn("completed", F.col("child_turn") >= 3)
    s = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session_id")).distinct()
    r = B.rolled_up(t, s)
    return r.select("session_id", F.size("turns").cast("long").alias("turns"), "completed", "agreed", F.md5(F.array_join(F.transform("turns", lambda x: x["child_response"]), "|")).alias("texts"))


@query(f"with s as (select session_id, max(ts) as ts, arg_max(threat_type, turn) as threat_type from {TURN} t group by session_id) select * from s order by ts desc, session_id desc limit 50")
def session_cap(spark, d):
    return B.newest_sessions(_turns(spark, d).select("session_id", "ts", "threat_type"))


_mood = "case lower(trim(raw_emotion)) " + " ".join(f"when '{k}' then '{v}'" for k, v in MOOD.items()) + " else 'Neutral' end"
_odd = "case turn % 6 when 0 then ' Positive ' when 1 then 'NEGATIVE' when 2 then '' else raw_emotion end"


@query(f"with t as (select child_age, {_odd} as raw_emotion from {TURNS.sql} x) select child_age, {_mood} as mood, count(*) as n from t group by 1, 2")
def emotion_map(spark, d):
    t = TURNS.df(spark, d).withColumn("raw_emotion", F.expr(_odd))
    return t.groupBy("child_age", B.mood(F.col("raw_emotion")).alias("mood")).agg(F.count("*").alias("n"))


_kind = "case when contains(t, 'violence') then 'violence' when contains(t, 'hate') then 'hate' when contains(t, 'adult') then 'adult' when contains(t, 'controversial') then 'controversial' else 'other' end"
_threats = f"with {DECIDED}, u as (select category as t from decided where decision = 'hate' union all select distinct_type from (select session_id, any_value(threat_type) as distinct_type from {TURNS.sql} x group by session_id)), c as (select {_kind} as kind, count(*) as n from u group by 1)"


def _kinds(spark, d):
    r = D.decided(RUNS.df(spark, d)).where("decision = 'hate'").select(F.col("category").alias("t"))
    s = TURNS.df(spark, d).groupBy("session_id").agg(F.any_value("threat_type").alias("t")).select("t")
    return r.union(s).groupBy(B.threat_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"{_threats} select * from c")
def threat_breakdown(spark, d):
    return _kinds(spark, d)


@query(f"{_threats}, p as (select kind, n, cast(round(n*100.0/sum(n) over ()) as bigint) as percent from c) select *, coalesce(sum(percent) over (order by n desc, kind rows between unbounded preceding and 1 preceding), 0) as \"offset\" from p")
def threat_share(spark, d):
    return B.with_share(_kinds(spark, d), "n", [F.desc("n"), F.col("kind")])


_some = "case when turn % 4 = 0 or session_id % 8 = 3 then null else raw_emotion end"


@query(f"with t as (select child_age, {_some} as e from {TURNS.sql} x) select child_age, case when count(e) = 0 then 0.35 else greatest(0.1, least(0.95, {r4('avg(case when e is not null then (e in (' + ', '.join(_q(e) for e in B.NEGATIVE) + '))::int end)', 2)})) end as index from t group by child_age")
def negative_index(spark, d):
    return B.negative_index(TURNS.df(spark, d).withColumn("raw_emotion", F.expr(_some)), "child_age", default=0.35)


@query(f"with l as (select session_id, max(ts) as ts, arg_max(raw_emotion, turn) as emotion from {TURN} t where session_id % 3 <> 0 group by 1), k as (select date_trunc('day', ts) as day, session_id, emotion, row_number() over (partition by date_trunc('day', ts) order by ts desc, session_id desc) as rn from l) select cast(day as timestamp) as day, session_id, emotion from k where rn = 1 order by day desc limit 7")
def emotion_trend(spark, d):
    t = _turns(spark, d)
    s = t.groupBy("session_id").agg(F.max("ts").alias("ts")).withColumn("completed", F.col("session_id") % 3 != 0)
    return B.emotion_trend(t, s)


@query(f"with {DECIDED}, a as (select child_age, ts, id as key, 'run' as kind, risk as score from decided where decision = 'hate' union all select child_age, max(ts), session_id, 'session', 0.95 from {TURN} t group by child_age, session_id), k as (select *, case when score > 0.9 then 'High' else 'Medium' end as severity, row_number() over (partition by child_age order by ts desc, kind, key desc) as rank from a) select * from k where rank <= 5")
def recent_alerts(spark, d):
    r = D.decided(RUNS.df(spark, d)).where("decision = 'hate'").select("child_age", "ts", F.col("id").alias("key"), F.lit("run").alias("kind"), F.col("risk").alias("score"))
    s = _turns(spark, d).groupBy("child_age", F.col("session_id").alias("key")).agg(F.max("ts").alias("ts")).select("child_age", "ts", "key", F.lit("session").alias("kind"), F.lit(0.95).alias("score"))
    return B.alerts(r, s)


_impact = "case e " + " ".join(f"when '{e}' then '{k}'" for k, v in B.IMPACTS.items() for e in v) + " else 'Neutral' end"


@query(f"""with {DECIDED}, s as (select session_id, any_value(child_age) as child_age, max(ts) as ts, any_value(threat_type) as threat_type, arg_max(raw_emotion, turn) as e, max(child_turn) as n from {TURN} x group by session_id),
 c as (select *, case when id % 2 = 0 then '' when id % 3 = 0 then repeat('long ', 30) else app_exe end as shown from decided where decision = 'hate'),
 u as (select child_age, ts, cast(id as varchar) as key, 'Hate Speech Flagged' as title, 'Analyst detected category "' || category || '" (risk score ' || printf('%.2f', {r4('risk', 2)}) || '). Content flagged: "' || case when shown = '' then 'N/A' when length(shown) > 80 then left(shown, 80) || '...' else shown end || '"' as details, 'Negative' as impact from c
 union all select child_age, ts, 'xai-' || session_id, 'Socratic Safety Intercept', 'Socratic agent intercepted a "' || threat_type || '" threat. Session status: "' || case when session_id % 3 <> 0 then 'Completed' else 'Active Dialog' end || '" in phase "' || case when n = 1 then 'Acknowledge' else 'Contract' end || '". Child response emotional index: "' || e || '".', {_impact} from s),
 k as (select *, row_number() over (partition by child_age order by ts desc, key) as rank from u) select * from k where rank <= 3""")
def xai_feed(spark, d):
    i = F.col("id")
    shown = F.when(i % 2 == 0, "").when(i % 3 == 0, F.repeat(F.lit("long "), F.lit(30))).otherwise(F.col("app_exe"))
    r = D.decided(RUNS.df(spark, d)).withColumn("overlay_text", F.lit("")).withColumn("ocr_text", shown).withColumn("transcript", F.lit(None).cast("string"))
    s = _turns(spark, d).groupBy("session_id").agg(F.any_value("child_age").alias("child_age"), F.max("ts").alias("ts"), F.any_value("threat_type").alias("threat_type"), F.max_by("raw_emotion", "turn").alias("emotion"), F.max("child_turn").alias("n"))
    s = s.withColumn("completed", F.col("session_id") % 3 != 0).withColumn("phase", F.when(F.col("n") > 1, "Contract"))
    return B.feed(r, s)


_has = lambda *e: f"bool_or(raw_emotion in ({', '.join(_q(x) for x in e)}))"


@query(f"select child_age, child_age <= 10 as young, {_has('frustrated', 'defensive')} as gentle, not {_has('frustrated', 'defensive')} and {_has('resolved', 'compliant')} as praise from {TURNS.sql} t where child_age % 2 = 0 or raw_emotion not in ('frustrated', 'defensive') group by child_age")
def recommendations(spark, d):
    return B.recommendations(TURNS.df(spark, d).where("child_age % 2 = 0 or raw_emotion not in ('frustrated', 'defensive')"))


@query(f"with {DECIDED}, l as (select app_exe, max(ts) as ts, arg_max(id, ts) as id, arg_max(decision, ts) as decision from decided group by app_exe) select * from l order by ts desc, id desc limit 8")
def recent_apps(spark, d):
    return B.recent_apps(D.decided(RUNS.df(spark, d)))


@query(f"with t as (select unnest(['ocr', 'stage1']) as stage, unnest([total_ms*0.5, total_ms*0.1]) as ms from {RUNS.sql} r) select stage, {r4('quantile_cont(ms, 0.5)', 3)} as p50, {r4('quantile_cont(ms, 0.9)', 3)} as p90, {r4('max(ms)', 3)} as worst, count(*) as n from t group by stage")
def latency_profile(spark, d):
    t = RUNS.df(spark, d).select(F.explode(F.create_map(F.lit("ocr"), F.col("total_ms") * 0.5, F.lit("stage1"), F.col("total_ms") * 0.1)).alias("stage", "ms"))
    return B.latency_profile(t)


@query(f"with t as (select session_id, turn, case when turn % 4 = 0 then null else raw_emotion end as emotion from {TURNS.sql} x) select session_id, arg_max(emotion, turn) filter (where emotion is not null) as emotion from t group by session_id")
def last_emotion(spark, d):
    return B.last_emotion(TURNS.df(spark, d).withColumn("emotion", F.when(F.col("turn") % 4 != 0, F.col("raw_emotion"))))
