"""Queries over cases, dialogues and streams of checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import r4 as R
from ..operators import dashboard as B
from ..operators import decide as D
from ..operators import dialogue as G
from ..operators import evaluation as E
from ..operators import lexicon as L
from ..operators import scoring as S
from ..operators import ticks as K
from ..sources.scratch import stored
from .decision_queries import DECIDED
from .fixtures import FLAGS, RUNS, TICKS, TURNS, r4
from .registry import query
from .text_queries import SPLIT, _q, corroborated_sql, screened_sql


def _cases(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    c = docs.join(labels, "doc_id").select(F.col("doc_id").alias("case_id"), "text", (F.col("toxic") == 1).alias("hate"), F.col("lang").alias("bucket"), F.when(F.col("toxic") == 1, "bullying").otherwise("none").alias("category"))
    return c


CASES = "(select doc_id as case_id, text, toxic = 1 as hate, lang as bucket from documents join labels using (doc_id))"
MODEL = "cast((case_id*7919) % 1000 as double)/1000"
SCORED = f"{screened_sql(CASES)}, m as (select case_id, hate, bucket, hits, lexicon_score as lexicon, {MODEL} as model from scored), w as (select *, greatest(lexicon, model) as cascade from m), u as (unpivot (select case_id, hate, bucket, lexicon, model, cascade from w) on lexicon, model, cascade into name scorer value score)"


def _wide(spark, d):
    return L.screen(_cases(spark, d).drop("category")).selectExpr("case_id", "hate", "bucket", "hits", "lexicon_score as lexicon", f"{MODEL} as model")


def _scored(spark, d):
    w = _wide(spark, d)
    return E.scored(w, {"lexicon": F.col("lexicon"), "model": F.col("model"), "cascade": F.greatest("lexicon", "model")})


def metrics(hit: str) -> str:
    rate = lambda a, b: r4(f"case when {b} > 0 then cast({a} as double)/({b}) else 0.0 end")
    return f"tp, fp, tn, fn, {rate('(tp+tn)', '(tp+fp+tn+fn)')} as accuracy, {rate('tp', '(tp+fp)')} as precision, {rate('tp', '(tp+fn)')} as recall, {rate('2*tp', '(2*tp+fp+fn)')} as f1, {rate('fp', '(fp+tn)')} as fp_rate"


def counts(hit: str) -> str:
    return f"count_if({hit} and hate) as tp, count_if({hit} and not hate) as fp, count_if(not {hit} and not hate) as tn, count_if(not {hit} and hate) as fn"


# --- cases ----------------------------------------------------------------------------------------------------------
_flag = "case when threat then 'threat' when identity then 'hate_identity' when insult or severe then 'bullying' when not (doc_id % 13 = 0) then 'none' end"


_TEXT = "case when doc_id % 19 = 0 then chr(10) || '  ' when doc_id % 23 = 0 then null else text end"
_clean = f"trim(regexp_replace(coalesce({_TEXT}, ''), '\\s+', ' ', 'g'))"
_class = "case coalesce(class, 2) when 0 then 'hate_identity' when 2 then 'none' end"
_graded = "case when hatespeech >= 2 and violence >= 3 then 'threat' when hatespeech >= 2 then 'hate_identity' when hatespeech <= 0 and insult_rank < 3 then 'none' end"


def _adapted(category: str, most: int) -> str:
    named = " ".join(f"when '{k}' then '{v}'" for k, v in E.BUCKETS.items())
    return f"with f as (select doc_id, {_clean} as text, {category} as category from {FLAGS.sql} x) select doc_id as case_id, md5(text) as text, category, category <> 'none' as hate, case category {named} end as bucket from f where category is not null and text <> '' and length(text) <= {most}"


def _corpus(spark, d):
    return FLAGS.df(spark, d).withColumn("text", F.expr(_TEXT)).withColumn("toxic", F.col("doc_id") % 13 == 0)


@query(_adapted(_flag, 2000))
def adapter_flags(spark, d):
    return E.from_flags(_corpus(spark, d), "doc_id", "text", 2000).withColumn("text", F.md5("text"))


@query(_adapted(_class, 600))
def adapter_class(spark, d):
    return E.from_class(_corpus(spark, d), "doc_id", "text").withColumn("text", F.md5("text"))


@query(_adapted(_graded, 2000))
def adapter_ordinal(spark, d):
    return E.from_ordinal(_corpus(spark, d), "doc_id", "text", 2000).withColumn("text", F.md5("text"))


@query(f"with c as {CASES}, k as (select *, row_number() over (partition by hate order by case_id) as rank from c) select case_id, hate, cast(rank as int) as rank from k where rank <= 30")
def balanced_sample(spark, d):
    return E.balanced(_cases(spark, d), 60).select("case_id", "hate", "rank")


@query(f"with c as {CASES}, s as (select *, case when {SPLIT} < 60 then 'train' when {SPLIT} < 80 then 'dev' else 'test' end as split from c) select bucket, split, count(*) as usable, count_if(hate) as harmful, count_if(not hate) as benign from s group by grouping sets ((), (bucket), (split))")
def corpus_describe(spark, d):
    return E.described(_cases(spark, d))


@query(f"with c as {CASES} select case_id from c where {SPLIT} >= 60 and {SPLIT} < 80 order by {SPLIT}, sha1(text), case_id limit 25")
def split_limit(spark, d):
    return E.in_split(_cases(spark, d), "dev", limit=25).select("case_id")


# --- metrics --------------------------------------------------------------------------------------------------------
PERSONAS = {"child": 0.55, "preteen": 0.65, "teen": 0.75}
_p = "(values " + ", ".join(f"('{n}', {v})" for n, v in PERSONAS.items()) + ") p(persona, theta)"


@query(f"with {SCORED}, c as (select scorer, persona, {counts('score >= theta')} from u, {_p} group by scorer, persona) select scorer, persona, {metrics('')} from c")
def confusion_metrics(spark, d):
    return E.by_persona(_scored(spark, d), PERSONAS).drop("theta")


@query(f"with {SCORED}, c as (select scorer, bucket, {counts('score >= 0.55')} from u group by scorer, bucket) select scorer, bucket, {metrics('')} from c")
def bucket_metrics(spark, d):
    return E.confusion(_scored(spark, d), ["scorer", "bucket"], F.col("score") >= 0.55)


THETAS = [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


@query(f"with {SCORED}, c as (select scorer, theta, {counts('score >= theta')} from u, (select cast(unnest({THETAS}) as double) as theta) t group by scorer, theta) select scorer, theta, {metrics('')} from c")
def threshold_sweep(spark, d):
    return E.sweep(_scored(spark, d), THETAS)


@query(f"with {SCORED}, k as (select *, case when score >= 0.65 and not hate and bucket in ('en', 'de') then 'false_alarm' when score < 0.65 and hate then 'missed' end as kind from u), r as (select *, row_number() over (partition by scorer, kind order by abs(score - 0.65) desc, case_id) as rank from k where kind is not null) select scorer, kind, rank, case_id, score from r where rank <= 5")
def failure_list(spark, d):
    return E.failures(_scored(spark, d), 0.65, ["en", "de"])


@query(f"with k as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events) select event_type, {r4('median(value)')} as median, {r4('max(case when rn = cast(round_even(0.95*(n-1), 0) as bigint) + 1 then value end)')} as p95, max(n) as n from k group by event_type")
def latency_percentiles(spark, d):
    return E.latencies(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")


@query(f"with {SCORED}, e as (select case_id, hate, bucket, {r4('greatest(lexicon, model)')} as rule_max, {corroborated_sql('lexicon', 'model')} as rule_corroborated, {r4('(lexicon + model)/2')} as rule_mean from m), v as (unpivot e on rule_max, rule_corroborated, rule_mean into name scorer value score), c as (select scorer, {counts('score >= 0.65')} from v group by scorer) select scorer, {metrics('')} from c")
def ensemble_compare(spark, d):
    a, b = F.col("lexicon"), F.col("model")
    s = E.scored(_wide(spark, d), {"rule_max": R(F.greatest(a, b)), "rule_corroborated": S.corroborated(a, b), "rule_mean": R((a + b) / 2)})
    return E.confusion(s, ["scorer"], F.col("score") >= 0.65)


@query(f"with {SCORED} select rule, count_if(hate) as harmful, count_if(not hate) as benign from (select hate, unnest(hits) as rule from w) group by rule")
def rule_firing(spark, d):
    return E.rules_by_label(_wide(spark, d))


@query(f"with {SCORED} select case when lexicon >= 0.55 and model >= 0.55 then 'both' when lexicon >= 0.55 then 'rule' else 'model' end as cause, count(*) as n from w where not hate and cascade >= 0.55 group by 1")
def error_attribution(spark, d):
    return E.attribution(_wide(spark, d), 0.55)


@query(f"with {SCORED} select case when model >= 0.55 then 'false_alarm' else 'cleared' end as outcome, {r4('avg(case_id % 5)')} as mean, {r4('avg(case when case_id % 5 >= 3 then 1.0 else 0.0 end)')} as share, count(*) as n from w where not hate group by 1")
def ordinal_by_outcome(spark, d):
    w = _wide(spark, d).where(~F.col("hate")).withColumn("grade", F.col("case_id") % 5)
    return E.grades(w, "grade", F.when(F.col("model") >= 0.55, "false_alarm").otherwise("cleared"))


@query(f"with {DECIDED}, x as (select id, case id % 4 when 0 then 'hate' when 1 then 'not-hate' else 'any' end as expect from {RUNS.sql} q), r as (select case when id % 2 = 0 then id else id + 1000000000 end as id, decision from decided) select id, case when decision is null then 'skip' when expect = 'any' or expect = decision then 'ok' else 'MISMATCH' end as state from x left join r using (id)")
def expectation_check(spark, d):
    r = D.decided(RUNS.df(spark, d)).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000_000).alias("id"), "decision")
    x = RUNS.df(spark, d).selectExpr("id", "case id % 4 when 0 then 'hate' when 1 then 'not-hate' else 'any' end as expect")
    return E.expectations(r, x, "id")


@query()
def head_trained(spark, d):
    """A trained text head and its confusion: hashed words, inverse document frequency, logistic regression."""
    from ..operators.heads import train_text_head, word_counts

    cases = stored(word_counts(_cases(spark, d)).drop("text"))
    return E.confusion(train_text_head(cases)(cases).withColumn("scorer", F.lit("trained")), ["scorer"], F.col("score") >= 0.5)


# --- dialogue -------------------------------------------------------------------------------------------------------
_agree = "child_turn >= 3 and (contains(lower(child_response), 'yes') or contains(lower(child_response), 'this'))"
PHASED = f"s as (select *, {_agree} as agreed from {TURNS.sql} t), p as (select *, min(case when agreed then child_turn end) over (partition by session_id) as done_at from s), q as (select *, case when child_turn > done_at then 'Completed' when child_turn = 1 then 'Acknowledge' when child_turn = 2 then 'Reason' else 'Contract' end as phase, coalesce(child_turn >= done_at, false) as completed from p)"


def _phased(spark, d):
    return G.phases(TURNS.df(spark, d), ("yes", "this"))


@query(f"with {PHASED} select session_id, turn, phase, agreed, completed from q")
def dialogue_phases(spark, d):
    return _phased(spark, d).select("session_id", "turn", "phase", "agreed", "completed")


@query(f"with {PHASED}, w as (select session_id, turn, max(completed) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding) as b from q) select session_id, turn, case when b then {_q(G.CLOSING)} end as reply from w")
def dialogue_closed(spark, d):
    return G.closed(_phased(spark, d)).select("session_id", "turn", "reply")


@query("""with k as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations), r as (select * from k where back <= 8 and trim(text) <> ''), f as (select *, max(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as started from r),
 g as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as fresh from f where started = 1), h as (select *, sum(fresh) over (partition by conv_id order by turn) as grp from g),
 m as (select conv_id, grp, any_value(role) as role, string_agg(text, chr(10) order by turn) as content from h group by conv_id, grp) select conv_id, string_agg(role, ',' order by grp) as roles, md5(string_agg(content, '|' order by grp)) as content from m group by conv_id""")
def dialogue_context(spark, d):
    c = G.context(spark.read.parquet(f"{d}/conversations.parquet"))
    return c.select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("content"))


@query(f"select session_id, case when child_age <= 10 then 'Hi! Let us talk about ' || replace(threat_type, '_', ' ') || ' together.' else 'I would like to talk with you about ' || replace(threat_type, '_', ' ') || '.' end as opening, case when child_age <= 10 then 'warm' when child_age <= 13 then 'friendly' else 'calm' end as voice from {TURNS.sql} t where child_turn = 1")
def dialogue_opening(spark, d):
    t = TURNS.df(spark, d).where("child_turn = 1")
    return t.select("session_id", G.opening(F.col("child_age"), F.col("threat_type")).alias("opening"), G.voice(F.col("child_age")).alias("voice"))


_templates = " ".join(f"when phase = '{p}' and (child_age <= 10) = {y} and agreed = {a} then {_q(t)}" for p, y, a, t in G.TEMPLATES)


@query(f"with {PHASED} select session_id, turn, case {_templates} end as template from q")
def dialogue_templates(spark, d):
    return G.replies(_phased(spark, d)).select("session_id", "turn", "template")


# --- checks in sequence ---------------------------------------------------------------------------------------------
REPEATED = f"t as (select * from {TICKS.sql} x), l as (select *, last_value(case when not failed then {{'h': frame_hash}} end ignore nulls) over (partition by device_id order by seq rows between unbounded preceding and 1 preceding) as last from t), r as (select * exclude (last), not has_audio and coalesce(frame_hash = last.h, false) as skipped from l)"


@query(f"with {REPEATED} select device_id, seq, skipped from r")
def tick_duplicates(spark, d):
    return K.repeated(TICKS.df(spark, d)).select("device_id", "seq", "skipped")


STREAKS = f"{REPEATED}, i as (select *, sum(case when not skipped and not failed then 1 else 0 end) over (partition by device_id order by seq) as island from r), n as (select *, sum(case when not skipped and failed then 1 else 0 end) over (partition by device_id, island order by seq) as failures from i)"


@query(f"with {STREAKS} select device_id, seq, failures, least(15, 2*failures) as wait, failures >= 3 as degraded from n")
def failure_streaks(spark, d):
    return K.streaks(TICKS.df(spark, d)).select("device_id", "seq", "failures", "wait", "degraded")


@query(f"with {STREAKS}, {DECIDED}, f as (select device_id, arg_max(failures, seq) as failures from n group by device_id), z as (select device_id, arg_max(decision, ts) as decision from decided group by device_id) select device_id, case when failures >= 3 then 'degraded' when decision = 'hate' then 'threat' when decision is null then 'idle' else 'guarding' end as status from f left join z using (device_id)".replace("f as (select *, ", "ff as (select *, ").replace("from f),\n d as", "from ff),\n d as").replace("category <> 'none' as hit from f)", "category <> 'none' as hit from ff)"))
def status_rollup(spark, d):
    f = K.streaks(TICKS.df(spark, d)).groupBy("device_id").agg(F.max_by("failures", "seq").alias("failures"))
    z = D.decided(RUNS.df(spark, d)).groupBy("device_id").agg(F.max_by("decision", "ts").alias("decision"))
    return f.join(z, "device_id", "left").select("device_id", B.status(F.col("decision"), F.col("failures")).alias("status"))


@query("select event_id as seq, ts + interval 30 seconds as due, date_diff('second', lag(ts) over (partition by user_id order by ts), ts) as gap from (select event_id, user_id, date_trunc('second', ts) as ts from events)")
def tick_due(spark, d):
    t = TICKS.df(spark, d).withColumn("ts", F.date_trunc("second", "ts"))
    return K.due(t).select("seq", "due", "gap")


@query(f"with t as (select device_id, seq, title, lag(title) over (partition by device_id order by seq) as b, row_number() over (partition by device_id order by seq) as rn from {TICKS.sql} x) select device_id, seq, sum(case when rn > 1 and title is distinct from b then 1 else 0 end) over (partition by device_id order by seq) as segment from t")
def title_segments(spark, d):
    return K.segments(TICKS.df(spark, d)).select("device_id", "seq", "segment")


@query(f"with k as (select device_id, seq, row_number() over (partition by device_id order by seq desc) as rank from {TICKS.sql} x) select * from k where rank <= 30")
def trace_ring(spark, d):
    return K.newest(TICKS.df(spark, d)).select("device_id", "seq", "rank")


@query(f"""with {DECIDED}, e as (select device_id, ts, id, 0 as closed from decided where decision = 'hate' union all select device_id, ts, null, 1 from decided where has_asr),
 s as (select *, sum(closed) over (partition by device_id order by ts, closed desc, id) as opened from e), k as (select *, row_number() over (partition by device_id, opened order by ts, id) as rank from s where closed = 0)
 select device_id, id from k where rank = 1""")
def alert_edges(spark, d):
    r = D.decided(RUNS.df(spark, d))  # a run with sound stands for the close of an intercept
    return K.alert_edges(r, r.where("has_asr").select("device_id", "ts")).select("device_id", "id")
