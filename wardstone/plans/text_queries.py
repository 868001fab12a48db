"""Queries over text: scalars, rules, framing, windows, labels of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as L
from ..operators import scoring as S
from ..operators.decide import GATE
from ..operators.rules import ALL_RULES, BENIGN, FRAMING, GAMING, RULES, Rule, pattern_of
from .fixtures import FLAGS, HEADS, RUNS, r4
from .registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- the same rules in SQL ------------------------------------------------------------------------------------------
def base_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({text}), '013457@$', 'oieastas'), '[^a-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g'))"


def runs_sql(base: str, keep: int) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        base = f"regexp_replace({base}, '{c}{{3,}}', '{c * keep}', 'g')"
    return f"regexp_replace({base}, '''{{3,}}', '{chr(39) * 2 * keep}', 'g')"


def screened_sql(source: str, rules: list[Rule] = RULES) -> str:
    """CTEs up to ``scored``: id, text, base, in_game, hits, lexicon_score and category of ``source`` (id, text)."""
    hit = ",\n".join(f"case when regexp_matches(blob, {_q(pattern_of(r))})" + (" and not in_game" if r.gaming_sensitive else "") + f" then {_q(r.rule_id)} end" for r in rules)

    def listed(*keys: str, **want) -> str:
        return "[" + ", ".join(_q(r.rule_id) for r in rules if all(getattr(r, k) == v for k, v in want.items())) + "]"

    def some(**want) -> str:
        return f"len(list_filter(hits, lambda h: list_contains({listed(**want)}, h))) > 0"

    def family(band: str) -> str:
        first = f"list_filter(hits, lambda h: list_contains({listed(band=band, kind='family')}, h))[1]"
        return f"case {first} " + " ".join(f"when {_q(r.rule_id)} then {_q(r.category)}" for r in rules if r.band == band and r.kind == "family") + " end"

    n = {b: f"len(list_filter(hits, lambda h: list_contains({listed(band=b)}, h)))" for b in ("high", "mid")}
    severe = " ".join(f"when {some(band='high', kind='literal', category=c)} then '{c}'" for c in ("threat", "hate_identity", "sexual_harassment", "bullying"))
    return f"""
source as (select * from {source}),
based as (select *, {base_sql('coalesce(text, chr(32))')} as base from source),
viewed as (select *, regexp_matches(base, {_q(r'\b(?:' + '|'.join(GAMING) + r')\b')}) as in_game,
  base || chr(10) || chr(1) || chr(10) || {runs_sql('base', 2)} || chr(10) || chr(1) || chr(10) || {runs_sql('base', 1)} as blob from based),
found as (select * exclude (blob), regexp_matches(blob, {_q(r'\b(?:' + '|'.join(BENIGN) + r')\b')}) as benign, list_filter([{hit}], lambda h: h is not null) as hits from viewed),
scored as (select *, {r4(f"case when base = '' then 0.05 when {n['high']} > 0 then least(0.98, 0.88 + 0.03*({n['high']} - 1)) when {n['mid']} > 0 then least(0.80, 0.52 + 0.06*{n['mid']}) when benign then 0.18 else 0.08 end")} as lexicon_score,
  case {severe} when {some(band='high', kind='family')} then {family('high')} when {some(band='mid', kind='literal')} then 'bullying' when {some(band='mid', kind='family')} then {family('mid')} else 'none' end as category
  from found)"""


DOCS = "(select doc_id, text, lang from documents)"


# --- scalars --------------------------------------------------------------------------------------------------------
@query(f"select doc_id, {base_sql('text')} as base from documents")
def text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("base"))


@query(f"with b as (select doc_id, {base_sql('text')} as base from documents) select doc_id, md5({runs_sql('base', 2)}) as doubled, md5({runs_sql('base', 1)}) as single from b")
def text_views(spark, d):
    b = _docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("base"))
    return b.select("doc_id", F.md5(T.collapse_runs(F.col("base"), 2)).alias("doubled"), F.md5(T.collapse_runs(F.col("base"), 1)).alias("single"))


KEYS = "case doc_id % 6 when 0 then 'pwd: hunter2 ' when 1 then 'my_token=abc123 ' when 2 then '[sudo] password for me: x ' when 3 then 'Password for bob = y ' when 4 then 'api-key:K1 passwd = z ' else '' end"
_hidden = f"{KEYS} || text"
for _pattern, _shown in T.SECRETS:
    _hidden = f"regexp_replace({_hidden}, {_q(_pattern)}, {_q(_shown.replace('$1', chr(92) + '1'))}, 'g')"


@query(f"select doc_id, substr({_hidden}, 1, 200) as snippet, length({_hidden}) as n from documents")
def text_redact(spark, d):
    t = F.concat(F.expr(KEYS), F.col("text"))
    return _docs(spark, d).select("doc_id", T.redact(t).alias("snippet"), F.length(T.redact(t, 1 << 30)).alias("n"))


MARKED = "case doc_id % 4 when 0 then '{\"a\": 1}' when 1 then '```x {y} z``` # head [link] > ' when 2 then '**bold** _it_ ~x~ | ' else '' end || text"


@query(rf"with m as (select doc_id, {MARKED} as t from documents) select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)\{{.*?\}}', '', 'g'), '(?s)```.*?```', '', 'g'), '[*_#`~>\[\]]', ' ', 'g'), '\s+', ' ', 'g')) as spoken from m")
def speech_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.speech(F.expr(MARKED)).alias("spoken"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as cleaned, case when length(text) > 80 then substr(text, 1, 80) || '…' else text end as short, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as region_key from documents")
def corpus_clean(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.squeeze(t).alias("cleaned"), T.snippet(t, 80, "…").alias("short"), T.region_key(t).alias("region_key"))


SPLIT = r"(('0x' || substr(sha1(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 1, 8))::bigint % 100)"


@query(f"select doc_id, {SPLIT} as bucket, case when {SPLIT} < 60 then 'train' when {SPLIT} < 80 then 'dev' else 'test' end as split from documents")
def content_split(spark, d):
    return _docs(spark, d).select("doc_id", T.content_bucket(F.col("text")).alias("bucket"), T.content_split(F.col("text")).alias("split"))


@query("select doc_id, substr(sha256(text), 1, 16) as hash, sha1(source) as frame, replace(replace(lower(trim(source || ' Name-x')), ' ', '_'), '-', '_') as label, replace(lang || '_x', '_', ' ') as shown, 'data:image/jpeg;base64,' || base64(encode(source)) as url from documents")
def title_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.title_hash(F.col("text")).alias("hash"), T.frame_hash(F.col("source")).alias("frame"), T.label_key(F.concat("source", F.lit(" Name-x"))).alias("label"), T.display_label(F.concat("lang", F.lit("_x"))).alias("shown"), T.data_url(F.col("source").cast("binary")).alias("url"))


@query("select event_id, case when event_id % 10 = 0 then substr('no time at all here', 12, 5) else strftime(ts, '%I:%M %p') end as clock from events")
def clock_labels(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    stamp = F.when(F.col("event_id") % 10 == 0, "no time at all here").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("")))
    return e.select("event_id", T.clock(stamp).alias("clock"))


# --- rules ----------------------------------------------------------------------------------------------------------
@query(f"with {screened_sql('(select doc_id as id, text from documents)')} select id, array_to_string(hits, ',') as hits, in_game, lexicon_score, category from scored")
def lexicon_score(spark, d):
    out = L.screen(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return out.select("id", F.array_join("hits", ",").alias("hits"), "in_game", "lexicon_score", "category")


@query(f"with {screened_sql('(select doc_id as id, text from documents)', ALL_RULES)} select rule, count(*) as documents from (select unnest(hits) as rule from scored) group by rule")
def rule_hits(spark, d):
    out = L.screen(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), rules=ALL_RULES)
    return out.select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count("*").alias("documents"))


@query(f"with {screened_sql('(select doc_id as id, text, lang from documents)')} select lang, category, count(*) as n, count_if(in_game) as in_game from scored group by lang, category")
def rule_categories(spark, d):
    out = L.screen(_docs(spark, d).select("lang", "text"))
    return out.groupBy("lang", "category").agg(F.count("*").alias("n"), F.count_if("in_game").alias("in_game"))


SAID = {0: "", 1: "She said ", 2: "our lesson about ", 3: "According to him, ", 4: "it is never ok: ", 5: "how do I block this: "}
SAID_SQL = "case conv_id % 6 " + " ".join(f"when {k} then {_q(v)}" for k, v in SAID.items()) + " end || case when turn % 2 = 0 then 'you are an idiot and a moron ' else '' end || text"
_sql = {s: f"regexp_matches(text, {_q('(?i)' + FRAMING[s])})" for s in sorted(FRAMING)}
_signals = "list_filter([" + ", ".join(f"case when {c} then '{k}' end" for k, c in _sql.items()) + "], lambda s: s is not null)"


def _said(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.selectExpr("conv_id", "turn", f"{SAID_SQL} as text")


@query(f"with t as (select conv_id, turn, {SAID_SQL} as text from conversations) select conv_id, turn, array_to_string({_signals}, ',') as signals from t")
def framing_signals(spark, d):
    return _said(spark, d).select("conv_id", "turn", F.array_join(L.framing(F.col("text")), ",").alias("signals"))


@query(f"""with {screened_sql(f"(select conv_id, turn, {SAID_SQL} as text from conversations)")},
 s as (select *, {_signals} as signals from scored)
 select conv_id, turn, case when len(signals) > 0 and category <> 'sexual_harassment' and lexicon_score > 0.5 then 0.5 else lexicon_score end as score,
 case when len(signals) > 0 and category <> 'sexual_harassment' then 'quoted_or_reported:' || array_to_string(signals, '+') end as reason from s""")
def framing_cap(spark, d):
    s = L.screen(_said(spark, d)).withColumn("signals", L.framing(F.col("text")))
    score, reason = L.framed(F.col("lexicon_score"), F.col("category"), F.col("signals"))
    return s.select("conv_id", "turn", score.alias("score"), reason.alias("reason"))


# --- windows and labels ---------------------------------------------------------------------------------------------
WINDOWS = "select doc_id, i as window_no, substr(text, i*240 + 1, 300) as part, length(text) as n from documents, generate_series(0, 5000) t(i) where (i = 0 or i*240 < length(text) and length(text) > 300) and trim(substr(text, i*240 + 1, 300)) <> ''"


@query(f"with w as ({WINDOWS}), k as (select *, row_number() over (partition by doc_id order by window_no) as rn from w) select doc_id, window_no, part from k where rn <= 16")
def text_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(S.windows(F.col("text"))).alias("w")).select("doc_id", "w.window_no", F.col("w.part").alias("part"))


@query(f"with w as ({WINDOWS}), k as (select *, row_number() over (partition by doc_id order by window_no) as rn from w), s as (select doc_id, window_no, cast(length(part) - length(replace(part, 'e', '')) as double) / length(part) as score from k where rn <= 16) select doc_id, arg_max(window_no, score*1000000 - window_no) as window_no, max({r4('score')}) as score from s group by doc_id")
def window_best(spark, d):
    w = _docs(spark, d).select("doc_id", F.explode(S.windows(F.col("text"))).alias("w")).select("doc_id", "w.*")
    w = w.withColumn("score", (F.length("part") - F.length(F.replace("part", F.lit("e"), F.lit("")))).cast("double") / F.length("part"))
    return S.worst_window(w, "doc_id", "window_no", F.col("score")).select("doc_id", "window_no", T.r4(F.col("score")).alias("score"))


def _heads(spark, d):
    h = HEADS.df(spark, d)
    one = lambda n, c: F.struct(F.lit(n).alias("label"), c.cast("double").alias("score"))
    a = F.array(*[one(n, F.col(n)) for n in ("toxic", "threat", "insult")])
    b = F.array(one("hate", F.col("hate")), one("nothate", 1 - F.col("hate")))
    return h.select("vec_id", "label", a.alias("head_a"), b.alias("head_b"))


A, B = "greatest(toxic, threat, insult)", "hate"


@query(f"select vec_id, {r4(A)} as a, {r4(B)} as b, {r4('1 - (1 - hate)')} as b_safe from {HEADS.sql} h")
def label_scores(spark, d):
    h = _heads(spark, d)
    safe = F.filter("head_b", lambda x: x["label"] == "nothate")
    return h.select("vec_id", S.harm(F.col("head_a")).alias("a"), S.harm(F.col("head_b")).alias("b"), S.harm(safe).alias("b_safe"))


_first = "case when insult >= 0.5 and insult >= threat then 'bullying' when threat >= 0.5 then 'threat' when insult >= 0.5 then 'bullying' end"


@query(f"select vec_id, case when toxic >= 0.5 and toxic >= threat and toxic >= insult then coalesce(case when threat >= 0.5 and (threat >= insult or insult < 0.5) then 'threat' when insult >= 0.5 then 'bullying' end, 'bullying') when threat >= 0.5 and threat >= insult then 'threat' when insult >= 0.5 then 'bullying' when toxic >= 0.5 then 'bullying' end as category from {HEADS.sql} h")
def label_categories(spark, d):
    return _heads(spark, d).select("vec_id", S.label_category(F.col("head_a")).alias("category"))


@query(f"with u as (unpivot (select vec_id, toxic, threat, insult, hate from {HEADS.sql} h) on toxic, threat, insult, hate into name label value score), k as (select *, row_number() over (partition by vec_id order by score desc, case label when 'toxic' then 0 when 'threat' then 1 when 'insult' then 2 else 3 end) as rn from u) select vec_id, string_agg(label || '=' || printf('%.4f', {r4('score')}), ',' order by rn) as top from k where rn <= 3 group by vec_id")
def label_topk(spark, d):
    h = _heads(spark, d).select("vec_id", F.concat("head_a", F.slice("head_b", 1, 1)).alias("all"))
    return h.select("vec_id", F.array_join(F.transform(S.top_labels(F.col("all")), lambda x: F.concat(x["label"], F.lit("="), F.format_string("%.4f", x["score"]))), ",").alias("top"))


def corroborated_sql(a: str, b: str) -> str:
    return f"case when {a} is null then {b} when {b} is null then {a} when greatest({a}, {b}) >= 0.9 or least({a}, {b}) >= 0.5 then greatest({a}, {b}) else {r4(f'greatest({a}, {b})*0.7')} end"


@query(f"with s as (select vec_id, case when vec_id % 7 = 0 then null else {r4(A)} end as a, case when vec_id % 11 = 0 then null else {r4(B)} end as b from {HEADS.sql} h) select vec_id, {corroborated_sql('a', 'b')} as score from s")
def head_corroboration(spark, d):
    h = _heads(spark, d)
    a, b = F.when(F.col("vec_id") % 7 != 0, S.harm(F.col("head_a"))), F.when(F.col("vec_id") % 11 != 0, S.harm(F.col("head_b")))
    return h.select("vec_id", S.corroborated(a, b).alias("score"))


@query(f"""with l as (select vec_id, {r4('least(1.0, toxic)')} as lex, vec_id % 6 = 0 as in_game, vec_id % 4 = 0 as framed, case when vec_id % 3 = 0 then 'bullying' else 'none' end as lex_cat, vec_id % 3 = 0 as has_hits, {r4('hate')} as m0, case when threat >= 0.5 then 'threat' end as mcat0 from {HEADS.sql} h),
 m as (select *, case when lex >= 0.88 then null when in_game then least(m0, 0.3) else m0 end as m, case when lex >= 0.88 or in_game then null else mcat0 end as mcat from l),
 s as (select *, greatest(lex, coalesce(m, 0)) as s0, case when not has_hits and m >= 0.55 then coalesce(mcat, 'bullying') else lex_cat end as c0 from m),
 f as (select *, case when framed and c0 <> 'sexual_harassment' and s0 > 0.5 then 0.5 else s0 end as s1, framed and c0 <> 'sexual_harassment' and s0 > 0.5 as cut from s)
 select vec_id, m as model_score, s1 as score, case when cut and s1 < 0.55 then 'none' else c0 end as category, case when cut then s0 end as discounted_from from f""")
def score_combine(spark, d):
    h = _heads(spark, d)
    v = F.col("vec_id")
    get = lambda n: F.get(F.filter("head_a", lambda x: x["label"] == n), 0)["score"]
    return h.select("vec_id", S.combined(T.r4(get("toxic")), F.when(v % 3 == 0, "bullying").otherwise("none"), v % 3 == 0, v % 6 == 0, S.harm(F.col("head_b")), F.when(get("threat") >= 0.5, "threat"), v % 4 == 0).alias("r")).select("vec_id", "r.*")


CH = "select doc_id, i, substr(text, i*200 + 1, 400) as part, length(text) as n from documents, unnest(generate_series(0, length(text) // 200)) t(i) where i*200 < length(text) and length(text) > 400 and trim(substr(text, i*200 + 1, 400)) <> ''"


@query(f"""with c as ({CH}),
 {screened_sql("(select doc_id, part as text, 2 as stage from c union all select doc_id, text, 1 from documents)", ALL_RULES)}
 select doc_id, case when max(lexicon_score) filter (where stage = 1) >= 0.35 then max(lexicon_score) else max(lexicon_score) filter (where stage = 1) end as score from scored group by doc_id""")
def stage2_recheck(spark, d):
    """Only rows that escalate are cut into chunks, from beginning to end, and scored again; any other row has one part, which
    is null and scores less than the row itself."""
    docs = L.screen(_docs(spark, d).select("doc_id", "text"), rules=ALL_RULES).select("doc_id", "text", F.col("lexicon_score").alias("stage1"))
    part = F.when((F.col("stage1") >= GATE) & (F.length("text") > 400), S.chunks(F.col("text")))
    again = L.screen(docs.select("doc_id", "stage1", F.explode_outer(part).alias("part")), "part", ALL_RULES)
    return again.groupBy("doc_id").agg(F.max(F.greatest("stage1", "lexicon_score")).alias("score"))


_part_sql = lambda k: f"coalesce(string_agg(case when turn % 3 = {k} then text end, ' ' order by turn, text), '')"


@query(f"""with p as (select conv_id, {_part_sql(0)} as overlay, {_part_sql(1)} as ocr, {_part_sql(2)} as picture from conversations group by conv_id),
 r as (select conv_id, trim(overlay || ' ' || ocr) as read_text, picture from p)
 select conv_id, length(read_text) as read_chars, length(picture) as picture_chars, case when cast(length(picture) as double) > length(read_text) then 'picture' else 'read' end as channel, trim(read_text || picture) = '' as nothing,
 case when length(picture) > 0 then 'picture_text_read,' else '' end || case when length(read_text) > 0 then 'ocr_primary' else 'image_without_readable_text' end as notes from r""")
def channel_assembly(spark, d):
    """Turns of a conversation stand for what is overlaid, read and seen."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 3 == k, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    p = c.groupBy("conv_id").agg(part(0).alias("overlay"), part(1).alias("ocr"), part(2).alias("picture"))
    p = p.withColumn("read_text", S.assembled(F.col("overlay"), F.col("ocr")))
    read, shown = F.length("read_text"), F.length("picture")
    return p.select("conv_id", read.alias("read_chars"), shown.alias("picture_chars"), S.channel(read, shown).alias("channel"), S.nothing(F.col("read_text"), F.col("picture")).alias("nothing"), F.array_join(S.notes(picture_text_read=shown > 0, ocr_primary=read > 0, image_without_readable_text=read == 0), ",").alias("notes"))
