"""Operators that the tables can't show: small fixtures with results worked out by hand, and grids."""

import itertools
import json

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardstone.functions import batches
from wardstone.functions import text as T
from wardstone.operators import dashboard, decide, evaluation, evidence, heads, lexicon, rule_index, rules, scoring, store, table, vision
from wardstone.operators.rules import RULES
from wardstone.plans import registry, text_queries
from wardstone.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_despace(spark):
    for given, want in [("y o u are", "you are"), ("a b", "a b"), ("say i d i o t now", "say idiot now"), ("", "")]:
        assert one(spark, T.despace(F.lit(given))) == want


def test_collapse(spark):
    assert one(spark, T.collapse_runs(F.lit("looooser good"), 2)) == "looser good"
    assert one(spark, T.collapse_runs(F.lit("looooser good"), 1)) == "loser good"


def test_despaced_view_adds_no_hit_by_accident(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = T.normalize(F.col("text"))
    plain = F.concat_ws(T.VIEW_BREAK, base, T.collapse_runs(base, 2), T.collapse_runs(base, 1))
    find = rule_index.matcher(RULES)
    assert docs.select(find(T.view_text(base))["hits"].alias("a"), find(plain)["hits"].alias("b")).where("not a <=> b").count() == 0


def test_spelled_out_words_hit(spark):
    cases = {"an i d i o t": (["bullying/idiot"], 0.58), "an IDIOOOT": (["bullying/idiot"], 0.58), "": ([], 0.05), "gg ez": ([], 0.18), "nice game": ([], 0.08), "w4tch y0ur b@ck": (["threat/watch-your-back"], 0.88), "watchyourback": (["threat/watch-your-back"], 0.88), "idiots": ([], 0.08), "you are such an idiot": (["bullying/idiot", "bullying/aimed"], 0.88), "idiot idiot idiot": (["bullying/idiot", "bullying/flooded"], 0.88)}
    rows = lexicon.screen(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r["text"]: (r["hits"], r["lexicon_score"]) for r in rows} == cases
    assert {r["text"]: r["category"] for r in rows}["watchyourback"] == "threat"


def test_gaming_rules_rest_in_games(spark):
    df = spark.createDataFrame([("i will wreck you",), ("i will wreck you in this match",), ("trash bot",), (None,)], "text string")
    got = [(r["hits"], r["in_game"], r["lexicon_score"]) for r in lexicon.screen(df).collect()]
    assert got == [(["threat/vowed"], False, 0.58), ([], True, 0.08), (["bullying/trash"], False, 0.58), ([], False, 0.05)]


def test_rule_hits_tries_every_rule(spark, tmp_path):
    """The phrases that the corpus doesn't mark are tried too, and found by the words that they need."""
    said = {
        "I hope you die": "threat/hope-you-die", "end your life": "threat/end-your-life", "you are dead meat": "threat/you-are-dead-meat", "they are not even human": "hate_identity/not-even-human", "wipe them all out": "hate_identity/wipe-them-all-out",
        "a naked picture": "sexual_harassment/naked-picture", "take your clothes off": "sexual_harassment/take-your-clothes-off", "everybody hates you": "bullying/everybody-hates-you", "the world is better without you": "bullying/the-world-is-better-without-you", "disgusting worthless": "bullying/disgusting-worthless",
        "I'll really hurt you": "threat/announced-harm", "wait outside for you": "threat/warning", "you look so dumb": "bullying/put-down", "go away for ever": "bullying/shut-out", "send me a picture of you": "sexual/asks-for-pictures", "refugees are a plague": "identity/called-animals", "these people ruin everything": "identity/shut-out",
    }
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["rule"]: r["documents"] for r in text_queries.rule_hits(spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys(said.values(), 1), "bullying/disgusting": 1, "bullying/worthless": 1}
    assert set(said.values()) == {r.rule_id for r in rules.PHRASES} and len({r.rule_id for r in rules.ALL_RULES}) == len(rules.ALL_RULES)


def test_signals_of_reported_speech(spark):
    cases = {"this is never okay": ["condemnation"], "Stop bullying": ["condemnation"], "our essay about hate": ["meta"], "She said it": ["attribution"], "how do I report him, according to mum": ["attribution", "meta"], "don't tell a teacher": [], "you are trash": []}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", lexicon.framing(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == cases


def test_reported_speech_is_capped_and_always_explained(spark):
    rows = [(0.9, "threat", ["meta"]), (0.3, "none", ["attribution", "meta"]), (0.9, "sexual_harassment", ["meta"]), (0.9, "threat", [])]
    df = spark.createDataFrame(rows, "score double, category string, signals array<string>")
    got = [tuple(r) for r in df.select(*lexicon.framed(F.col("score"), F.col("category"), F.col("signals"))).collect()]
    assert got == [(0.5, "quoted_or_reported:meta"), (0.3, "quoted_or_reported:attribution+meta"), (0.9, None), (0.9, None)]


def many_rules(n):
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 5)))
    out = [rules.Rule(f"l{i}", "literal", " ".join(word() for _ in range(draw.randint(1, 3))), draw.choice(["high", "mid"]), draw.choice(rules.CATEGORIES[:4]), draw.random() < 0.2) for i in range(n)]
    for i in range(20):
        a, b = word(), word()
        out.append(rules.Rule(f"f{i}", "family", f"{a} (?:[a-z0-9']+ ){{0,2}}{b}", "mid", "threat", False, (a,) if i % 4 else ()))
    return out


def test_indexed_rules_hit_as_all_patterns_do(spark):
    import random
    import re

    own, draw = many_rules(400), random.Random(4)
    words = [w for r in own for w in r.pattern.split() if w.isalpha()] + ["match", "it's", "aaa", "x"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", "", "'"]) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df = df.withColumn("base", T.normalize(F.col("text"))).withColumn("views", T.view_text(F.col("base")))
    got = df.select("views", "base", rule_index.matcher(own)(F.col("views")).alias("f")).select("views", "base", "f.*").collect()
    table = spark.createDataFrame([(r.rule_id, r.kind, r.pattern, r.gaming_sensitive, i, list(r.needs)) for i, r in enumerate(own)], "rule_id string, kind string, pattern string, gaming_sensitive boolean, ord int, needs array<string>")
    joined = {r["views"]: r["hits"] for r in rule_index.hits_by_join(df, table).collect()}
    some = 0
    for r in got:
        game = re.search(r"\b(?:" + "|".join(rules.GAMING) + r")\b", r["base"]) is not None
        want = [x.rule_id for x in own if not (game and x.gaming_sensitive) and re.search(rules.pattern_of(x), r["views"])]
        assert r["hits"] == want == joined[r["views"]] and r["in_game"] == game
        some += len(want)
    assert some > 500


def test_many_rules_take_the_time_of_few():
    import time

    text = "the quick brown fox " * 100 + "idiot"
    took = {}
    for n in (100, 100_000):
        index = rule_index.RuleIndex([*RULES, *[rules.Rule(f"x{i}", "literal", f"word{i} other{i % 7}", "mid", "bullying") for i in range(n)]])
        index.find(text)
        began = time.perf_counter()
        for _ in range(300):
            assert index.find(text)["hits"] == ["bullying/idiot"]
        took[n] = time.perf_counter() - began
    assert took[100_000] < 3 * took[100] + 0.05, took


def test_rules_of_any_size_are_refused_or_joined(spark):
    table = spark.createDataFrame([("a", "literal", "x" * 100, "mid", "bullying", False, 1)], "rule_id string, kind string, pattern string, band string, category string, gaming_sensitive boolean, ord int")
    with pytest.raises(ValueError, match="hits_by_join"):
        rules.from_table(table, most=100)
    assert rule_index.hits_by_join(spark.createDataFrame([("x" * 100, "x" * 100)], "views string, base string"), table).first()["hits"] == ["a"]


# --- what the screening application does, worked out by hand ---------------------------------------------------------------
@pytest.mark.parametrize(("given", "want"), [("pwd: hunter2 ok", "pwd: [redacted] ok"), ("passwd=abc", "passwd=[redacted]"), ("api-key: K1", "api-key: [redacted]"), ("my_token=abc123", "my_token=[redacted]"), ("APIKEY = x y", "APIKEY = [redacted] y"), ("[sudo] password for bob: hunter2", "[sudo] password: [redacted]"), ("Password for bob : s3cret end", "Password for bob : [redacted] end"), (None, ""), ("no secrets here", "no secrets here"), ("token=" + "x" * 300, "token=[redacted]")])
def test_secrets_are_hidden(spark, given, want):
    assert one(spark, T.redact(F.lit(given).cast("string"))) == want


def test_signals_fuse(spark):
    def fused(*signals):
        return one(spark, decide.fuse_signals(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"), F.lit(c).alias("calibrated")) for n, s, c in signals])))

    f = fused(("text", 0.5, True), ("vision", 0.5, True), ("audio", 0.5, True))
    assert (f["fused"], f["mode"], f["weighted"], f["agreement"]) == (0.65, "multimodal_agreement", 0.5, True)
    f = fused(("text", 0.9, True), ("vision", 0.5, True))
    assert (f["fused"], f["mode"], f["floor"]) == (0.9, "multimodal", 0.9)
    f = fused(("text", 0.4, True), ("vision", 0.9, False))
    assert (f["fused"], f["mode"], f["ignored"]) == (0.4, "text_only", ["vision"])
    assert fused(("audio", 0.3, True))["mode"] == "audio_only" and fused(("text", 0.0, True))["mode"] == "idle"


def test_categories_and_actions(spark):
    names = {"identity_attack": "hate_identity", "violence": "bullying", "cyberbullying": "bullying", "hate_speech": "hate_identity", "Threat ": "bullying", "profanity": "profanity"}
    for given, want in names.items():
        assert one(spark, decide.canonical(F.lit(given))) == want
    acts = {("profanity", 0.99): "notify_only", ("threat", 0.6): "block", ("bullying", 0.9): "block", ("bullying", 0.7): "blur_region", ("bullying", 0.69): "notify_only"}
    for (c, s), want in acts.items():
        assert one(spark, decide.action(F.lit(c), F.lit(s))) == want


def test_regions_of_one_text_but_for_case_and_space(spark):
    rows = [(1, 1, "Hello  World", 0.0, 0.0, 1.0, 1.0, 0.5), (1, 2, "hello world", 0.0, 0.0, 1.0, 1.0, 0.9), (1, 3, "HELLO world", 5.0, 5.0, 6.0, 6.0, 0.9)]
    df = spark.createDataFrame(rows, "frame_id long, ord int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    assert [(r["slot"], r["ord"]) for r in evidence.deduped(df).orderBy("slot").collect()] == [(0, 2), (1, 3)]
    assert [(r["ord_a"], r["ord_b"]) for r in evidence.overlaps(df).collect()] == [(1, 2)]


def test_pictures_by_blob(spark):
    def found(hot, size=10, sat=0.5):
        cells = [(1, r, c, 1.0 if (r, c) in hot else 0.0, sat) for r in range(size) for c in range(size)]
        return evidence.dominant_picture(spark.createDataFrame(cells, "frame_id long, row int, col int, interest double, sat double"), size, size, 1000, 1000).count()

    c_shape = {(0, c) for c in range(10)} | {(9, c) for c in range(10)} | {(r, 0) for r in range(10)}
    assert found(c_shape) == 1  # 28 % of the cells in a box of the whole frame
    squares = [{(r + i, c + j) for i in range(3) for j in range(3)} for r, c in ((0, 0), (0, 5), (5, 0), (5, 5))]
    assert found(set.union(*squares[:3])) == 1 and found(set.union(*squares)) == 0  # four equal ones are a gallery
    assert found(squares[0], sat=0.1) == 0 and found({(0, 0)}) == 0


def test_frames_by_title_and_features(spark):
    def scores(title, skin=0.0, motion=0, person=False, shape=False, bottle=False):
        s = evidence.frame_scores(F.lit(title), F.lit(skin), F.lit(motion), F.lit(person), F.lit(shape), F.lit(bottle))
        return tuple(one(spark, F.array(*[s[k].cast("double") for k in ("nsfw", "weapons", "violence")])))

    assert scores("x", skin=0.4) == (0.84, 0.15, 0.05) and scores("dance", skin=0.4)[0] == scores("chef", skin=0.4)[0] == 0.12
    assert scores("nude dancing")[0] == 0.12 and scores("nude cook")[0] == 0.89
    assert scores("knife kitchen")[1] == 0.15 and scores("knife party")[1] == 0.91 and scores("x", person=True, bottle=True)[1] == 0.81
    assert scores("fight party")[2] == 0.05 and scores("x", motion=13, person=True)[2] == 0.83
    threat = lambda *v: one(spark, evidence.frame_threat(*map(F.lit, v)))  # noqa: E731  nsfw, violence, weapons
    assert (threat(0.89, 0.94, 0.9), threat(0.89, 0.89, 0.1), threat(0.1, 0.1, 0.76), threat(0.1, 0.8, 0.75)) == ("violence", "adult_content", "weapons", "none")


def test_probe_abstains_or_refuses(spark):
    of = lambda dim, multi, text: tuple(one(spark, vision.probe(F.array(*[F.lit(1.0)] * dim), F.array(F.lit(0.5), F.lit(-0.5)), F.lit(0.0), F.lit(multi), F.lit(text))))
    assert of(2, False, False) == of(2, True, True) == (0.5, True) and of(2, True, False) == of(1, True, False) == (0.0, True) and of(3, False, True) == (0.0, False)


def test_speech(spark):
    cases = {'{"a": 1} Hi **you** `x`': "Hi you x", "```code {x} ```done": "done", "a_b [link] > c | d": "a b link c | d", None: ""}
    for given, want in cases.items():
        assert one(spark, T.speech(F.lit(given).cast("string"))) == want


def test_percentiles_from_counts(spark):
    import random

    draw = random.Random(8)
    rows = [(k, draw.choice([0.0, -3.5, 7.25, draw.random() * 10_000])) for k, n in (("a", 500), ("b", 7), ("c", 1)) for _ in range(n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "stage string, ms double")
    got = {r["stage"]: tuple(r)[1:] for r in dashboard.latency_profile(df).collect()}
    want = df.groupBy("stage").agg(F.percentile("ms", F.lit(0.5)).alias("a"), F.percentile("ms", F.lit(0.9)).alias("b"), F.max("ms"), F.count("ms")).where("a is not null").collect()
    assert {r["stage"]: tuple(None if v is None else round(v, 2) for v in got[r["stage"]]) for r in want} == {r["stage"]: tuple(round(v, 2) for v in tuple(r)[1:]) for r in want} and len(got) == 3


def test_moods_and_kinds(spark):
    for given, want in {" positive": "Positive", "NEGATIVE ": "Negative", "Curious": "Positive", "": "Neutral", "bored": "Neutral"}.items():
        assert one(spark, dashboard.mood(F.lit(given))) == want
    for given, want in {"bullying": "other", "threat": "other", "weapons": "other", "sexual_harassment": "other", "hate_speech": "hate", "adult_content": "adult", "violence_hate": "violence"}.items():
        assert one(spark, dashboard.threat_kind(F.lit(given))) == want


def test_trend_index_and_cards(spark):
    turns = spark.createDataFrame([(1, 9, 1, "scared"), (1, 9, 2, "Happy"), (2, 9, 1, None), (2, 9, 2, "angry"), (3, 9, 1, "angry"), (4, 12, 1, None)], "session_id int, child_age int, turn int, raw_emotion string")
    sessions = spark.createDataFrame([(1, 9, "2024-01-01 10:00:00", True), (2, 9, "2024-01-01 12:00:00", False), (3, 9, "2024-01-02 00:00:00", True), (4, 12, "2024-01-03 00:00:00", True)], "session_id int, child_age int, ts string, completed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(str(r["day"])[:10], r["session_id"], r["emotion"]) for r in dashboard.emotion_trend(turns, sessions).collect()] == [("2024-01-03", 4, "neutral"), ("2024-01-02", 3, "angry"), ("2024-01-01", 1, "happy")]
    assert {r["child_age"]: r["index"] for r in dashboard.negative_index(turns, "child_age", default=0.2).collect()} == {9: 0.75, 12: 0.2}
    runs = spark.createDataFrame([(9, "hate"), (9, "not-hate"), (30, "hate")], "child_age int, decision string")
    cards = {r["child_age"]: tuple(r)[1:] for r in dashboard.cards(runs, sessions, spark.createDataFrame([(9, 12)], "child_age int, minutes int")).collect()}
    assert cards == {9: (3, 1, 1, 12), 12: (1, 0, 0, 0), 30: (0, 1, 1, 0), None: (4, 2, 2, 12)}
    assert tuple(dashboard.recommendations(turns).where("child_age = 9").first())[1:] == (True, False, False)


def test_threshold_of_an_envelope(spark):
    for given, want in {'{"payload": {"persona_threshold": 0.42}}': 0.42, '{"payload": {"persona_threshold": 0}}': 0.65, '{"threshold": 0.3}': 0.65, "broken": 0.65}.items():
        assert float(one(spark, store.effective_threshold(F.lit(given), F.lit(12)))) == want
    assert float(one(spark, store.effective_threshold(F.lit(None).cast("string"), F.lit(None).cast("int")))) == 0.55


def test_trigger_takes_the_verdicts_category(spark):
    def of(nsfw=0.0, adult=0.0, violence=0.0, weapons=0.0, hate=0.0, verdict=False, category=None, score=0.0):
        named = {"nsfw": nsfw, "adult": adult, "violence": violence, "weapons": weapons, "hate": hate, "verdict": verdict, "verdict_score": score}
        return tuple(one(spark, store.trigger(verdict_category=F.lit(category).cast("string"), **{k: F.lit(v) for k, v in named.items()})))

    assert of(verdict=True, category="bullying", score=0.64) == ("cyberbullying", 0.64) and of(hate=0.8) == ("none", 0.0) and of(hate=0.81) == ("hate_speech", 0.81)
    assert of(adult=0.9, violence=0.95) == ("adult_content", 0.9) and of(violence=0.9, verdict=True, category="threat") == ("violence", 0.9) and of(weapons=0.76) == ("weapons", 0.76)


def test_explanation_of_a_run(spark):
    said = decide.explanation(decision=F.lit("hate"), escalated=F.lit(True), has_ocr=F.lit(True), has_asr=F.lit(True), hits=F.array(*[F.lit(x) for x in "abcde"]), model=F.lit(0.456), framing=F.lit("x"), vision=F.lit(0.3), vision_calibrated=F.lit(False), fused=F.lit(0.905))
    assert one(spark, said) == "Flagged after multimodal scoring. Read from on-screen text and speech. Matched rule(s): a, b, c, d. Language model scored 0.46. Score reduced — the text looks like it is reporting or quoting harm, not committing it. Image branch read 0.30 but is uncalibrated, so it did not affect the score. Final risk 0.91."


def test_thetas_from_counts(spark):
    import random

    draw = random.Random(1)
    rows = [(draw.choice("ab"), draw.choice([0.35, 0.5, 0.55, 0.8, draw.random(), None]), draw.random() < 0.4) for _ in range(500)]
    df = spark.createDataFrame(rows, "scorer string, score double, hate boolean")
    got = {(r["scorer"], r["theta"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in evaluation.sweep(df, [0.8, 0.35, 0.55]).collect()}
    for (s, t), cells in got.items():
        own = [(x >= t, y) for k, x, y in rows if k == s and x is not None]
        assert cells == tuple(own.count(c) for c in ((True, True), (True, False), (False, False), (False, True)))
    assert len(got) == 6
    assert {r["persona"] for r in evaluation.by_persona(df, {"x": 0.55, "y": 0.55, "z": 0.8}).collect()} == {"x", "y", "z"}


def test_reply_json(spark):
    texts = ['```json\n{"reply": "fine", "emotion": "happy", "agreed": true}\n```', "I promise", "no {broken"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.reply_json(F.col("t"), ["promise"]).alias("r")).select("r.*").collect()
    assert tuple(rows[0]) == ("fine", "happy", True)
    assert tuple(rows[1]) == ("I promise", "neutral", True)
    assert tuple(rows[2]) == ("no {broken", "neutral", False)


def test_reply_text(spark):
    cases = {" Sure! Here is the text: 'hello'": "'hello'", "here's what it says: **a** - `b`": "a b", " none. ": "", "Sure, why not": "Sure, why not", "the answer: x": "the answer: x", None: ""}
    for given, want in cases.items():
        assert one(spark, T.reply_text(F.lit(given).cast("string"))) == want


def test_fusion_never_falls_below_the_strongest_signal(spark):
    grid = spark.createDataFrame([(a / 20, b / 20, c) for a, b, c in itertools.product(range(21), range(21), (True, False))], "t double, v double, c boolean")
    score, _ = decide.fused(F.col("t"), F.col("v"), F.col("c"))
    arrays = decide.fuse_signals(F.array(F.struct(F.lit("text").alias("name"), F.col("t").alias("score"), F.lit(True).alias("calibrated")), F.struct(F.lit("vision").alias("name"), F.col("v").alias("score"), F.col("c").alias("calibrated"))))
    bad = grid.select("*", score.alias("f"), arrays["fused"].alias("g")).where((F.col("f") < F.greatest("t", F.when(F.col("c"), F.col("v")).otherwise(0.0))) | (~F.col("c") & (F.col("f") != F.col("t"))) | (F.col("f") > 1) | (F.col("f") != F.col("g")))
    assert bad.count() == 0


def test_constants_keep_their_order():
    assert 0.30 < decide.GATE < 0.55
    assert len({r.rule_id for r in RULES}) == len(RULES)


def test_greedy_dedupe_keeps_the_slot(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 1.0, 1.0, 0.5), (1, 2, "a", 0.1, 0.0, 1.1, 1.0, 0.9), (1, 3, "b", 0.0, 0.0, 1.0, 1.0, 0.1), (1, 4, "a", 1.05, 0.0, 2.0, 1.0, 0.2), (1, 5, " ", 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame_id long, ord int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    got = [(r["slot"], r["ord"]) for r in evidence.deduped(df).orderBy("slot").collect()]
    assert got == [(0, 2), (1, 3), (2, 4)]


def test_dominant_picture(spark):
    cells = [(1, r, c, 1.0 if 2 <= r <= 6 and 2 <= c <= 6 else 0.0, 0.5) for r in range(10) for c in range(10)]
    cells += [(2, r, c, 0.0, 0.5) for r in range(10) for c in range(10)]
    df = spark.createDataFrame(cells, "frame_id long, row int, col int, interest double, sat double")
    rows = evidence.dominant_picture(df, 10, 10, 1000, 1000).collect()
    assert [r["frame_id"] for r in rows] == [1] and abs(rows[0]["x0"] - 0.18) < 1e-9 and abs(rows[0]["x1"] - 0.72) < 1e-9


def test_process_flags(spark):
    rows = [(1, "chrome.exe", r"C:\Program Files\Google\chrome.exe"), (2, "chrome.exe", r"C:\Users\x\AppData\chrome.exe"), (3, "odd.exe", r"C:\Temp\odd.exe"), (4, "calc.exe", r"C:\Windows\calc.exe"), (5, "Firefox", "/tmp/firefox"), (6, "opera", None)]
    got = evidence.process_flags(spark.createDataFrame(rows, "pid int, name string, exe string")).collect()
    assert [(r["pid"], r["is_anomaly"]) for r in got] == [(2, True), (5, True), (3, True), (1, False), (6, False), (4, False)]
    assert got[1]["reason"].startswith("Browser")


def test_degraded_backends(spark):
    assert one(spark, dashboard.degraded(F.create_map(F.lit("ocr"), F.lit("ok"), F.lit("asr"), F.lit("failed"), F.lit("clip"), F.lit(None).cast("string")))) == ["asr", "clip"]


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    table.append(spark.createDataFrame([("a", "hate", 0.9)], "id string, decision string, score double").withColumn("ts", F.to_timestamp(F.lit("2024-01-01"))), path)
    table.append(spark.createDataFrame([(None, 7)], "decision string, child_age int").withColumn("ts", F.to_timestamp(F.lit("2024-01-02"))), path)
    rows = store.read_runs(spark, path).orderBy("ts").collect()
    assert [r["decision"] for r in rows] == ["hate", "unknown"] and len(rows[1]["id"]) == 40 and rows[1]["child_age"] == 7
    assert table.purge(spark, path) == 2 and table.read(spark, path).count() == 0


def test_retention_keeps_the_files_of_other_days(spark, tmp_path):
    path = tmp_path / "runs"
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.expr("timestamp '2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, cast(id * 6 as int), 0, 0)").alias("ts"), F.lit("x").cast("binary").alias("thumb_jpeg"))
    table.write_batch(rows.where("id % 2 = 0"), str(path), "a")
    table.write_batch(rows.where("id % 2 = 1"), str(path), "b")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    done = table.prune(spark, str(path), now, days=10, rows=1000)  # rows 0 to 40 stay, thumbs of 0 to 4
    assert done["rows"] == 59 and done["dropped"] > 0
    left = table.read(spark, str(path)).collect()
    assert sorted(int(r["id"]) for r in left) == list(range(41)) and {int(r["id"]) for r in left if r["thumb_jpeg"]} == set(range(5))
    before = files_of(path)
    done = table.prune(spark, str(path), now, days=9, rows=1000)  # only the day that the limit crosses changes
    after = files_of(path)
    assert done == {"dropped": 0, "rewritten": done["rewritten"], "untouched": done["untouched"], "rows": 4} or done["dropped"] > 0
    assert {k: v for k, v in after.items() if "2024-01-2" in k and not k.startswith(("dt=2024-01-21", "dt=2024-01-22"))} == {k: v for k, v in before.items() if "2024-01-2" in k and not k.startswith(("dt=2024-01-21", "dt=2024-01-22"))}
    assert table.prune(spark, str(path), now, days=9, rows=1000)["untouched"] == done["rewritten"] + done["untouched"]
    assert table.prune(spark, str(path), now, days=9, rows=7)["rows"] == 30 and sorted(int(r["id"]) for r in table.read(spark, str(path)).collect()) == list(range(7))


def test_replacement_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    path = tmp_path / "sessions"
    table.upsert(spark.range(200).select("id", F.lit(1).alias("at"), F.lit("old").alias("v")), str(path), "id", "at", 16)
    before = files_of(path)
    update = spark.createDataFrame([(7, 1, "same time"), (8, 0, "stale"), (500, 1, "new")], "id long, at int, v string")
    n = table.upsert(update, str(path), "id", "at", 16)
    got = {r["id"]: r["v"] for r in spark.read.parquet(str(path)).collect()}
    assert len(got) == 201 and (got[7], got[8], got[500], got[9]) == ("same time", "old", "new", "old")
    changed = {k.split("/")[0] for k, _ in set(files_of(path).items()) ^ set(before.items())}
    assert len(changed) == n <= 3


def test_lookups_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(60_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("id"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), F.repeat(F.lit("x"), F.lit(50)).alias("app_exe"))
    table.write_batch(rows, path, "a", **{"parquet.block.size": "200000", "parquet.page.size": "20000", "parquet.page.row.count.limit": "1000"})
    wanted = rows.where("true").first()["id"]
    found = table.by_id(spark, path, wanted)
    assert found.count() == 1
    df = table.by_id(spark, path, wanted)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if not plan.getClass().getSimpleName().startswith("Adaptive") else plan.executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 0 < read < 20_000, read


def test_readers_of_a_version_keep_it(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table.current(spark, path) is None and table.publish(spark.range(5), path) == 1
    old = table.current(spark, path)
    assert table.publish(spark.range(9), path) == 2
    assert old.count() == 5 and table.current(spark, path).count() == 9
    spark.range(3).write.parquet(f"{path}/v3-broken-off")  # a build that never was published
    assert table.current(spark, path).count() == 9 and table.forget(spark, path, 1) == 1 and table.current(spark, path).count() == 9


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.png").write_bytes(b"p")
    (tmp_path / "m/a.wav").write_bytes(b"s")
    (tmp_path / "m/b.jpg").write_bytes(b"q")
    rows = readers.media(spark, str(tmp_path / "m")).orderBy("stem").collect()
    assert [(r["stem"], bytes(r["image"]), r["audio"] and bytes(r["audio"])) for r in rows] == [("a", b"p", b"s"), ("b", b"q", None)]
    (tmp_path / "c.csv").write_text('tweet,class\n"two\nlines ""quoted""",2\n')
    assert readers.csv_corpus(spark, str(tmp_path / "c.csv"), "tweet string, class int").first()["tweet"] == 'two\nlines "quoted"'
    (tmp_path / "h.json").write_text(json.dumps({"sessions": [{"session_id": "s1", "age": 9, "turns": [{"turn": 1, "reply": "x"}]}]}))
    (tmp_path / "broken.json").write_text("{")
    assert [r["session_id"] for r in readers.history(spark, str(tmp_path / "*.json")).collect()] == ["s1"]
    sessions = spark.createDataFrame([("a", 9), ("b", 10)], "session_id string, age int")
    readers.write_history(sessions, str(tmp_path / "w"))
    assert {(r["session_id"], r["age"]) for r in readers.history(spark, str(tmp_path / "w"), lines=True).collect()} == {("a", 9), ("b", 10)}
    built = []
    make = lambda: built.append(1) or spark.range(5)
    assert readers.cached(spark, str(tmp_path / "t"), 5, make).count() == readers.cached(spark, str(tmp_path / "t"), 5, make).count() == 5 and len(built) == 1
    assert readers.corpora(spark, [("k", "f", "c", "n")]).count() == 1


def test_isolated_head(spark):
    def make():
        return lambda t: 1 / len(t)

    rows = spark.createDataFrame([("ab",), ("",)], "t string").select(heads.isolated(make)(F.col("t")).alias("r")).select("r.*").collect()
    assert rows[0]["score"] == 0.5 and rows[0]["error"] is None
    assert rows[1]["score"] is None and rows[1]["error"] == "failed: ZeroDivisionError"


def test_typed_user_functions(spark):
    def embedder():
        return lambda b: [len(b) / 2, 1.0] if b else 1 / 0

    rows = spark.createDataFrame([(1, bytearray(b"abcd")), (2, bytearray(b"")), (3, None)], "id long, content binary")
    got = {r["id"]: r for r in heads.embedded(rows, "content", embedder).collect()}
    assert got[1]["vector"] == [2.0, 1.0] and got[1]["vector_note"] is None
    assert got[2]["vector"] is None and got[2]["vector_note"] == got[3]["vector_note"] == "failed: ZeroDivisionError"
    wrong = rows.select(heads.typed(lambda: lambda b: "text", "array<float>")(F.col("content")).alias("r")).first()["r"]
    assert wrong["value"] is None and wrong["error"].startswith("failed: Arrow")

    def broken():
        raise OSError("no model")

    assert {r["e"] for r in rows.select(heads.typed(broken, "double")(F.col("content"))["error"].alias("e")).collect()} == {"failed: OSError"}

    def hear():
        return lambda b: [{"text": t, "no_speech_prob": 0.9 if t == "x" else 0.0, "avg_logprob": 0.0} for t in b.decode().split(",")]

    clips = heads.transcribed(spark.createDataFrame([(1, bytearray(b"so,x,it goes")), (2, None)], "clip long, sound binary"), "sound", "clip", hear)
    assert [tuple(r) for r in evidence.transcripts(clips, order="place").collect()] == [(1, "so it goes")]


def test_head_is_asked_only_below_the_cut(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id long, lex double")
    out = heads.head_on_rest(df, "lex", lambda x: x.withColumn("score", F.lit(0.5)))
    assert {r["id"]: r["model_score"] for r in out.collect()} == {1: None, 2: 0.5}


def test_paired_embeddings(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, image array<float>")
    b = spark.createDataFrame([(3, [1.0, 1.0])], "id long, caption array<float>")
    rows = vision.paired(a, b, "id", 2).collect()
    assert len(rows) == 1 and rows[0]["both"] == [1.0, 2.0, 0.0, 0.0]


def test_case_sets(spark):
    s = spark.createDataFrame([(1, "t", True, "bullying", "en")], "case_id long, text string, hate boolean, category string, bucket string")
    assert evaluation.union_cases(s, s).count() == 2


@pytest.mark.parametrize("n", [4000])
def test_split_is_60_20_20(spark, n):
    rows = spark.range(n).select(T.content_split(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / n for r in rows}
    assert abs(share["train"] - 0.6) < 0.04 and abs(share["dev"] - 0.2) < 0.04


def test_labels_beside_the_category_map(spark):
    cases = {"hateful": 0.9, "offensive": 0.9, "LABEL-1": 0.9, "clean": 0.1, "label_0": 0.1, "other": None}
    for label, want in cases.items():
        labels = F.array(F.struct(T.label_key(F.lit(label)).alias("label"), F.lit(0.9).alias("score")))
        assert one(spark, scoring.harm(labels)) == want, label


def test_rules_come_from_a_table(spark):
    rows = [("b", "family", "see you (?:later|soon)", "mid", "threat", False, 2), ("a", "literal", "red card", "high", "bullying", False, 1)]
    own = rules.from_table(spark.createDataFrame(rows, "rule_id string, kind string, pattern string, band string, category string, gaming_sensitive boolean, ord int"))
    df = spark.createDataFrame([(1, "Red  caaaard, see you soon"), (2, "an idiot")], "id long, text string")
    got = {r["id"]: (r["hits"], r["category"]) for r in lexicon.screen(df, rules=own).collect()}
    assert got == {1: (["a", "b"], "bullying"), 2: ([], "none")}


def test_media_flags(spark):
    for title, want in {"Movie - VLC": (True, False), "Battle": (False, False), "mail": (False, False), "Match of the day": (True, True)}.items():
        assert tuple(one(spark, evidence.media_flags(F.lit(title))))[:2] == want


def test_probes_are_admitted(spark):
    m = spark.createDataFrame([("a", True, [1.0]), ("b", False, [1.0]), ("c", True, []), ("d", True, None)], "kind string, meets_bar boolean, coef array<double>")
    assert [r["kind"] for r in vision.admitted(m).collect()] == ["a"] and vision.admitted(m, False).count() == 0


def test_rows_before_over_runs(spark):
    rows = [(g, o, g * 100_000 + o) for g in (1, 2) for o in (*range(0, 40, 3), 900, 901, 5000, 5001)] + [(3, 7, 1)]
    df = spark.createDataFrame(rows, "g int, o long, v int")
    got = {(r["g"], r["o"]): r["b"] for r in evidence.with_before(df, "g", "o", "v", "b", width=4).collect()}
    want = {}
    for g in (1, 2, 3):
        own = sorted((o, v) for h, o, v in rows if h == g)
        want |= {(g, o): before for (o, _), before in zip(own, [None, *(v for _, v in own)], strict=False)}
    assert got == want


def test_latencies(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (-3, 0, 0.5, 0.6, 7, 7, 100)] + [("b", 2.0), ("b", None)], "k string, ms double")
    got = {r["k"]: (r["median"], r["p95"], r["n"]) for r in evaluation.latencies(df, "k", "ms").collect()}
    assert got == {"a": (0.6, 100.0, 7), "b": (2.0, 2.0, 1)}


def test_screens_take_few_texts_at_once(spark):
    """A batch is at most a thousand rows, and a few megabytes of it become Python objects at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rule_index.matcher(RULES)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    values = pa.array([None, *["x" * 1000] * 20, "y" * 9000])
    parts = list(batches.slices(values, 4000))
    assert max(map(len, parts)) <= 4 and pa.concat_arrays(parts).equals(values) and len(list(batches.slices(values[:0]))) == 1


def test_user_functions_take_few_values_at_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = spark.range(3000).coalesce(1).select("id", heads.typed(lambda: lambda v: 1 / v, "double")(F.col("id")).alias("r")).select("id", "r.*").orderBy("id").collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert [r["value"] for r in got] == [None, *[1 / i for i in range(1, 3000)]] and got[0]["error"] == "failed: ZeroDivisionError"


def test_second_stage_tries_every_rule_and_reads_the_texts_once(spark, tmp_path):
    rows = [(1, "you are dead meat"), (2, "fine day " * 60), (3, "fine day " * 60 + "idiot"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = text_queries.stage2_recheck(spark, str(tmp_path))
    assert {r["doc_id"]: r["score"] for r in found.collect()} == {1: 0.88, 2: 0.08, 3: 0.58, 4: 0.05}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_second_stage_reads_texts_to_their_end(spark, tmp_path):
    """In a text about a game a threat counts only in a chunk that doesn't speak of it, wherever that chunk lies."""
    start, calm, end = "this game idiot " + "x" * 420, " fine day \u00e9\U0001f600" * 130, " i will kill you"
    rows = [(1, start + end), (2, start + calm + end), (3, start + calm * 30 + end), (4, start + calm), (5, "fine day" + calm + " game" + end), (6, None), (7, " " * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["score"] for r in text_queries.stage2_recheck(spark, str(tmp_path)).collect()}
    assert found == {1: 0.88, 2: 0.88, 3: 0.88, 4: 0.58, 5: 0.08, 6: 0.05, 7: 0.05}
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(db.execute(registry.ORACLE_SQL["stage2_recheck"]).fetchall()) == found
    text = rows[1][1] + " " * 700 + "z"
    cut = spark.createDataFrame([(text,)], "text string").select(scoring.chunks(F.col("text")).alias("c")).first()["c"]
    assert cut == [c for i in range(0, len(text), 200) if (c := text[i : i + 400]).strip(" ")]


def test_attribution_screens_each_text_once(spark):
    """A filter on the score would be put under the screening, which then runs twice."""
    rows = [(1, "you are trash", False, 0.1), (2, "hello there", False, 0.9), (3, "hello there", False, 0.1), (4, "kill yourself", True, 0.9)]
    cases = lexicon.screen(spark.createDataFrame(rows, "case_id long, text string, hate boolean, model double")).withColumn("lexicon", F.col("lexicon_score"))
    found = evaluation.attribution(cases, 0.55)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("find(") == 1
    reached = cases.where("not hate and greatest(lexicon, model) >= 0.55").collect()
    assert sum(r["n"] for r in found.collect()) == len(reached) >= 1 and {r["cause"] for r in found.collect()} <= {"both", "rule", "model"}


def test_a_head_learns_from_counts_made_once(spark):
    """Counts of words that are stored give the scores that texts give, without the texts."""
    rows = [(i, "you are trash" if i % 3 == 0 else f"a fine day {i % 5}", i % 3 == 0) for i in range(30)]
    cases = spark.createDataFrame(rows, "case_id long, text string, hate boolean")
    counted = heads.word_counts(cases).drop("text")
    score = lambda df, head: {r["case_id"]: r["score"] for r in head(df).select("case_id", "score").collect()}
    assert score(counted, heads.train_text_head(counted)) == score(cases, heads.train_text_head(cases))
