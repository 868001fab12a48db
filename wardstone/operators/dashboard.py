"""Tables of the dashboard: cards, sessions, moods, shares, alerts, explanations and traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp, r4, snippet
from .decide import mapped, two_places
from .rules import MOOD
from .scan import before, run_of

#: Emotions that count as negative, and those of the impacts of the feed.
NEGATIVE = ("scared", "defensive", "frustrated", "angry")
IMPACTS = {"Positive": ("resolved", "compliant", "happy"), "Favorable": ("reflective", "curious"), "Negative": ("scared", "defensive"), "Very Negative": ("frustrated", "angry")}


def cards(runs: DataFrame, sessions: DataFrame, screen: DataFrame) -> DataFrame:
    """Cards of each age and of all together (a null age): sessions, runs that decided hate (as alerts and as their count)
    and minutes of ``screen`` (child_age, minutes). Ages in any of the three have a row."""
    none = F.lit(0).cast("long")
    rows = sessions.select("child_age", F.lit(1).cast("long").alias("s"), none.alias("h"), none.alias("m"))
    rows = rows.union(runs.where(F.col("decision") == "hate").select("child_age", none, F.lit(1).cast("long"), none))
    rows = rows.union(screen.select("child_age", none, none, F.col("minutes").cast("long")))
    total = lambda c: F.coalesce(F.sum(c), none)
    return rows.groupingSets([["child_age"], []], "child_age").agg(total("s").alias("content_intercepted"), total("h").alias("high_severity_alerts"), total("h").alias("hate_speech_detected"), total("m").alias("screen_time_minutes"))


def mood(emotion: Column) -> Column:
    return F.coalesce(mapped(MOOD, F.lower(F.regexp_replace(emotion, r"^\s+|\s+$", ""))), F.lit("Neutral"))


def rolled_up(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with their turns in order and the state of the last; turns of unknown sessions are ignored."""
    item = F.struct("turn", "child_response")
    last = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("turns"), F.max_by("completed", "turn").alias("completed"), F.max_by("agreed", "turn").alias("agreed"))
    return sessions.join(last, "session_id")


def newest_sessions(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The last row of each session, the newest ``most``."""
    last = sessions.groupBy("session_id").agg(F.max_by(F.struct("*"), F.col("ts")).alias("s")).select("s.*")
    return last.orderBy(F.desc("ts"), F.desc("session_id")).limit(most)


def threat_kind(threat: Column) -> Column:
    """The slice of a category or threat type by what its name holds, the first that fits."""
    out = F.when(F.lit(False), "")
    for word in ("violence", "hate", "adult", "controversial"):
        out = out.when(F.contains(threat, F.lit(word)), word)
    return out.otherwise("other")


def with_share(counts: DataFrame, n: str, order: list[str]) -> DataFrame:
    """Rounded percent of the total and where each slice begins; for tables of a few rows."""
    total = F.sum(n).over(Window.partitionBy())
    share = F.when(total > 0, F.round(F.col(n) * 100 / total)).otherwise(0).cast("long")
    out = counts.withColumn("percent", share)
    return out.withColumn("offset", F.coalesce(F.sum("percent").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def negative_index(turns: DataFrame, *by: str, default: float | None = None) -> DataFrame:
    """Share of negative emotions among the turns that have one, two places, within 0.1 and 0.95; ``default`` without any."""
    known = F.coalesce("raw_emotion", F.lit("")) != ""
    part = F.avg(F.when(known, F.lower("raw_emotion").isin(*NEGATIVE).cast("double")))
    return turns.groupBy(*by).agg(F.when(part.isNull(), F.lit(default).cast("double")).otherwise(clamp(r4(part, 2), 0.1, 0.95)).alias("index"))


def emotion_trend(turns: DataFrame, sessions: DataFrame, days: int = 7) -> DataFrame:
    """For each day the emotion of the last turn of its last completed session, the newest ``days``. ``sessions`` has
    session_id, ts and completed; sessions without turns or time don't count, a turn without an emotion is neutral."""
    last = turns.groupBy("session_id").agg(F.max_by(F.lower(F.coalesce(F.nullif("raw_emotion", F.lit("")), F.lit("neutral"))), F.col("turn")).alias("emotion"))
    done = sessions.where(F.col("completed") & F.col("ts").isNotNull()).select("session_id", "ts").join(last, "session_id")
    day = done.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.max_by(F.struct("session_id", "emotion"), F.struct("ts", "session_id")).alias("s"))
    return day.select("day", "s.*").orderBy(F.desc("day")).limit(days)


def alerts(runs: DataFrame, sessions: DataFrame, most: int = 5) -> DataFrame:
    """Newest alerts of each age from runs and sessions (child_age, ts, key, kind, score)."""
    both = runs.unionByName(sessions).withColumn("severity", F.when(F.col("score") > 0.9, "High").otherwise("Medium"))
    rank = F.row_number().over(Window.partitionBy("child_age").orderBy(F.desc("ts"), "kind", F.desc("key")))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def context(*texts: Column, limit: int = 80, tail: str = "...", missing: str = "N/A") -> Column:
    """The first text that isn't empty, cut to ``limit`` characters."""
    return snippet(F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(missing)), limit, tail)


def impact(emotion: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, emotions in IMPACTS.items():
        out = out.when(F.lower(emotion).isin(*emotions), name)
    return out.otherwise("Neutral")


def feed(runs: DataFrame, sessions: DataFrame, most: int = 3) -> DataFrame:
    """The newest ``most`` explanations of each age (child_age, ts, key, title, details, impact): runs that decided hate
    (id, ts, child_age, decision, category, risk, overlay_text, ocr_text, transcript) and sessions (session_id, ts, child_age,
    threat_type, completed, emotion and phase of the last turn, null without turns). The wording is a fixed value."""
    flagged = F.concat(F.lit('Analyst detected category "'), F.coalesce("category", F.lit("none")), F.lit('" (risk score '), two_places(F.col("risk")), F.lit('). Content flagged: "'), context(F.col("overlay_text"), F.col("ocr_text"), F.col("transcript")), F.lit('"'))
    a = runs.where(F.col("decision") == "hate").select("child_age", "ts", F.col("id").cast("string").alias("key"), F.lit("Hate Speech Flagged").alias("title"), flagged.alias("details"), F.lit("Negative").alias("impact"))
    emotion, phase = F.coalesce("emotion", F.lit("neutral")), F.coalesce("phase", F.lit("Acknowledge"))
    status = F.when(F.col("completed"), "Completed").otherwise("Active Dialog")
    told = F.concat(F.lit('Socratic agent intercepted a "'), "threat_type", F.lit('" threat. Session status: "'), status, F.lit('" in phase "'), phase, F.lit('". Child response emotional index: "'), emotion, F.lit('".'))
    b = sessions.select("child_age", "ts", F.concat(F.lit("xai-"), F.col("session_id").cast("string")).alias("key"), F.lit("Socratic Safety Intercept").alias("title"), told.alias("details"), impact(emotion).alias("impact"))
    rank = F.row_number().over(Window.partitionBy("child_age").orderBy(F.desc("ts"), "key"))
    return a.union(b).withColumn("rank", rank).where(F.col("rank") <= most)


def recommendations(turns: DataFrame) -> DataFrame:
    """Which advice an age's page shows: the one for young or older children, and what its emotions add: ``gentle`` after
    frustration or defence, else ``praise`` after compliance."""
    some = lambda *e: F.coalesce(F.bool_or(F.lower("raw_emotion").isin(*e)), F.lit(False))
    out = turns.groupBy("child_age").agg(some("frustrated", "defensive").alias("gentle"), some("resolved", "compliant").alias("__well"))
    return out.select("child_age", (F.col("child_age") <= 10).alias("young"), "gentle", (~F.col("gentle") & F.col("__well")).alias("praise"))


def recent_apps(runs: DataFrame, most: int = 8) -> DataFrame:
    last = runs.groupBy("app_exe").agg(F.max_by(F.struct("ts", "id", "decision"), F.struct("ts", "id")).alias("r")).select("app_exe", "r.*")
    return last.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def degraded(status: Column) -> Column:
    """Names of the backends whose status isn't ok, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(status, lambda k, v: ~F.coalesce(v, F.lit("")).isin("ok", "ready"))))


def latency_profile(times: DataFrame) -> DataFrame:
    """(stage, p50, p90, worst, n) of (stage, ms), percentiles between neighbours; null times don't count. Times are counted by
    value, and the counts are summed up along the values by runs, so no stage's times meet in one task."""
    counts = times.where(F.col("ms").isNotNull()).groupBy("stage", "ms").agg(F.count("*").alias("m"))
    ranked = before(counts, "stage", ["ms"], run_of(F.col("ms"), 1000), {"below": ("sum", F.col("m"))}).withColumn("below", F.coalesce("below", F.lit(0)))
    totals = counts.groupBy(F.col("stage").alias("__stage")).agg(F.sum("m").alias("n"), F.max("ms").alias("worst"))
    rows = ranked.join(totals, F.col("stage").eqNullSafe(F.col("__stage")))

    def at(q: float, round_: Callable[[Column], Column]) -> Column:
        """The time of a rank: the one whose counts reach over it."""
        rank = round_(q * (F.col("n") - 1))
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("m")), F.col("ms")))

    def p(q: float) -> Column:
        part = F.first(q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1)))
        return r4(at(q, F.floor) + (at(q, F.ceil) - at(q, F.floor)) * part, 3)

    return rows.groupBy("stage").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), r4(F.first("worst"), 3).alias("worst"), F.first("n").alias("n"))


def status(last_decision: Column, failures: Column) -> Column:
    return F.when(failures >= 3, "degraded").when(last_decision == "hate", "threat").when(last_decision.isNull(), "idle").otherwise("guarding")


def last_emotion(turns: DataFrame) -> DataFrame:
    """The last emotion that a session has."""
    known = F.when(F.col("emotion").isNotNull(), F.col("turn"))
    return turns.groupBy("session_id").agg(F.max_by("emotion", known).alias("emotion"))
