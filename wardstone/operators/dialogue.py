"""Dialogue sessions: phases, context, closing, openings and templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import before, run_of

#: Words of agreement.
AGREED = ("agree", "ok", "yes", "deal", "sure", "close", "i'll", "let's", "fine")
PHASES = ("Acknowledge", "Reason", "Contract")
CLOSING = "We have talked this through. Thank you for your honesty."
#: (phase, young, agreed): wording of replies.
TEMPLATES = [
    ("Acknowledge", True, False, "I saw something that may have felt bad. How are you?"),
    ("Acknowledge", False, False, "Something came up on your screen. How did it feel to you?"),
    ("Reason", True, False, "Why do you think words like these can hurt?"),
    ("Reason", False, False, "What would you say to someone on the other side of this?"),
    ("Contract", True, False, "Can we promise to tell a grown-up next time?"),
    ("Contract", False, False, "Can we agree on what to do next time?"),
    ("Contract", True, True, "That is a great promise. Well done!"),
    ("Contract", False, True, "Agreed. Thank you for thinking about it."),
]


def agrees(text: Column, words: Sequence[str] = AGREED, whole: bool = False) -> Column:
    """Whether a reply holds a word of agreement, as part of a word too unless ``whole``."""
    t = F.lower(text)
    if whole:
        return t.rlike(r"\b(?:" + "|".join(words) + r")\b")
    return F.exists(F.lit(list(words)), lambda w: F.contains(t, w))


def phases(turns: DataFrame, words: Sequence[str] = AGREED) -> DataFrame:
    """Phase of each child's turn by its place, and whether the session is complete: agreed in the last phase."""
    n = F.col("child_turn")
    said = turns.withColumn("agreed", (n >= 3) & agrees(F.col("child_response"), words))
    rows = before(said, "session_id", ["child_turn"], run_of(n), {"__done": ("max", F.col("agreed"))})
    done = F.coalesce("__done", F.lit(False))
    phase = F.when(n == 1, PHASES[0]).when(n == 2, PHASES[1]).otherwise(PHASES[2])
    return rows.withColumn("phase", F.when(done, "Completed").otherwise(phase)).withColumn("completed", done | F.coalesce("agreed", F.lit(False))).drop("__done")


def closed(turns: DataFrame) -> DataFrame:
    """Turns after a session was complete get the closing reply."""
    rows = before(turns, "session_id", ["turn"], run_of(F.col("turn")), {"__done": ("max", F.col("completed"))})
    return rows.withColumn("reply", F.when(F.coalesce("__done", F.lit(False)), CLOSING)).drop("__done")


def context(messages: DataFrame, most: int = 8, seed: str = "Hello.") -> DataFrame:
    """The last messages of each conversation as one array: blanks skipped, leading others dropped, equal roles merged."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("__back", last).where((F.col("__back") <= most) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    every = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    kind = "array<struct<role:string,content:string>>"

    def add(acc: Column, m: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        one = F.array(F.struct(m["role"].alias("role"), m["text"].alias("content")))
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(m["role"].alias("role"), F.concat(end["content"], F.lit("\n"), m["text"]).alias("content"))))
        return F.when((F.size(acc) == 0) & (m["role"] != "user"), acc).when(end["role"] == m["role"], merged).otherwise(F.concat(acc, one))

    found = F.aggregate("all", F.array().cast(kind), add)
    first = F.array(F.struct(F.lit("user").alias("role"), F.lit(seed).alias("content")))
    return every.select("conv_id", F.when(F.size(found) > 0, found).otherwise(first).alias("messages"))


def opening(age: Column, threat: Column) -> Column:
    about = F.translate(threat, "_", " ")
    return F.when(age <= 10, F.concat(F.lit("Hi! Let us talk about "), about, F.lit(" together."))).otherwise(F.concat(F.lit("I would like to talk with you about "), about, F.lit(".")))


def replies(turns: DataFrame) -> DataFrame:
    """Adds the template's reply for phase, age band and agreement."""
    session = turns.sparkSession
    each = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(y).alias("young"), F.lit(a).alias("agreed"), F.lit(t).alias("template")) for p, y, a, t in TEMPLATES])
    table = session.range(1).select(F.explode(each).alias("t")).select("t.*")
    return turns.withColumn("young", F.col("child_age") <= 10).join(F.broadcast(table), ["phase", "young", "agreed"], "left").drop("young")


def voice(age: Column) -> Column:
    return F.when(age <= 10, "warm").when(age <= 13, "friendly").otherwise("calm")
