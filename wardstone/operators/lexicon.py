"""Text screening by rule tables: hits, score, category, and the cap for reported speech."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, r4, view_text
from .rule_index import matcher
from .rules import FRAMING, RULES, Rule

FRAMED_CAP = 0.50


def lexicon_score(base: Column, found: Column) -> Column:
    """Bands: high from 0.88, mid from 0.58; harmless talk about a game 0.18, anything else 0.08, empty text 0.05."""
    high, mid = found["high"], found["mid"]
    s = F.when(F.trim(F.coalesce(base, F.lit(""))) == "", 0.05)
    s = s.when(high > 0, F.least(F.lit(0.98), 0.88 + 0.03 * (high - 1))).when(mid > 0, F.least(F.lit(0.80), 0.52 + 0.06 * mid))
    return r4(s.when(found["benign"], 0.18).otherwise(0.08))


def framing(text: Column, signals: Sequence[str] = tuple(FRAMING)) -> Column:
    """Names of the signals that raw text gives, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike("(?iuUd)" + FRAMING[s]), F.lit(s)) for s in signals])))


def framed(score: Column, category: Column, signals: Column) -> tuple[Column, Column]:
    """Score capped for reported speech, never raised, and the reason, which is given whether or not the score was over the
    cap; sexual harassment is never discounted and gets no reason."""
    reported = (F.size(signals) > 0) & (category != "sexual_harassment")
    return F.when(reported, F.least(score, F.lit(FRAMED_CAP))).otherwise(score), F.when(reported, F.concat(F.lit("quoted_or_reported:"), F.array_join(signals, "+")))


def screen(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds base, in_game, hits, lexicon_score and category (columns so named before are replaced). A null text counts as
    empty. The base and the views are made once, by built-in functions; the rules' index sees the views."""
    names = ["base", "in_game", "hits", "lexicon_score", "category"]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names]
    base, found = "base", "in_game"  # free now, whatever the input had
    out = df.select(*keep, normalize(F.coalesce(F.col(text_col), F.lit(""))).alias(base))
    out = out.select("*", matcher(rules)(view_text(F.col(base))).alias(found))
    f = F.col(found)
    return out.select(*keep, base, f["in_game"].alias("in_game"), f["hits"].alias("hits"), lexicon_score(F.col(base), f).alias("lexicon_score"), f["category"].alias("category"))
