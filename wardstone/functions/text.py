"""Scalar functions over text, hashes and clock strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that stand for letters, and the letters.
LEET = ("013457@$", "oieastas")
#: Between views in one joined text; neither white space nor a dot matches across it.
VIEW_BREAK = "\n\u0001\n"


def normalize(text: Column) -> Column:
    """Lower case, stand-ins to letters, all but letters, digits and apostrophes to single spaces."""
    plain = F.translate(F.lower(text), *LEET)
    # single spaces, which most matches would be, are left alone: a match costs more than the search
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9' ]+", " "), r" {2,}", " "))


def collapse_runs(text: Column, keep: int) -> Column:
    """Runs of three or more of a character become ``keep`` of it."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1" * keep)


def despace(text: Column) -> Column:
    """Joins three or more single letters that spaces part."""
    return F.regexp_replace(text, r"(?<=\b[a-z]) (?=[a-z] [a-z]\b)|(?<=\b[a-z] [a-z]) (?=[a-z]\b)", "")


def views(base: Column) -> Column:
    """Distinct views of a normalised text: as it is, runs doubled, runs single, and both despaced."""
    single = collapse_runs(base, 1)
    return F.array_distinct(F.array(base, collapse_runs(base, 2), single, despace(base), despace(single)))


def view_text(base: Column) -> Column:
    """All views in one text. Most texts hold neither a run nor spaced letters and are their only view."""
    several = base.rlike(r"(.)\1\1") | base.rlike(r"\b[a-z] [a-z] [a-z]\b")
    return F.when(several, F.concat_ws(VIEW_BREAK, views(base))).otherwise(base)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: What stands before a secret, in the order in which they are hidden, and what replaces the match.
SECRETS = [
    (r"(?i)\[sudo\]\s*password\s*for\s+\S+\s*:?\s*\S*", "[sudo] password: [redacted]"),
    (r"(?i)(password\s+for\s+\S+\s*[:=]\s*)\S+", "$1[redacted]"),
    (r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*)\S+", "$1[redacted]"),
]


def redact(text: Column, limit: int = 200) -> Column:
    """Hides passwords, tokens and keys, then cuts to ``limit`` characters; a null text is empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, shown in SECRETS:
        out = F.regexp_replace(out, pattern, shown)
    return F.substring(out, 1, limit)


def snippet(text: Column, limit: int, tail: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def reply_text(text: Column) -> Column:
    """A model's reply without an announcement up to its colon and without markup; NONE is empty, and so is a null reply."""
    announced, marks = r"(?i)^(?:sure[!,.]?\s*)?here(?:'s| is)[^:]{0,40}:\s*", r"[*_`#>-]{1,3}"  # fixed values
    out = squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), announced, ""), marks, " "))
    return F.when(F.upper(F.regexp_replace(out, r"^[ .]+|[ .]+$", "")) == "NONE", "").otherwise(out)


def speech(text: Column) -> Column:
    """What is left to be read aloud: no braces, code fences or markup; a null text is empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\{.*?\}", ""), r"(?s)```.*?```", "")
    return squeeze(F.regexp_replace(out, r"[*_#`~>\[\]]", " "))


def title_hash(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.substring(F.sha2(text, 256), 1, 16))


def frame_hash(content: Column) -> Column:
    return F.sha1(content)


def content_bucket(text: Column) -> Column:
    """0 to 99 by the hash of the trimmed, lower-cased text."""
    key = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))


def content_split(text: Column) -> Column:
    b = content_bucket(text)
    return F.when(b < 60, "train").when(b < 80, "dev").otherwise("test")


def label_key(label: Column) -> Column:
    return F.translate(F.lower(F.trim(label)), " -", "__")


def display_label(label: Column) -> Column:
    return F.translate(label, "_", " ")


def clock(ts: Column) -> Column:
    """An ISO time as hours and minutes; what is no time keeps its characters 12 to 16."""
    parsed = F.try_to_timestamp(F.regexp_replace(ts, "Z$", "+00:00"))
    return F.coalesce(F.date_format(parsed, "hh:mm a"), F.substring(ts, 12, 5))


def data_url(content: Column) -> Column:
    return F.when(content.isNotNull(), F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(content), r"\s", "")))


def region_key(text: Column) -> Column:
    return squeeze(F.lower(text))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def r4(x: Column, places: int = 4) -> Column:
    """Half-up at a number of places, by way of decimals, so that engines agree."""
    return F.round(x.cast("decimal(18,8)"), places).cast("double")


def reply_json(text: Column, words: list[str], schema: str = "reply string, emotion string, agreed boolean", emotion: str = "neutral") -> Column:
    """The JSON object in a model's reply; a reply without one is taken as it is, agreement by key words."""
    body = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, schema)
    said = F.exists(F.lit(words), lambda w: F.contains(F.lower(text), w))
    return F.struct(F.coalesce(parsed["reply"], F.trim(text)).alias("reply"), F.coalesce(parsed["emotion"], F.lit(emotion)).alias("emotion"), F.coalesce(parsed["agreed"], said).alias("agreed"))
