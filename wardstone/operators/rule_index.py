"""An index over rules: a text's words lead to the few rules that may match it, and only those are tried.

Every match of a rule begins with one of its anchor words or holds one of its required words. A literal's anchors are its
first word and the first words written together, as blanks within a phrase may be missing; a pattern names what it needs
(``needs``), or is tried on every text. A literal of one word is settled by the word itself. Looking words up in a hash
table takes the same time for a hundred rules and for a hundred thousand; the rules found are verified by their patterns.

``matcher`` broadcasts the rules, which ``from_table`` bounds in bytes. ``hits_by_join`` takes a table of rules of any size:
there the anchors meet the texts' words in a shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices, tuned
from ..functions.text import VIEW_BREAK
from .rules import BENIGN, GAMING, Rule, pattern_of

BROADCAST_RULES = 1000  # from which rules are broadcast instead of sent with each task
SEVERITY = ("threat", "hate_identity", "sexual_harassment", "bullying")  # of literals of the high band
FOUND = "hits array<string>, in_game boolean, benign boolean, high int, mid int, category string"


def words_of(views: str) -> set[str]:
    """Words between blanks and apostrophes, where patterns' words begin and end."""
    return set(views.replace("'", " ").split())


def anchors(rule: Rule) -> list[str]:
    """Words one of which a text must hold for the rule to match; none if that isn't known."""
    if rule.kind != "literal":
        return [part for n in rule.needs for part in n.replace("'", " ").split()[:1]]
    parts = rule.pattern.split()
    return list(dict.fromkeys("".join(parts[: i + 1]).split("'")[0] for i in range(len(parts))))


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], gaming: Sequence[str] = GAMING, benign: Sequence[str] = BENIGN):
        self.rules, self.gaming, self.benign = list(rules), frozenset(gaming), frozenset(benign)
        self.by_word: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.patterns: dict[int, Callable] = {}
        for i, r in enumerate(self.rules):
            words = anchors(r)
            if not words or "" in words:
                self.always.append(i)
            for w in words:
                self.by_word.setdefault(w, []).append(i)
        self.sure = {i for i, r in enumerate(self.rules) if r.kind == "literal" and re.fullmatch("[a-z0-9]+", r.pattern)}

    def _matches(self, i: int, views: str) -> bool:
        if i in self.sure:
            return True
        if i not in self.patterns:
            self.patterns[i] = re.compile(pattern_of(self.rules[i])).search
        return self.patterns[i](views) is not None

    def find(self, views: str) -> dict:
        """Hits in the order of the table, the flags, the numbers of hits by band, and the category."""
        words = words_of(views)
        base = words if "\n" not in views else words_of(views.split("\n", 1)[0])
        in_game = not self.gaming.isdisjoint(base)
        tried = {i for w in self.by_word.keys() & words for i in self.by_word[w]}.union(self.always)
        hits = [self.rules[i] for i in sorted(tried) if not (in_game and self.rules[i].gaming_sensitive) and self._matches(i, views)]
        return {"hits": [r.rule_id for r in hits], "in_game": in_game, "benign": not self.benign.isdisjoint(words), "high": sum(r.band == "high" for r in hits), "mid": sum(r.band == "mid" for r in hits), "category": category_of(hits)}


def category_of(hits: Sequence[Rule]) -> str:
    """Literals of the high band by severity, else its first family; in the mid band a family names the category only
    without a literal."""
    of = lambda band, literal: [r.category for r in hits if r.band == band and (r.kind == "literal") == literal]
    severe = of("high", True)
    for c in SEVERITY:
        if c in severe:
            return c
    if severe:
        return "bullying"
    return next(iter(of("high", False)), None) or ("bullying" if of("mid", True) else next(iter(of("mid", False)), "none"))


_indexes: dict[str, RuleIndex] = {}


def matcher(rules: Sequence[Rule]) -> Callable[[Column], Column]:
    """A function from a column of views to a struct (FOUND)."""
    tuned()
    rules = list(rules)
    key = hashlib.sha1(pickle.dumps(rules)).hexdigest()
    sent = SparkSession.getActiveSession().sparkContext.broadcast(rules) if len(rules) > BROADCAST_RULES else None
    own = None if sent is not None else rules

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _indexes:
            _indexes[key] = RuleIndex(own if sent is None else sent.value)
        index = _indexes[key]
        kind = pa.struct([("hits", pa.list_(pa.string())), ("in_game", pa.bool_()), ("benign", pa.bool_()), ("high", pa.int32()), ("mid", pa.int32()), ("category", pa.string())])
        for views in batches:
            yield pa.concat_arrays([pa.array([index.find(v or "") for v in some.to_pylist()], kind) for some in slices(views)])

    return find


def hits_by_join(texts: DataFrame, rules: DataFrame, views_col: str = "views", base_col: str = "base") -> DataFrame:
    """``texts`` with ``hits`` by a table of rules of any size (columns as for ``from_table``). Distinct views' words meet the
    rules' anchors in a shuffle, and each candidate is verified where it is; patterns without needs meet every text in blocks
    of the rules that have none, which should be few."""
    anchored = rules.select("rule_id", "kind", "pattern", F.coalesce("gaming_sensitive", F.lit(False)).alias("gaming_sensitive"), "ord", *(["needs"] if "needs" in rules.columns else [F.array().cast("array<string>").alias("needs")]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rule_id, kind, pattern, sensitive, place, needs in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                r = Rule(rule_id, kind, pattern, "", "", sensitive, tuple(needs or ()))
                words = anchors(r)
                rows += [(w, rule_id, pattern_of(r), sensitive, place) for w in ([None] if not words or "" in words else words)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "rule_id", "pattern", "sensitive", "place"])

    keys = anchored.withColumn("ord", F.col("ord").cast("long")).mapInArrow(expand, "word string, rule_id string, pattern string, sensitive boolean, place long")
    views = texts.select(F.col(views_col).alias("v"), F.col(base_col).alias("b")).where("v is not null").distinct()
    words = views.select("v", "b", F.explode(F.array_distinct(F.split(F.regexp_replace("v", r"[^a-z0-9]+", " "), " "))).alias("word")).where("word != ''")
    pairs = words.join(keys.where("word is not null"), "word").select("v", "b", "rule_id", "pattern", "sensitive", "place")
    free = [r for r in keys.where("word is null").select("rule_id", "pattern", "sensitive", "place").limit(BROADCAST_RULES + 1).collect()]
    if len(free) > BROADCAST_RULES:
        raise ValueError(f"more than {BROADCAST_RULES} patterns have no needs")
    if free:
        each = F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("pattern"), F.lit(r[2]).alias("sensitive"), F.lit(r[3]).cast("long").alias("place")) for r in free])
        pairs = pairs.union(views.select("v", "b", F.explode(each).alias("r")).select("v", "b", "r.*"))
    gaming = r"\b(?:" + "|".join(GAMING) + r")\b"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Callable] = {}
        in_game = re.compile(gaming).search
        for b in batches:
            keep = []
            for v, base, pattern, sensitive in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if pattern not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[pattern] = re.compile(pattern).search
                keep.append(known[pattern](v) is not None and not (sensitive and in_game(base)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(5)], ["v", "rule_id", "place"]).filter(pa.array(keep))

    found = pairs.mapInArrow(verify, "v string, rule_id string, place long").distinct()
    listed = found.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id"))), lambda x: x["rule_id"]).alias("hits"))  # the rules that hit one text
    out = texts.join(listed, texts[views_col] == listed["v"], "left").drop("v")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


assert VIEW_BREAK.startswith("\n")  # the first view is the base
