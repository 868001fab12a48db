"""Personal data by weak supervision, in built-in functions only.

Candidate spans come from patterns: strict forms of four kinds (email, ip, card, phone), and looser forms (spelled-out
emails, phones without a country code, social security numbers, secrets such as keys and passwords, names of persons,
street addresses, bank accounts, passports and other papers). Four labelers vote on every candidate, each for (1), against
(-1) or not at all (0): the check of its pattern, a gazetteer (endings of domains, credentials, first names and titles, kinds of
streets, countries of bank accounts), the words before it, and its surroundings. The gazetteer is a table of words, a small one
by default. A kind that the corpus gives no candidate of keeps its prior odds. Expectation maximisation over the counts of vote patterns
estimates what each labeler's votes are worth and the share of real spans of each kind; the resulting posteriors train a
naive Bayes span classifier over kind, length, shape and context features. Strict forms always stay; a looser candidate
is added if the classifier takes it and it overlaps no strict span.

Every step is an expression over the row. The only things collected are counts by vote pattern and feature, whose number
is bounded by the definitions here (kinds x 81 patterns x features). Sums cover all rows.

A null or empty text has no spans. Positions are code points, ends exclusive. Repeated rows each keep a row; other columns
are ignored. Patterns take time in proportion to the text, also for long runs of one character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored

#: Kinds in the order of output. The first four have strict forms.
KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "name", "address", "iban", "document"]

#: name: (kind, strict, pattern, what a text must contain for the pattern to be tried)
PATTERNS: dict[str, tuple[str, bool, str, str]] = {
    "email": ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", True, r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ""),
    "card": ("card", True, r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", ""),
    "phone": ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    "email_spelled": ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++", "at"),
    "phone_local": ("phone", False, r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])", ""),
    "secret": ("secret", False, r"(?i)(?<![A-Za-z0-9_])(?:token|password|passwd|secret|api_key|apikey)\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_./+-]{6,}+[\"']?|(?<![A-Za-z0-9])(?-i:AKIA)[0-9A-Za-z]{16}(?![A-Za-z0-9])", ""),
    "ssn": ("ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "name": ("name", False, r"(?<![\p{L}'-])(?=\p{Lu})(?:<first>)\.?(?:[ -]\p{Lu}\p{Ll}++){1,3}(?![\p{L}])", " "),
    "address": ("address", False, r"(?<![0-9\p{L}.-])[0-9]{1,5}[a-z]?,? (?:\p{Lu}\p{Ll}++ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court|Way|Place)(?![\p{L}])", " "),
    "iban": ("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ""),
    "document": ("document", False, r"(?i)(?<![A-Za-z])(?:passport|licen[cs]e|identity card|id card)(?: (?:no\.?|nr\.?|number))?[ :#]{1,3}(?-i:[A-Z]{1,2}[0-9]{6,9})(?![A-Za-z0-9])", ""),
}
#: The gazetteer's default rows: endings of domains, credentials, first names and titles, kinds of streets, countries.
ENDINGS = "com org net edu gov mil int info biz name pro io co ai app dev me tv cloud online site xyz eu uk de fr es it nl be at ch pl pt se no dk fi ie cz sk hu ro bg gr hr si lt lv ee lu mt cy is li ru ua tr us ca mx br ar cl pe au nz jp kr cn tw hk sg in id th vn ph my za ng ke eg il sa ae".split()
CREDENTIALS = "token password passwd pwd passphrase secret client_secret api_key apikey api-key access_key private_key auth bearer credential AKIA".split()
FIRST = "Mr Mrs Ms Dr Prof Adam Alexander Alice Andrew Anna Anthony Barbara Benjamin Brian Carlos Catherine Charles Christopher Claire Daniel David Deborah Dorothy Edward Elizabeth Emily Emma Eric Frank George Hannah Heather Helen Henry Jack Jacob James Jane Jason Jennifer Jessica John Jonathan Joseph Joshua Julia Karen Kevin Laura Lauren Linda Lisa Maria Mark Martin Mary Matthew Melissa Michael Michelle Nancy Nathan Nicholas Olivia Pamela Patricia Paul Peter Rachel Rebecca Richard Robert Ryan Samuel Sandra Sarah Sophie Stephen Steven Susan Thomas Timothy Victoria William".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Square Court Way Place".split()
BANKS = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split()
GAZETTEER = {"ending": ENDINGS, "credential": CREDENTIALS, "first": FIRST, "street": STREETS, "bank": BANKS}
MOST_WORDS = 20_000


def gazetteer(words: DataFrame) -> dict[str, list[str]]:
    """A gazetteer of a table (sort, word) of at most MOST_WORDS rows; sorts as in GAZETTEER, those it lacks as there."""
    rows = words.select("sort", "word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return GAZETTEER | {sort: sorted(r["word"] for r in rows if r["sort"] == sort) for sort in {r["sort"] for r in rows}}


#: Words that announce a span, and words that announce a number of another sort.
FOR = r"(?i)(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|ip|address|host|card|visa|account|iban|ssn|login|user|token|key|password|name is|i am|dear|regards|signed|patient|born|lives (?:at|in)|resident|contact person)\W{0,3}$"
AGAINST = r"(?i)(?:version|v|section|release|isbn|figure|table|page|no|chapter)\W{0,2}$"
GATED = {"iban"}  # patterns so wide that only matches that hold are candidates
LABELERS = ["strict", "gazetteer", "words", "edges"]
PRIOR = 0.7  # share of real spans of a kind before anything is seen
SMOOTHING = 10.0  # spans of a feature's mean rate that are added to both sorts
CONTEXT = 24  # characters before a span that labelers and features see


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        p = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(p) > 3, False).otherwise(F.concat(F.lit("0"), p).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def _account(value: Column) -> Column:
    """Whether a bank account's number has the remainder 1 by 97, its first four characters last and letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: F.when(c == "", rest).otherwise((rest * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _holds(name: str, value: Column, words: dict[str, list[str]] = GAZETTEER) -> Column:
    """The strict check of a pattern's match."""
    if name == "ip":
        return _octets(value)
    if name == "card":
        return _luhn(value)
    if name == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    if name == "ssn":
        return ~value.rlike("^(?:000|666|9..)-|-00-|-0000$")
    if name == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]{2}")
    if name == "iban":
        return _account(value)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


RUN = 256  # values of an array that are accumulated one by one


def running(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of all values before each one. An array that grows by one value is copied each time, so runs of
    values are accumulated first, then the runs' totals: the time stays near the number of values."""
    add = lambda total: lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), total(x))))
    begin = F.array(F.lit(zero))
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(RUN))
    inner = F.transform(starts, lambda b: F.aggregate(F.slice(values, b, RUN), begin, add(lambda x: x)))

    def outer(runs: Column) -> Column:
        totals = F.aggregate(runs, begin, add(lambda x: F.element_at(x, -1)))
        return _let(totals, lambda t: F.flatten(F.transform(runs, lambda r, i: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x: join(F.get(t, i), x)))))

    return _let(inner, outer)


def _found(name: str, text: Column, words: dict[str, list[str]]) -> Column:
    """Candidates of one pattern as structs, in order of place; empty where the text can't match."""
    kind, strict, pattern, need = PATTERNS[name]
    pattern = pattern.replace("<first>", "|".join(map(re.escape, words["first"])))
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(h: Column, p: Column) -> Column:
        ahead = running(F.zip_with(p, h, lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0))), 0, lambda a, b: a + b)

        def one(value: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(p, i))
            left = F.right(F.concat(F.when(i > 0, F.right(F.get(h, i - 1), F.lit(CONTEXT))).otherwise(""), F.get(p, i)), F.lit(CONTEXT))
            right, holds = F.left(F.get(p, i + 1), F.lit(1)), _holds(name, value, words)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (F.lit(strict) & holds).alias("base"), start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), left.alias("left"), right.alias("right"), holds.alias("holds"))

        return _let(ahead, lambda at: F.transform(h, lambda value, i: one(value, i, at)))

    full = _let(hits, lambda h: _let(parts, lambda p: placed(h, p)))
    if name in GATED:
        full = F.filter(full, lambda x: x["holds"])
    can = {"": F.lit(True)}.get(need, F.contains(text, F.lit(need))) & text.rlike(pattern)
    return F.when(can, full).otherwise(F.array().cast(CANDIDATE))


CANDIDATE = "array<struct<kind:int,base:boolean,start:int,stop:int,value:string,left:string,right:string,holds:boolean>>"


def candidates(docs: DataFrame, text_col: str = "text", name: str = "candidates", words: dict[str, list[str]] = GAZETTEER) -> DataFrame:
    """``docs`` with the array of candidate spans of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = text.rlike("[0-9]|[(\\[]at[)\\]]") | F.contains(text, F.lit("@")) | text.rlike("(?i)token|passw|secret|api_?key") | text.rlike(r"\p{Lu}\p{Ll}+[ -]\p{Lu}")
    return docs.withColumn(name, F.when(some, F.concat(*[_found(n, text, words) for n in PATTERNS])).otherwise(F.array().cast(CANDIDATE)))


def _votes(x: Column, words: dict[str, list[str]] = GAZETTEER) -> Column:
    """Votes of the labelers, joined: one character each of +, - and 0."""
    vote = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    value, left, right = x["value"], x["left"], F.coalesce(x["right"], F.lit(""))
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*words["ending"])
    secret = value.rlike("^(?i:" + "|".join(words["credential"]) + ")")
    is_ = lambda k: x["kind"] == KINDS.index(k)
    first = F.regexp_extract(value, r"^(\p{L}+)", 1).isin(*words["first"])
    bank = F.left(value, F.lit(2)).isin(*words["bank"])
    street = F.regexp_extract(value, r"(\p{L}+)$", 1).isin(*words["street"])
    listed = (is_("email") & ending) | (is_("secret") & secret) | (is_("name") & first) | (is_("iban") & bank) | (is_("address") & street)
    unlisted = (is_("email") & ~ending) | (is_("name") & ~first) | (is_("iban") & ~bank)
    inside = left.rlike("[A-Za-z0-9_]$") | right.rlike("^[A-Za-z0-9_]")
    return F.concat(vote(x["holds"], ~x["holds"]), vote(listed, unlisted), vote(left.rlike(FOR), left.rlike(AGAINST)), vote(~inside, inside))


def _features(x: Column) -> Column:
    value, left, right = x["value"], x["left"], F.coalesce(x["right"], F.lit(""))
    sort = lambda c: F.when(c == "", "end").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike("\\s"), "space").otherwise("mark")
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    facts = {
        "kind": F.lit(""),
        "length": F.least(F.floor(F.length(value) / 4), F.lit(16)).cast("string"),
        "digits": F.floor(digits * 4 / F.length(value)).cast("string"),
        "left": sort(F.right(left, F.lit(1))),
        "right": sort(right),
        "holds": x["holds"].cast("string"),
        "announced": left.rlike(FOR).cast("string"),
        "parted": value.rlike("[ ()-]").cast("string"),
    }
    return F.array(*[F.concat_ws("|", x["kind"].cast("string"), F.lit(k), v) for k, v in facts.items()])


@dataclass
class Model:
    prior: dict[int, float] = field(default_factory=dict)  # share of real spans by kind
    worth: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)  # labeler, vote: rates in real and other spans
    weights: dict[str, float] = field(default_factory=dict)


def _estimate(counts: dict[tuple[int, str], int], rounds: int = 50) -> tuple[Model, dict[tuple[int, str], float]]:
    """EM over the counts of vote patterns; starts from each labeler being right in most cases."""
    m = Model({k: PRIOR for k, _ in counts}, {(name, v): {"+": (0.7, 0.3), "-": (0.1, 0.5), "0": (0.2, 0.2)}[v] for name in LABELERS for v in "+-0"})
    real: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        for kind, votes in counts:
            yes, no = m.prior[kind], 1 - m.prior[kind]
            for name, v in zip(LABELERS, votes, strict=True):
                if v != "0":  # an abstention says nothing
                    yes, no = yes * m.worth[name, v][0], no * m.worth[name, v][1]
            real[kind, votes] = yes / (yes + no)
        for k in m.prior:
            of = [(n, real[key]) for key, n in counts.items() if key[0] == k]
            m.prior[k] = (sum(n * p for n, p in of) + 3.5) / (sum(n for n, _ in of) + 5)
        for i, name in enumerate(LABELERS):
            total = [sum(n * (real[key] if y else 1 - real[key]) for key, n in counts.items() if key[1][i] != "0") for y in (1, 0)]
            for v, start in (("+", (0.7, 0.3)), ("-", (0.1, 0.5))):
                own = [sum(n * (real[key] if y else 1 - real[key]) for key, n in counts.items() if key[1][i] == v) for y in (1, 0)]
                m.worth[name, v] = tuple((o + 10 * s) / (t + 10) for o, t, s in zip(own, total, start, strict=True))
    return m, real


def train(found: DataFrame, name: str = "candidates", words: dict[str, list[str]] = GAZETTEER) -> Model:
    """Fits the labelers' worth and the span classifier on all candidates. Collects bounded counts only."""
    spans = found.select(F.explode(name).alias("x")).select(F.col("x.kind").alias("kind"), _votes(F.col("x"), words).alias("votes"), F.explode(_features(F.col("x"))).alias("feature"))
    rows = spans.groupBy("kind", "votes", "feature").agg(F.count("*").alias("n")).collect()
    counts: dict[tuple[int, str], int] = {}
    for r in rows:
        if r["feature"].endswith("|kind|"):
            counts[r["kind"], r["votes"]] = r["n"]
    m, real = _estimate(counts) if counts else (Model(), {})
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    for r in rows:
        p = real[r["kind"], r["votes"]]
        yes[r["feature"]] = yes.get(r["feature"], 0.0) + r["n"] * p
        no[r["feature"]] = no.get(r["feature"], 0.0) + r["n"] * (1 - p)
    for k in m.prior:  # a feature's rates are those among spans of its kind, rare ones drawn to their mean; the kind has the prior odds
        all_yes, all_no = (sum(n * (real[key] if y else 1 - real[key]) for key, n in counts.items() if key[0] == k) for y in (True, False))
        for f in (f for f in yes if f.startswith(f"{k}|")):
            mean = SMOOTHING * (yes[f] + no[f]) / max(all_yes + all_no, 1e-9)
            m.weights[f] = math.log((yes[f] + mean) / (all_yes + SMOOTHING)) - math.log((no[f] + mean) / (all_no + SMOOTHING))
        m.weights[f"{k}|kind|"] = math.log((all_yes + 1) / (all_no + 1))
    for k in set(range(len(KINDS))).difference(m.prior):
        m.weights[f"{k}|kind|"] = math.log(PRIOR / (1 - PRIOR))
    return m


def spans(found: Column, m: Model) -> Column:
    """All spans of a row as (kind, start, stop, base), by kind and place: strict ones, and those the classifier adds."""
    table = F.create_map(*[F.lit(v) for kv in m.weights.items() for v in kv]) if m.weights else F.create_map(F.lit(""), F.lit(0.0))
    score = lambda x: F.aggregate(_features(x), F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    base = F.filter(found, lambda x: x["base"])
    loose = F.filter(found, lambda x: ~x["base"] & x["holds"] & (score(x) > 0))

    def free(some: Column) -> Column:
        """Of all spans by place, the loose ones that no strict one overlaps, before (by its end) or after (by its start)."""
        stops = F.transform(some, lambda x: F.when(x["base"], x["stop"]).otherwise(0))
        starts = F.transform(F.reverse(some), lambda x: F.when(x["base"], -x["start"]).otherwise(-END))

        def kept(before: Column, after: Column) -> Column:
            n = F.size(some)
            return F.filter(some, lambda x, i: ~x["base"] & (F.get(before, i) <= x["start"]) & (-F.get(after, n - 1 - i) >= x["stop"]))

        return _let(running(stops, 0, F.greatest), lambda s: _let(running(starts, -END, F.greatest), lambda t: kept(s, t)))

    placed = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["base"].alias("base"))
    added = _let(loose, lambda some: F.when((F.size(some) == 0) | (F.size(base) == 0), F.transform(some, placed)).otherwise(_let(F.sort_array(F.transform(F.concat(base, some), placed)), free)))
    short = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["base"].alias("base"))
    return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(F.array_sort(F.concat(F.transform(base, short), F.transform(added, short))).cast(SPANS))


END = 2**31 - 2  # beyond any text
SPANS = "array<struct<kind:int,start:int,stop:int,base:boolean>>"


def named(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), kind)


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", named(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(docs: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by the name of its kind in angle brackets; a null text stays null."""
    keep = docs.columns
    text = F.col(text_col)
    own, placed = free_names(docs, "candidates", "spans")
    rows = candidates(docs, text_col, own).withColumn(placed, F.array_sort(spans(F.col(own), m), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"])))
    all_, last = F.col(placed), F.array_max(F.transform(placed, lambda s: s["stop"]))

    def joined(cut: Callable[[Column, Column], Column]) -> Column:
        """Pieces of text between the spans and the spans' kinds; a span whose start another one covers adds nothing."""
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(cut(at + 1, s["start"] - at), F.lit("<"), named(s["kind"]), F.lit(">"))).otherwise("")
        pieces = _let(running(F.transform(all_, lambda s: s["stop"]), 0, F.greatest), lambda at: F.transform(all_, lambda s, i: piece(s, F.get(at, i))))
        return F.concat(F.array_join(pieces, ""), cut(last + 1, F.length(text) - last))

    # a place in a text is found by walking there, so texts of many spans are cut into an array of characters once
    by_place = lambda chars: joined(lambda at, n: F.array_join(F.slice(chars, at, F.greatest(n, F.lit(0))), ""))
    new = F.when(F.size(all_) <= 64, joined(lambda at, n: text.substr(at, n))).otherwise(_let(F.split(text, ""), by_place))
    return rows.withColumn(text_col, F.when(F.size(placed) > 0, new).otherwise(text)).select(*keep)


def query(docs: DataFrame) -> DataFrame:
    found = stored(candidates(docs.select("doc_id", "text")).select("doc_id", "candidates"))
    m = train(found)
    rows = found.select("doc_id", spans(F.col("candidates"), m).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    of = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, F.lit(k)))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
