"""Evaluation of scorers: case sets, adapters, splits, metrics, sweeps, failures and attributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_bucket, content_split, r4, squeeze

CASES = ["case_id", "text", "hate", "category", "bucket"]


def union_cases(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(CASES)
    for s in sets[1:]:
        out = out.unionByName(s.select(CASES))
    return out


def _case(df: DataFrame, key: str, text: str, category: Column, bucket: Column, most: int) -> DataFrame:
    """Cases of the rows that have a category, their texts squeezed; blank texts and those over ``most`` characters go."""
    rows = df.select(F.col(key).alias("case_id"), squeeze(F.coalesce(text, F.lit(""))).alias("text"), category.alias("category"), bucket.alias("bucket"))
    rows = rows.where(F.col("category").isNotNull() & (F.col("text") != "") & (F.length("text") <= most))
    return rows.select("case_id", "text", (F.col("category") != "none").alias("hate"), "category", "bucket")


#: The bucket of a corpus's cases of each category.
BUCKETS = {"threat": "threat", "hate_identity": "implicit", "bullying": "bullying", "none": "benign"}


def _bucket(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in BUCKETS.items() for v in kv]), category)


def from_flags(df: DataFrame, key: str, text: str, most: int = 600) -> DataFrame:
    """Cases of a corpus with flags; rows that are only toxic in general are dropped."""
    category = F.when(F.col("threat"), "threat").when(F.col("identity"), "hate_identity").when(F.col("insult") | F.col("severe"), "bullying").when(~F.col("toxic"), "none")
    return _case(df, key, text, category, _bucket(category), most)


def from_class(df: DataFrame, key: str, text: str, most: int = 600) -> DataFrame:
    """Cases of a three-class corpus: 0 harm, 2 (and none) benign, 1 dropped."""
    number = F.coalesce("class", F.lit(2))
    category = F.when(number == 0, "hate_identity").when(number == 2, "none")
    return _case(df, key, text, category, _bucket(category), most)


def from_ordinal(df: DataFrame, key: str, text: str, most: int = 600) -> DataFrame:
    """Cases of a corpus with graded ratings; what is neither clearly harmful nor benign is dropped."""
    h, violence, insult = F.coalesce("hatespeech", F.lit(1)), F.coalesce("violence", F.lit(0)), F.coalesce("insult_rank", F.lit(0))
    category = F.when((h >= 2) & (violence >= 3), "threat").when(h >= 2, "hate_identity").when((h <= 0) & (insult < 3), "none")
    return _case(df, key, text, category, _bucket(category), most)


def in_split(df: DataFrame, split: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """Rows of a split by content hash; at most ``limit``, in order of the hash, after the split."""
    rows = df.where(content_split(F.col(text)) == split)
    return rows if limit is None else rows.orderBy(content_bucket(F.col(text)), F.sha1(F.col(text).cast("binary")), "case_id").limit(limit)


def balanced(df: DataFrame, n: int, order: str = "case_id") -> DataFrame:
    """n / 2 rows of each class, the classes in turn (rank, harm first)."""
    halves = [df.where(F.col("hate") == v).orderBy(order).limit(n // 2) for v in (True, False)]
    rank = F.row_number().over(Window.partitionBy("hate").orderBy(order))  # over n / 2 rows
    return halves[0].union(halves[1]).withColumn("rank", rank)


def described(df: DataFrame) -> DataFrame:
    """Usable, harmful and benign rows: in all, by bucket, by split."""
    rows = df.withColumn("split", content_split(F.col("text")))
    return rows.groupingSets([[], ["bucket"], ["split"]], "bucket", "split").agg(F.count("*").alias("usable"), F.count_if("hate").alias("harmful"), F.count_if(~F.col("hate")).alias("benign"))


def scored(cases: DataFrame, scorers: dict[str, Column]) -> DataFrame:
    """(case_id, hate, bucket, scorer, score) for each scorer; a scorer that fails gives 0."""
    wide = cases.select("case_id", "hate", "bucket", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in scorers.items()])
    return wide.unpivot(["case_id", "hate", "bucket"], list(scorers), "scorer", "score")


def scored_by(cases: DataFrame, name: str, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same for a scorer of whole frames (adds ``score``)."""
    return scorer(cases).select("case_id", "hate", "bucket", F.lit(name).alias("scorer"), F.coalesce("score", F.lit(0.0)).alias("score"))


def provenance(cases: DataFrame, registry: DataFrame, by: str) -> DataFrame:
    """Cases and harmful ones of each corpus beside its entry in the registry, a small table by ``key``; without one the entry
    is null."""
    counted = cases.groupBy(by).agg(F.count("*").alias("cases"), F.count_if("hate").alias("harmful"))
    return counted.join(F.broadcast(registry), F.col(by) == F.col("key"), "left").drop("key")


def with_rates(cells: DataFrame) -> DataFrame:
    """Adds the rates of tp, fp, tn and fn; a rate without rows is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: r4(F.when(b > 0, a / b).otherwise(0.0))
    return cells.withColumns({"accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "fp_rate": rate(fp, fp + tn)})


def confusion(rows: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """Counts and rates of hits against labels."""
    y = F.col("hate")
    return with_rates(rows.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn")))


def sweep(rows: DataFrame, thetas: Sequence[float], by: Sequence[str] = ("scorer",)) -> DataFrame:
    """Confusion of every group at every theta. Rows are counted once, by how many thetas their score reaches; what a theta
    flags is the sum of the counts from its own on. Rows without a score count nowhere."""
    order = sorted({float(t) for t in thetas})
    reached = F.size(F.filter(F.lit(order), lambda t: F.col("score") >= t))
    counted = rows.where(F.col("score").isNotNull()).groupBy(*by, reached.alias("__n")).agg(F.count_if("hate").alias("__hate"), F.count_if(~F.col("hate")).alias("__rest"))
    # one row for each group, theta and number of thetas from here on
    each = counted.select("*", F.posexplode(F.lit(order)).alias("__i", "theta"))
    hit = F.col("__n") > F.col("__i")
    total = lambda when, n: F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
    cells = each.groupBy(*by, "theta").agg(total(hit, "__hate").alias("tp"), total(hit, "__rest").alias("fp"), total(~hit, "__rest").alias("tn"), total(~hit, "__hate").alias("fn"))
    return with_rates(cells)


def by_persona(rows: DataFrame, limits: dict[str, float], by: Sequence[str] = ("scorer",)) -> DataFrame:
    """Confusion of every group at the threshold of each persona, from one count of the rows."""
    found = sweep(rows, list(limits.values()), by)
    named = F.array_compact(F.array(*[F.when(F.col("theta") == v, F.lit(n)) for n, v in limits.items()]))
    return found.withColumn("persona", F.explode(named))


def failures(rows: DataFrame, theta: float, buckets: Sequence[str], most: int = 5) -> DataFrame:
    """False alarms in the sensitive buckets and misses, the worst ``most`` of each for each scorer."""
    kind = F.when((F.col("score") >= theta) & ~F.col("hate") & F.col("bucket").isin(list(buckets)), "false_alarm").when((F.col("score") < theta) & F.col("hate"), "missed")
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("error", F.abs(F.col("score") - theta))
    rank = F.row_number().over(Window.partitionBy("scorer", "kind").orderBy(F.desc("error"), "case_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("scorer", "kind", "rank", "case_id", "score")


def latencies(df: DataFrame, by: str, ms: str) -> DataFrame:
    """Median, and the nearest-rank 95th percentile at index half-even of 0.95 (n - 1).

    Values are counted first. Running counts go over the values of a range (64 for each power of two) and over the ranges,
    so a group with a third of all rows is no task's.
    """
    part = F.floor(F.signum("v") * F.floor(F.log2(1 + F.abs("v")) * 64)).alias("part")
    counts = df.where(F.col(ms).isNotNull()).groupBy(by, F.col(ms).alias("v")).agg(F.count("*").alias("c")).select("*", part)
    parts = counts.groupBy(by, "part").agg(F.sum("c").alias("all"))
    upto = F.sum("all").over(Window.partitionBy(by).orderBy("part")) - F.col("all")
    parts = parts.select(by, "part", upto.alias("before"), F.sum("all").over(Window.partitionBy(by)).alias("n"))
    inside = F.sum("c").over(Window.partitionBy(by, "part").orderBy("v"))
    ranked = counts.withColumn("inside", inside).join(parts, [by, "part"]).select(by, "v", "c", (F.col("inside") + F.col("before")).alias("upto"), "n")
    at = F.bround(0.95 * (F.col("n") - 1), 0)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    first = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    return ranked.groupBy(by).agg(r4((first(low) + first(high)) / 2).alias("median"), r4(first(at)).alias("p95"), F.first("n").alias("n"))


def rules_by_label(cases: DataFrame, hits: str = "hits") -> DataFrame:
    """How often each rule fires on harmful and on benign cases."""
    return cases.select("hate", F.explode(hits).alias("rule")).groupBy("rule").agg(F.count_if("hate").alias("harmful"), F.count_if(~F.col("hate")).alias("benign"))


def attribution(cases: DataFrame, theta: float) -> DataFrame:
    """False alarms by what caused them: rules, a model, both, or neither alone."""
    lex, model = F.col("lexicon") >= theta, F.col("model") >= theta
    cause = F.when(lex & model, "both").when(lex, "rule").when(model, "model").otherwise("neither")
    # counted, not filtered by score: Spark would put that filter under the screening, which then ran twice, on all texts at first
    n = F.count_if(F.greatest("lexicon", "model") >= theta)
    return cases.where(~F.col("hate")).groupBy(cause.alias("cause")).agg(n.alias("n")).where("n > 0")


def expectations(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """ok, MISMATCH or skip for each expected case; ``any`` accepts every decision."""
    both = expected.join(results, key, "left")
    state = F.when(F.col("decision").isNull(), "skip").when((F.col("expect") == "any") | (F.col("expect") == F.col("decision")), "ok").otherwise("MISMATCH")
    return both.select(key, state.alias("state"))


def grades(rows: DataFrame, grade: str, by: Column, least: int = 3) -> DataFrame:
    """Mean of a grade and the share at or over ``least``, by outcome."""
    return rows.groupBy(by.alias("outcome")).agg(r4(F.avg(grade)).alias("mean"), r4(F.avg(F.when(F.col(grade) >= least, 1.0).otherwise(0.0))).alias("share"), F.count("*").alias("n"))
