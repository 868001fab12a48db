"""The table of runs: writing with defaults, tolerant reading, retention, listings, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import clock
from .decide import mapped, threshold
from .rules import THREAT_TYPE

RUN_COLUMNS = {"id": "string", "ts": "timestamp", "device_id": "long", "decision": "string", "category": "string", "score": "double", "child_age": "int", "app_exe": "string", "ocr_snippet": "string", "modalities_json": "string", "thumb_jpeg": "binary"}
DEFAULTS: dict[str, object] = {"decision": "unknown", "category": "none", "score": 0.0, "app_exe": "", "ocr_snippet": "", "modalities_json": "{}"}


def conform(df: DataFrame, columns: dict[str, str] = RUN_COLUMNS) -> DataFrame:
    """The wanted columns in order; those that an older table lacks are typed nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def with_defaults(df: DataFrame) -> DataFrame:
    out = conform(df)
    for c, v in DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out.withColumn("id", F.coalesce("id", F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in RUN_COLUMNS if c != "thumb_jpeg"]))))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all files, whatever columns each has."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path))


def decoded(text: Column, schema: str, empty: Column) -> Column:
    """JSON text as a value; what is missing or broken is the empty value."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), empty)


def newest(df: DataFrame, limit: int, most: int = 200) -> DataFrame:
    """Newest rows, between 1 and ``most``; equal times by id."""
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(most, limit)))


def latest(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(F.struct("*"), F.struct("ts", "id")).alias("r")).select("r.*")


def retained(df: DataFrame, now: Column, hours: int = 24, days: int = 30, rows: int = 5000, thumb: str = "thumb", bucket: int = 3600) -> DataFrame:
    """Thumbs older than ``hours`` become null, rows older than ``days`` go, the newest ``rows`` stay.

    The cap needs no global order: counts by hour find the hour in which it falls; only that hour's rows are ranked.
    """
    kept = df.where(F.col("ts") >= now - F.expr(f"interval {days} days"))
    hour = F.floor(F.unix_timestamp("ts") / bucket)
    sizes = kept.groupBy(hour.alias("__hour")).agg(F.count("*").alias("__n"))
    newer = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__newer", newer).where(F.col("__newer") < rows)
    joined = kept.withColumn("__hour", hour).join(sizes, "__hour")
    whole = joined.where(F.col("__newer") + F.col("__n") <= rows)
    rank = F.row_number().over(Window.partitionBy("__hour").orderBy(F.desc("ts"), F.desc("id")))
    edge = joined.where(F.col("__newer") + F.col("__n") > rows).withColumn("__rank", rank).where(F.col("__newer") + F.col("__rank") <= rows).drop("__rank")
    out = whole.union(edge).drop("__hour", "__n", "__newer")
    return out.withColumn(thumb, F.when(F.col("ts") >= now - F.expr(f"interval {hours} hours"), F.col(thumb)))


def retention_report(df: DataFrame, now: Column, hours: int = 24, days: int = 30, rows: int = 5000, thumb: str = "thumb") -> DataFrame:
    """What retention removes, in one pass."""
    old = F.col("ts") < now - F.expr(f"interval {days} days")
    stale = ~old & (F.col("ts") < now - F.expr(f"interval {hours} hours")) & F.col(thumb).isNotNull()
    kept = F.count_if(~old)
    return df.agg(F.count_if(stale).alias("thumbs"), F.count_if(old).alias("expired"), F.greatest(F.lit(0), kept - rows).cast("long").alias("over_cap"))


def list_view(df: DataFrame) -> DataFrame:
    """Rows without what only the detail view shows."""
    return df.drop("thumb_jpeg", "trace_json").withColumn("evidence", F.col("evidence").dropFields("detections"))


def source_flags(ocr: Column, asr: Column, vision_share: Column, audio_share: Column) -> Column:
    """Where a run's evidence came from: read, heard (a transcript, or a share of sound) and seen."""
    has, counts = (lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), (lambda c: F.coalesce(c, F.lit(0.0)) > 0.05)
    return F.struct(has(ocr).alias("ocr"), (has(asr) | counts(audio_share)).alias("asr"), counts(vision_share).alias("vision"), F.lit(False).alias("overlay"))


def effective_threshold(envelope: Column, age: Column) -> Column:
    """The threshold that a stored envelope says was applied, else the age's; a missing age is ten."""
    number = F.get_json_object(envelope, "$.payload.persona_threshold").try_cast("double")
    return F.when(number > 0, number).otherwise(threshold(F.coalesce(F.nullif(age, F.lit(0)), F.lit(10))))


STORED = {"id": "string", "ts": "string", "child_age": "int", "decision": "string", "score": "double", "category": "string", "ocr_snippet": "string", "transcript_snippet": "string", "modalities_json": "string", "app_exe": "string", "child_safe_summary": "string", "recommended_action": "string", "envelope_json": "string"}
_OPEN = "image double, audio double"


def dashboard_row(df: DataFrame) -> DataFrame:
    """The dashboard's columns of stored runs, whatever columns they have; a hate row without a category counts as hate
    against a group."""
    df = conform(df, STORED)
    text = lambda c, default="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    hate_without = (F.col("decision") == "hate") & (text("category", "none") == "none")
    share = decoded(F.col("modalities_json"), _OPEN, F.struct(F.lit(0.0).alias("image"), F.lit(0.0).alias("audio")))
    age = F.coalesce(F.nullif("child_age", F.lit(0)), F.lit(10))
    return df.select(
        text("id").alias("id"), text("ts").alias("timestamp"), clock(text("ts")).alias("time_str"), age.alias("child_age"), text("decision", "not-hate").alias("decision"), F.coalesce("score", F.lit(0.0)).alias("risk_score"),
        F.when(hate_without, "hate_identity").otherwise(text("category", "none")).alias("category"), text("ocr_snippet").alias("ocr_text"), text("transcript_snippet").alias("transcript"), F.lit("").alias("overlay_text"),
        source_flags(F.col("ocr_snippet"), F.col("transcript_snippet"), share["image"], share["audio"]).alias("source"), text("app_exe", "unknown").alias("session_hint"), text("app_exe", "unknown").alias("app_exe"),
        text("child_safe_summary").alias("child_safe_summary"), text("recommended_action").alias("recommended_action"), effective_threshold(F.col("envelope_json"), F.col("child_age")).alias("persona_threshold"),
    )


def verdicts(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """For each request (request, run_id or null) the named run, else the latest; harm counts only where it decided hate."""
    last = latest(runs.select("id", "ts", "decision", "score", "category")).select(F.struct("id", "decision", "score", "category").alias("last"))
    named = runs.select(F.col("id").alias("run_id"), F.struct("id", "decision", "score", "category").alias("own"))
    both = requests.join(named, "run_id", "left").join(F.broadcast(last), F.lit(True), "left")  # the latest run is one row
    r = F.when(F.col("run_id").isNull(), F.col("last")).otherwise(F.col("own"))
    hate = F.coalesce(r["decision"] == "hate", F.lit(False))
    return both.select("request", r["id"].alias("found"), hate.alias("verdict"), F.when(hate, r["score"]).otherwise(0.0).alias("harm"), F.when(hate, r["category"]).otherwise("none").alias("category"))


def trigger(*, nsfw: Column, adult: Column, violence: Column, weapons: Column, hate: Column, verdict: Column, verdict_category: Column, verdict_score: Column) -> Column:
    """Struct of threat type and risk of a trigger, in order of precedence. A verdict isn't held against a threshold again: its
    category names the type and its score is the risk; without one only a hate score over 0.8 counts. No threat is ``none``."""
    adult, verdict = F.greatest(nsfw, adult), F.coalesce(verdict, F.lit(False))
    hate = F.when(verdict, verdict_score).otherwise(F.coalesce(hate, F.lit(0.0)))
    named = F.when(verdict, F.coalesce(mapped(THREAT_TYPE, verdict_category), F.lit("hate_speech"))).otherwise("hate_speech")
    cases = [(adult > 0.8, F.lit("adult_content"), adult), (violence > 0.8, F.lit("violence"), violence), (verdict | (hate > 0.8), named, hate), (weapons > 0.75, F.lit("weapons"), weapons)]
    kind, risk = F.lit("none"), F.lit(0.0)
    for when, name, score in reversed(cases):
        kind, risk = F.when(when, name).otherwise(kind), F.when(when, score).otherwise(risk)
    return F.struct(kind.alias("threat"), risk.alias("risk"))


def preferred(live: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Live rows, and legacy ones of keys that have no live row."""
    return live.unionByName(legacy.join(live.select(key).distinct(), key, "left_anti"))


def struct_of(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in columns.items()))
