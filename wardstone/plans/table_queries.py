"""Queries over tables that are written, changed and read again: batches, retention, replacement, look-ups, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import evaluation as E
from ..operators import table
from ..sources import readers
from ..sources.scratch import folder
from .decision_queries import DECIDED
from .evaluation_queries import CASES
from .fixtures import NOW, RUNS, TURNS
from .registry import query


def _run_rows(spark, d):
    r = D.decided(RUNS.df(spark, d)).withColumn("risk", F.col("risk").cast("double"))
    return r.select(F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "device_id", "decision", "category", F.col("risk").alias("score"), "child_age", "app_exe", F.when(F.col("id") % 3 != 0, F.col("app_exe").cast("binary")).alias("thumb_jpeg"))


def _written(spark, d, parts: int = 3) -> str:
    """The runs as a table of three batches, the first of them tried twice."""
    path, rows = folder(spark, "runs"), _run_rows(spark, d)
    for k in (0, *range(parts)):
        table.write_batch(rows.where(F.crc32(F.col("id").cast("binary")) % parts == k), path, f"stream-{k}")
    return path


@query(f"with {DECIDED} select cast(id as varchar) as id, decision, risk as score, app_exe from decided")
def stored_batches(spark, d):
    return table.read(spark, _written(spark, d)).select("id", "decision", "score", "app_exe")


@query(f"with r as (select id, ts, case when id % 3 <> 0 then app_exe end as thumb from {RUNS.sql} x), k as (select *, row_number() over (order by ts desc, cast(id as varchar) desc) as rn from r where ts >= timestamp '{NOW}' - interval 20 days) select cast(id as varchar) as id, case when ts >= timestamp '{NOW}' - interval 24 hours then thumb end as thumb from k where rn <= 4000")
def stored_retention(spark, d):
    """Retention on the stored table: the rows that are left in its files."""
    path = _written(spark, d)
    table.prune(spark, path, F.to_timestamp(F.lit(NOW)), days=20, rows=4000)
    return table.read(spark, path).select("id", F.col("thumb_jpeg").cast("string").alias("thumb"))


_session = f"select session_id, max(turn) as turn, count(*) as n from {TURNS.sql} t group by session_id"


@query(f"with s as ({_session}) select session_id, turn + case when session_id % 3 = 0 then 10 else 0 end as turn, case when session_id % 3 = 0 then n + 1 else n end as n from s union all select session_id + 1000000, turn, n from s where session_id % 3 = 0 and session_id % 2 = 0")
def stored_sessions(spark, d):
    """Sessions replaced by key: a third of them anew, a sixth added; stale updates change nothing."""
    s = TURNS.df(spark, d).groupBy("session_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n"))
    path, third = folder(spark, "sessions"), F.col("session_id") % 3 == 0
    table.upsert(s, path, "session_id", "turn", 16)
    changed = s.where(third).withColumn("turn", F.col("turn") + 10).withColumn("n", F.col("n") + 1)
    added = s.where(third & (F.col("session_id") % 2 == 0)).withColumn("session_id", F.col("session_id") + 1_000_000)
    table.upsert(changed.union(added), path, "session_id", "turn", 16)
    table.upsert(s.where(third), path, "session_id", "turn", 16)
    return spark.read.parquet(path).select("session_id", "turn", "n")


@query(f"with {DECIDED} select cast(id as varchar) as id, decision, category from decided where id in (select max(event_id) from events union all select min(event_id) from events)")
def stored_lookup(spark, d):
    """Runs by id from sorted files with Bloom filters."""
    e = spark.read.parquet(f"{d}/events.parquet").agg(F.min("event_id"), F.max("event_id")).first()
    return table.by_id(spark, _written(spark, d), [str(i) for i in e]).select("id", "decision", "category")


@query("select vec_id, len(embedding) as dim from embeddings")
def cached_vectors(spark, d):
    """Vectors from a table that is built once; asking for more rows than it has builds a new version beside it."""
    path, e = folder(spark, "vectors"), spark.read.parquet(f"{d}/embeddings.parquet")
    n = e.count()
    readers.cached(spark, path, 1, lambda: e.limit(n // 2))
    return readers.cached(spark, path, n, lambda: e).select("vec_id", F.size("embedding").alias("dim"))


@query("select doc_id, md5(text) as text, lang from documents")
def csv_corpus(spark, d):
    """Texts with quotes and line breaks through a CSV file."""
    path = folder(spark, "csv")
    spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return readers.csv_corpus(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang")


@query(f"select cast(session_id as varchar) as session_id, count(*) as turns, md5(string_agg(child_response, '|' order by turn)) as texts from {TURNS.sql} t group by session_id")
def json_history(spark, d):
    """Sessions with their turns through JSON documents."""
    path = folder(spark, "history")
    turn = F.struct(F.col("turn").cast("int").alias("turn"), "child_response", F.lit(None).cast("string").alias("reply"), F.col("raw_emotion").alias("child_emotion"))
    s = TURNS.df(spark, d).groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    readers.write_history(s, path)
    h = readers.history(spark, path, lines=True)
    return h.select("session_id", F.size("turns").cast("long").alias("turns"), F.md5(F.array_join(F.transform("turns", lambda t: t["child_response"]), "|")).alias("texts"))


_names = {"de": ("corpus-de", "C1"), "en": ("corpus-en", "C2"), "fr": ("corpus-fr", "C3")}
_case = lambda k: "case bucket " + " ".join(f"when '{b}' then '{v[k]}'" for b, v in _names.items()) + " end"


@query(f"with c as {CASES} select bucket, {_case(0)} as file, {_case(1)} as citation, count(*) as cases, count_if(hate) as harmful from c group by bucket")
def corpus_provenance(spark, d):
    """Cases by corpus with the file and the citation that they come from; a corpus that isn't registered keeps its cases."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    cases = docs.join(labels, "doc_id").select(F.col("lang").alias("bucket"), (F.col("toxic") == 1).alias("hate"))
    registry = readers.corpora(spark, [(k, f, c, "") for k, (f, c) in _names.items()])
    return E.provenance(cases, registry, "bucket").select("bucket", "file", "citation", "cases", "harmful")


@query("select count(*) as removed, 0 as left from events")
def stored_purge(spark, d):
    """A purged table: how many rows went, and how many are left."""
    path = _written(spark, d)
    removed = table.purge(spark, path)
    return spark.range(1).select(F.lit(removed).cast("long").alias("removed"), F.lit(table.read(spark, path).count() if table.exists(spark, path) else 0).cast("long").alias("left"))
