"""Queries over scans, and batch runs of the stateless cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import parquet_corpus
from ..streaming.live import cascade
from .decision_queries import T2
from .registry import query
from .text_queries import screened_sql


@query("select doc_id, text from documents where source is not null")
def parquet_scan(spark, d):
    return parquet_corpus(spark, f"{d}/documents.parquet", ["doc_id", "text", "no_such_column", "source"], needed="source").select("doc_id", "text")


@query("select count(*) as rows, count(distinct label) as labels from embeddings where embedding is not null")
def shard_scan(spark, d):
    return parquet_corpus(spark, [f"{d}/embeddings.parquet"], ["embedding", "label"], needed="embedding").agg(F.count("*").alias("rows"), F.countDistinct("label").alias("labels"))


@query(f"""with {screened_sql("(select conv_id, turn, text, cast(8 + conv_id % 8 as int) as child_age from conversations)")}, t as (select *, {T2} as threshold from scored)
 select conv_id, turn, lexicon_score as fused, case when lexicon_score >= 0.35 and lexicon_score >= threshold and category <> 'none' then 'hate' else 'not-hate' end as decision from t""")
def cascade_stream(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text", (8 + F.col("conv_id") % 8).cast("int").alias("child_age"))
    rows = c.withColumn("vision_score", F.lit(0.0)).withColumn("vision_calibrated", F.lit(False))
    return cascade(rows).select("conv_id", "turn", "fused", "decision")
