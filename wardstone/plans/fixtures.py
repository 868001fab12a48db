"""Views over the given tables that stand for checks, sessions, regions and cases. One SQL text serves both engines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class View:
    table: str
    columns: tuple[str, ...]
    where: str = "true"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where).selectExpr(*[re.sub(r"(\w+)\[(\d+)\]", r"element_at(\1, \2)", c) for c in self.columns])

    @property
    def sql(self) -> str:
        return f"(select {', '.join(self.columns)} from {self.table} where {self.where})"


RUNS = View("events", (
    "event_id as id", "ts", "user_id as device_id", "cast(8 + user_id % 8 as int) as child_age",
    "cast((event_id*7919) % 10000 as double)/10000 as text_score", "cast((event_id*104729) % 10000 as double)/10000 as vision_score",
    "event_id % 3 = 0 as vision_calibrated", "event_id % 2 = 0 as has_ocr", "event_id % 5 = 0 as has_asr",
    "case event_type when 'click' then 'bullying' when 'purchase' then 'threat' when 'error' then 'hate_identity' when 'signup' then 'profanity' else 'none' end as category",
    "concat('app', cast(event_id % 12 as string), '.exe') as app_exe", "value as total_ms", "props as modalities_json",
))
TICKS = View("events", (
    "user_id as device_id", "event_id as seq", "ts", "case when event_id % 13 = 0 then null else sha1(event_type) end as frame_hash",
    "(event_id % 7 = 0 or event_id % 13 = 0) as has_audio", "event_id % 11 = 0 as failed", "event_type as title",
))
TURNS = View("conversations", (
    "conv_id as session_id", "cast(8 + conv_id % 8 as int) as child_age",
    "case conv_id % 5 when 0 then 'hate_speech' when 1 then 'cyberbullying' when 2 then 'violence' when 3 then 'adult_content' else 'weapons' end as threat_type",
    "turn", "row_number() over (partition by conv_id order by turn) as child_turn", "text as child_response",
    "case (conv_id*7 + turn) % 8 when 0 then 'curious' when 1 then 'defensive' when 2 then 'scared' when 3 then 'compliant' when 4 then 'frustrated' when 5 then 'neutral' when 6 then 'reflective' else 'angry' end as raw_emotion",
), "role = 'user'")
REGIONS = View("lineitem", (
    "l_orderkey as frame_id", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as ord",
    "concat(l_returnflag, ' ', l_linestatus) as text", "l_discount*4 as x0", "l_tax*5 as y0", "l_discount*4 + l_quantity/100 as x1", "l_tax*5 + 0.2 as y1",
    "l_quantity/50 as conf", "case when l_linenumber = 7 then 'picture' else 'text' end as kind",
))
#: Labels of two model heads from a vector's first numbers.
HEADS = View("embeddings", (
    "vec_id", "label", *[f"least(1.0, abs(cast(embedding[{i}] as double))*4) as {n}" for i, n in ((1, "toxic"), (2, "threat"), (3, "insult"), (4, "hate"))],
))
SEGMENTS = View("events", ("event_id", "user_id as clip", "cast((event_id*31)%100 as double)/100 as no_speech_prob", "-cast((event_id*17)%200 as double)/100 as avg_logprob", "event_type as text"))
CHUNKS = View("events", ("user_id as device_id", "row_number() over (partition by user_id order by event_id) as seq", "4000 as n", "value*value*4000/1000000 as sumsq"))
FEATURES = View("part", ("p_partkey as frame_id", "p_name as title", "cast(p_size as double)/100 as skin_ratio", "p_partkey % 25 as motion", "p_type in ('SMALL', 'MEDIUM') as has_person", "p_partkey % 9 = 0 as long_shape"))
FLAGS = View("documents", ("doc_id", "text", "lang", "doc_id % 17 = 0 as threat", "doc_id % 7 = 0 as identity", "doc_id % 5 = 0 as insult", "doc_id % 11 = 0 as severe", "doc_id % 3 as class", "doc_id % 3 as hatespeech", "doc_id % 5 as violence", "(doc_id*3) % 5 as insult_rank"))
#: Fixed now of retention queries.
NOW = "2024-01-31 00:00:00"


def r4(x: str, places: int = 4) -> str:
    """Half-up rounding in SQL, by way of decimals."""
    return f"cast(round(cast({x} as decimal(18,8)), {places}) as double)"
