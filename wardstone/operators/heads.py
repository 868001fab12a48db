"""Heads that score texts: a trained one, and users' own functions over texts, pictures and sound that never fail the job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.batches import slices, tuned
from ..functions.text import normalize, r4


WORDS = "__words_tf"


def word_counts(df: DataFrame, text: str = "text", features: int = 1 << 16) -> DataFrame:
    """``df`` with the counts of its texts' hashed words (WORDS), all that a head reads of a text. Stored, they spare
    training and scoring the same texts a pass over these each."""
    from pyspark.ml.feature import HashingTF, Tokenizer

    out = Tokenizer(inputCol="__base", outputCol="__words").transform(df.withColumn("__base", normalize(F.coalesce(text, F.lit("")))))
    return HashingTF(inputCol="__words", outputCol=WORDS, numFeatures=features).transform(out).select(*df.columns, WORDS)


def train_text_head(cases: DataFrame, text: str = "text", target: str = "hate", features: int = 1 << 16) -> Callable[[DataFrame], DataFrame]:
    """Trains on (text, hate); the head adds ``score`` and ``labels`` (toxic, nothate) to any frame with texts. Frames that have
    WORDS need no text."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF
    from pyspark.ml.functions import vector_to_array

    counted = lambda df: df if WORDS in df.columns else word_counts(df, text, features)
    rows = counted(cases).select(WORDS, F.col(target).cast("double").alias("__y"))
    model = Pipeline(stages=[IDF(inputCol=WORDS, outputCol="features"), LogisticRegression(labelCol="__y", regParam=0.01, maxIter=50)]).fit(rows)

    def head(df: DataFrame) -> DataFrame:
        out = model.transform(counted(df))
        p = r4(F.get(vector_to_array("probability"), 1))
        labels = F.array(F.struct(F.lit("toxic").alias("label"), p.alias("score")), F.struct(F.lit("nothate").alias("label"), (1 - p).alias("score")))
        return out.withColumn("score", p).withColumn("labels", labels).select(*df.columns, "score", "labels")

    return head


_made: dict[str, object] = {}


def typed(make: Callable[[], Callable[[object], object]], kind: str) -> Callable[[Column], Column]:
    """A user's function over values of a column, binary ones too, whose results have the type ``kind`` (a vector, segments of
    speech, a score): struct of value and error. ``make`` runs once in each worker process, which keeps what it returns; where
    it fails every row has the reason, where a value fails or has a wrong type that row has it, and the value is null. Values
    that are null are given to the function like any other."""
    tuned()
    arrow = to_arrow_type(DataType.fromDDL(kind))
    key = uuid.uuid4().hex

    @F.arrow_udf(f"value {kind}, error string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _made:
            try:
                _made[key] = (make(), None)
            except Exception as e:  # noqa: BLE001
                _made[key] = (None, f"failed: {type(e).__name__}")
        function, broken = _made[key]
        for values in batches:
            parts = []
            for some in slices(values):
                found, errors = [], []
                for v in some.to_pylist():
                    try:
                        found.append(pa.scalar(function(v), arrow).as_py() if function else None)
                        errors.append(broken)
                    except Exception as e:  # noqa: BLE001
                        found.append(None)
                        errors.append(f"failed: {type(e).__name__}")
                parts.append(pa.StructArray.from_arrays([pa.array(found, arrow), pa.array(errors, pa.string())], ["value", "error"]))
            yield pa.concat_arrays(parts)

    return run


def isolated(make: Callable[[], Callable[[object], float]]) -> Callable[[Column], Column]:
    """A user's scorer as a column function: struct of score and error."""

    def scorer() -> Callable[[object], float]:
        score = make()
        return lambda v: float(score(v))

    run = typed(scorer, "double")

    def scored(column: Column) -> Column:
        r = run(column)
        return F.struct(r["value"].alias("score"), r["error"].alias("error"))

    return scored


#: Segments of speech as a transcriber gives them.
SPEECH = "array<struct<text:string,no_speech_prob:double,avg_logprob:double>>"


def embedded(df: DataFrame, content: str, make: Callable[[], Callable[[bytes], list[float]]], name: str = "vector") -> DataFrame:
    """Adds the vector of a binary column, null where the content can't be read, and the reason as ``<name>_note``."""
    return df.withColumn(name, typed(make, "array<float>")(F.col(content))).withColumn(f"{name}_note", F.col(name)["error"]).withColumn(name, F.col(name)["value"])


def transcribed(df: DataFrame, content: str, key: str, make: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """(clip, place, text, no_speech_prob, avg_logprob): the segments of each clip's sound in order, for ``evidence.transcripts``;
    clips that can't be read have none."""
    found = df.select(F.col(key).alias("clip"), typed(make, SPEECH)(F.col(content)).alias("r"))
    return found.select("clip", F.posexplode("r.value").alias("place", "s")).select("clip", "place", "s.*")


def head_on_rest(df: DataFrame, lexicon: str, head: Callable[[DataFrame], DataFrame], skip: float = 0.88) -> DataFrame:
    """Asks the head only for rows under ``skip``; a Python head in a CASE would run on every row."""
    sure = df.where(F.col(lexicon) >= skip).withColumn("model_score", F.lit(None).cast("double"))
    rest = head(df.where(F.col(lexicon) < skip)).withColumn("model_score", F.col("score")).select(*sure.columns)
    return sure.unionByName(rest)
