"""A pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm import decontamination, langid, pieces, pii, simhash
from wardstone.llm.common import free_names, stored, table, tuned

#: Texts whose score is below this consist of letter groups that no language uses.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no learned language. Null and empty texts go; equal rows share a fate; a
    null language teaches nothing; without any language all texts go."""
    tuned(spark)
    out = langid.held_out()
    filters = langid.learn(docs.where(~F.coalesce(out, F.lit(False))))
    lang, score = free_names(docs, "lang_pred", "score")
    found = langid.predict(docs, filters, names=(lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest id. Texts without a word (null, empty,
    white space) are one group, of which one row stays; rows of equal id and group all stay; a group without any id too."""
    tuned(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote a benchmark item go. Null and empty texts stay; of rows with one id all go if one quotes."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind. Every row stays; null texts stay null; equal texts are masked alike."""
    model = pii.train(pii.candidates(docs.select("text")))
    out = pii.masked(docs, model)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator's sampled segmentations of every text, as piece ids, in one row for each row. A null or empty text has
    one empty segmentation."""
    tuned(spark)
    return pieces.segmentations(docs, pieces.model_path(), keep=False, together=True)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("personal_data", personal_data), ("piece_ids", piece_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
