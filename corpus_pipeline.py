"""The corpus pipeline: five operators in a row, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_codec
from faultline.llm.common import noted, release, remove, stored
from faultline.llm.queries import model_path
from faultline.sources.tables import table

# intermediate tables of the stage that ran last
_tables: list[str] = []


def _stage(function):
    """A stage may remove what the stage before has stored: that one's result is written by now."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _tables)
        release(spark)
        with noted(_tables):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whatever language the model finds and how surely; texts that are null or have no letter go."""
    model = language_id.train(docs.filter(language_id.training_rows(docs)))
    if not model.languages:
        # no labelled row: every text would be undetermined
        return docs.filter(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    found = language_id.language_columns(docs, model, name="__language")
    return found.filter(F.col("__language.lang_pred") != language_id.UNDETERMINED).select(docs.columns)


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.keep_one(docs)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as its words are taken."""
    return mixing.mixed_documents(docs)


@_stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    return sentencepiece_codec.encode_documents(docs, model_path())


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", encoding_stage),
]

# the classifier, the similarity join, the seeded mix and the encoder are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            release(spark, before)
        docs = before = after
    return docs
