"""A corpus pipeline over the documents table, one operator per stage.

Each stage reads what its predecessor wrote, works on all of it, and returns the columns of the documents; the last one
adds the ids of the encoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.scale import work_path
from ragloom.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from ragloom.llm.common import packed

#: A text is rejected when no language is at least so many times as probable as chance (1 / number of languages).
LEAST_ODDS = 1.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that the network finds no more like any language than chance would.

    Even mixtures of some of the languages stay. The network learns from the labelled documents of the stage's own input; without any, nothing is rejected.
    """
    model = language_id.train(docs.filter(F.col("lang").isNotNull()))
    if model is None:
        return docs
    judged = language_id.predict(packed(docs, F.col("text")), model, keep=["row"])
    least = LEAST_ODDS / len(model.languages) if len(model.languages) > 1 else 0.0
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least)).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the document with the smallest id stays."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; documents of a source that is short are repeated up to three times."""
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations (`ids`) of all texts, and whether they decode to the same bytes."""
    pieces = sentencepiece_codec.load_pieces()
    return sentencepiece_codec.round_trip(docs, pieces)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = work_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
