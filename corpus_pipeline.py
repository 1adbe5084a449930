"""The corpus pipeline: documents in, packed training sequences out.

Every stage is (name, function of (spark, docs, sf_dir)); it works on all that its predecessor kept. All stages but
the last return the columns of documents; the last one returns the pieces of the packed sequences.

The result of a stage is stored before the next one begins, so each stage first deletes the intermediate tables of the
one before it, unless its input still reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyworth.llm import exact_dedup, jaccard, language, mixing, packing
from tallyworth.llm.common import table
from tallyworth.session import discard, recorded, written_at

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# The intermediate tables of the last stage, by application.
_left: dict[str, list[str]] = {}


def _stage(function: Stage) -> Stage:
    """The stage, after the tables that the stage before it left are gone."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        read = docs.inputFiles()
        # A caller that has not stored the last result still reads from its tables.
        needed = [path for path in _left.pop(app, []) if any(path in file for file in read) or not discard(spark, path)]
        with recorded() as paths:
            found = function(spark, docs, sf_dir)
        _left[app] = needed + paths
        return found

    return run_stage


@_stage
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose main language makes up most of the text; the others go."""
    return language.known_language(docs, language.train(language.learning_rows(docs)))


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.exact_dedup(docs)


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more (shingles of five words) join."""
    return jaccard.one_of_each(docs)


@_stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("language identification", known_languages),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

# Language models, similarity components and branch-and-bound have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs, stored = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES, 1):
        docs, path = written_at(stage(spark, docs, sf_dir), f"pipeline-stage-{number}")
        if stored:
            discard(spark, stored)
        stored = path
    return docs
