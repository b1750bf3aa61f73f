"""A corpus pipeline: language, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return
the columns of ``documents``. No stage fails on a null in any column, on an empty or a very long text, on repeated rows,
on other columns, whatever their names, or on an empty table, of which each makes an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import language, mixing, packing, simhash, toxicity
from assaylake.llm._common import shared_dir, table, unused
from assaylake.sources.tables import scratch

#: Documents are near-duplicates from this similarity of five-word shingles on.
SIMILARITY = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus; models are fitted to the labelled ones.

    A text that is null or has no letter is in none and goes, as all do where no document is labelled. Repeated rows stay or go together.
    """
    prefix = unused(docs, "identified_")
    found = language.identify(docs, language.fit(docs), prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity.

    A null or empty text has the score of a text without words. Without labels of both classes no document goes. Repeated rows stay or go together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = f"{unused(docs, 'toxic_')}score"
    return toxicity.classify(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; candidates by SimHash, held against the
    similarity of five-word shingles.

    Texts without a word are one class. Rows with the same id and different texts are documents of their own; rows with a null id all stay.
    """
    return simhash.deduplicate(docs, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: documents once for each time that they are taken.

    A null source is a source of its own, the last. A text without a word has the size 0 and is not taken. Repeated rows are documents
    of their own; ties of the random order go by id and text.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in token sequences.

    A null or empty text has one token, the end. Repeated rows and rows with a null id are documents of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and token merges cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it; what a stage writes for itself goes with it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        schema, path = docs.schema, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
