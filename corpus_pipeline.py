"""A corpus pipeline over the table documents, in stages that are written and read again.

Toxic documents go; one document of each group of near copies stays; documents with benchmark passages go;
secrets are masked; what is left is encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyspan.llm import queries as corpus
from keyspan.llm.common import table
from keyspan.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a score below 0.5, by a model of the labelled documents."""
    from keyspan.llm.toxicity import clean_documents, train

    return clean_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of documents connected by a similarity of 0.8 or more, the one with the least id."""
    from keyspan.llm.neardup import one_of_each

    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a benchmark passage."""
    from keyspan.llm.decontaminate import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: all documents, with a mark where a secret or the code of one was."""
    from keyspan.llm.secrets import redacted_documents

    return redacted_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, number of ids, and digests of the ids and of the decoded text."""
    from keyspan.llm.pieces import digests, encode_decode

    return digests(encode_decode(docs, corpus.piece_model()))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: Model training, edit distances and tokenizers cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written to the shared folder and read as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
