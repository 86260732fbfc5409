"""The corpus pipeline: ``STAGES`` over documents, each stage written and read again.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The quality classifier drops what it rejects, line dedup cuts repeated passages, near-dedup
keeps one document of each group, decontamination cuts benchmark passages, and the last
stage gives token ids with their round trip.

Line dedup cuts out of a near copy all that it shares with an earlier document, and what is left resembles
nothing. Near-dedup therefore also looks at the texts in the documents table that its rows come from.

In every stage empty tables give empty ones, extra columns are dropped, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, linededup, neardup, pieces, quality
from marlstone.session import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score is at least the threshold; one that just reaches it stays.

    Null and blank texts go, null doc_ids are scored like any other, repeated rows stay or go together; of several
    labels of a document the worst counts.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus, by doc_id, text and place.

    Null, empty and short texts and rows with a null doc_id stay as they are; repeated rows lose the same; a text
    of which nothing is left goes.
    """
    return linededup.remove_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the least doc_id, judged as it is and as it was uncut.

    Rows with a null doc_id, null, empty and wordless texts stay; of repeated rows one stays. A row whose text is
    not what is left of the one under its doc_id in the documents table is judged as it is alone.
    """
    return neardup.drop_near_duplicates(docs, table(spark, sf_dir, "documents"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, which are cut out wherever they stand.

    Null and empty texts stay as they are, also under a null doc_id; repeated rows lose the same.
    """
    return decontaminate.remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents: a row for each row, repeated or without doc_id; a null text has null ids, an empty one none."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeats),
    ("near dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]

#: The stages learn, sketch and search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; what lies between is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, f"stage{k}")
    return docs
