"""From raw documents to token files: five stages, each writing what the next one reads.

Quality classifier, near-duplicates, benchmark decontamination, mixing to target weights, and token
output. All but the last keep the columns of documents; each decides on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermalis.llm import common, decontaminate, mixing, neardup, quality, tokens


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels of documents here, scores 0.3 or more.

    A null text counts as empty; without labels every score is 0.5, so all rows stay; ids may repeat
    or be null, and an empty table stays empty.
    """
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each group of near-duplicates, from a similarity of 0.8 on.

    Null and empty texts link with nothing and stay; rows that repeat in full stay or go together;
    an empty table stays empty; columns keep their names, whatever they are.
    """
    return neardup.keep_one(docs, NEAR)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs. Null and empty texts have none and stay; an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. A null source is one of its own; texts without words, null ones too, are not taken."""
    return mixing.take_mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files say of each row, in order of ids; null ids come first, and a text without tokens has the end id alone."""
    return tokens.tokens_written(docs)


#: Similarity in per cent from which two documents of the pipeline are near-duplicates.
NEAR = 80
STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", unseen),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]
#: SQL can express neither the classifier nor the token files; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
