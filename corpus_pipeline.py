"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgauge.llm import line_dedup, mixing, packing, quality, simhash
from veilgauge.llm._common import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; template lines go from the texts of the rest.

    Null and empty texts have no words and are rejected; a null source is a source of its own. Repeated rows have one
    verdict. No documents give none.
    """
    return quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of words go from the texts; all documents stay.

    Null texts stay null. Null ids come last in the order. Rows equal in id and text are one text, which does not repeat
    itself. No documents give none.
    """
    return line_dedup.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays: five-word shingles, a similarity of 0.8.

    SimHash fingerprints meet in the buckets of their blocks; close ones are verified by the shingles themselves.
    Texts without words, null and empty ones too, are one group; an earlier stage may leave some. Null ids come last. Of
    rows equal in id and text one stays. No documents give none.
    """
    return simhash.keep_representatives(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as its source's budget says, once at least.

    A null source is a source. Null and empty texts have no tokens and come with every whole pass. Rows with one id
    go together. No documents give none.
    """
    return mixing.mix(docs, max_repeats=mixing.MAX_REPEATS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with the ids of their documents.

    A null or empty text is one piece, its end. Null ids and repeated rows are documents like others. No documents
    give no pieces.
    """
    return packing.pack(docs, window=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Token ids, which SQL cannot make, decide the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
