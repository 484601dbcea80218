"""The corpus pipeline: documents in, token digests of the clean, distinct ones out.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever their names.

Null and empty texts fail the base rule and go in the first stage. A repeated row is a document of its own until the
third stage, where rows of one text are copies; of copies the one with the least id (then set, then text) stays. An empty
table gives an empty result. Texts of any length go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdoc.llm import decontaminate, jaccard, line_dedup, pieces, quality
from sparkdoc.llm.common import checkpointed, discard, table

PIECES_MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.passing(docs, trees)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go from all of them; n_chars follows."""
    out = line_dedup.without_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return jaccard.deduplicated(docs, 80, 100, 5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text."""
    import public_tokenizers

    return pieces.encoded_digests(docs, public_tokenizers.path(PIECES_MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", tokenized),
]

#: Trees, near copies and SimHash windows are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return docs
