"""A corpus pipeline: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet
in the shared folder and reads them again as the next one's documents. All stages but the last return the
columns of documents, with n_chars that fits the text. Each decides on all rows its predecessor kept:

quality        drops documents that the classifier scores under 0.5 (trained on the labelled rows among them)
lines          deletes repeated lines; documents stay, even if no line does
near_copies    keeps one row, with the smallest doc_id, of each group of texts linked by a resemblance of 0.8 or more:
               SimHash over 5-word shingles, in wide fingerprints
contamination  drops documents with benchmark windows over at least a twentieth of their words
tokens         returns doc_id, n_tokens and digests of the ids and of the bytes they decode to
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm import byte_bpe, decontaminate, line_dedup, nbsvm
from candlemill.llm import near_copies as resemblance
from candlemill.llm.common import picked, prepare, read

#: SQL can express neither the classifier nor the fingerprints' groups nor the tokens.
ORACLE_SQL = None


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Documents whose columns beside doc_id, text and n_chars have names that no operator gives, and the columns
    under their own names: all of them pass through a stage, whatever they are called."""
    own = ("doc_id", "text", "n_chars")
    names = [c if c in own else f"_apart_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(x).alias(c) for c, x in zip(docs.columns, names, strict=True)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored like others; rows that repeat each get the same score; an empty table stays empty."""
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"))
    rows, back = apart(docs)
    return nbsvm.score(rows, model, keep_text=True).filter("predicted = 1").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null; rows that repeat a doc_id count as one document; rows without doc_id keep all lines."""
    prepare(spark)
    rows, back = apart(docs)
    out = line_dedup.dedup(rows)
    return (out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in rows.columns else out).select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are copies of each other; of rows that repeat one stays; ties go to the smallest doc_id."""
    prepare(spark)
    return resemblance.dedup(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are clean; rows that repeat are judged alike; without benchmark items all rows stay."""
    prepare(spark)
    rows, back = apart(docs)
    flagged = decontaminate.flag(rows, read(spark, sf_dir, "benchmark"), keep_text=True)
    return flagged.filter("NOT contaminated").select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have no tokens; every row has its own result."""
    prepare(spark)
    return byte_bpe.encode(picked(docs, doc_id="doc_id", text="text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, as_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("contamination", contamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows go to a table of its own beside the checkpoints."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
