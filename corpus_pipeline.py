"""The corpus pipeline: documents to packed sequences, in stages that are written and reread.

Every stage takes rows with null, empty and very long texts, repeated rows, empty tables and columns of any other names
as its operator states; columns of the documents are handed on as they are, and no column that an operator adds replaces
one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import language_id, line_dedup, mixing, near_dedup, packing
from lumenflow.llm.common import P, release, scratch_tables, written
from lumenflow.shipping import ship


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the model learns from their labels.

    A null text, one without letters and one whose language is uncertain go.
    """
    ship(spark)
    model = language_id.train_language_id(docs, learn=language_id.not_held_out())
    kept = language_id.identify(docs, model, prefix=P).filter(~F.col(P + "rejected"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of common blocks go; a document that had words and has none left goes with them.

    A column n_chars of whole numbers follows the text where lines went.
    """
    ship(spark)
    gone = P + "n_deleted"
    out = line_dedup.dedup_lines(docs, prefix=P)
    out = out.filter((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    kind = dict(docs.dtypes).get("n_chars")
    if kind in ("bigint", "int"):
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; null and empty texts are one class."""
    ship(spark)
    return near_dedup.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are taken as their source's rate says."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences; a null or empty text is its end token alone."""
    ship(spark)
    return packing.pack(docs, digest=True)


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The model of the first stage, alignment and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; when a stage's result is written, what it read and its scratch tables are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(scratch_tables())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old := scratch_tables()[before:-1]:
            release(spark, *old)
    return STAGES[-1][1](spark, docs, sf_dir)
