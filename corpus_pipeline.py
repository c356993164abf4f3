"""A corpus pipeline of the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.  Null texts, null ids, repeated rows and empty tables go through as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.exact_dedup import exact_dedup, normalised
from tidewright.llm.language_id import fit, identify
from tidewright.llm.mixing import mix
from tidewright.llm.near_dedup import near_dedup
from tidewright.llm.piece_codec import encode_pieces
from tidewright.llm.storage import free_shuffles, held_out, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letter, or a probability under the calibrated
    threshold) go; all others stay as they are."""
    model = fit(docs.where(~held_out(F.col("doc_id"), 3)))
    return identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def _staying(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, found by id and text (ids may be null or repeat); of
    repeated rows one."""
    kept = written(judged.where("kept").select(F.col("doc_id").alias("_kept"), F.unhex("text_sha256").alias("_sha")).distinct(), "kept")
    free_shuffles(docs.sparkSession)
    rows = docs.select(*COLUMNS, F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("_digest"))
    staying = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    return staying.dropDuplicates(["doc_id", "_digest"]).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of repeated rows one."""
    return _staying(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest doc_id."""
    return _staying(docs, near_dedup(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, and rows of small sources repeat so that sources meet their weights:
    a row occurs as often as its ``copies``."""
    mixed = mix(docs.select(*COLUMNS))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, lang, source, n_chars, ids, and whether they decode to the text."""
    return encode_pieces(docs.select("doc_id", "lang", "source", "n_chars", "text"), verify=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("pieces", pieces)]

#: Trained weights, sampled signatures and merge-dropout have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` table in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
