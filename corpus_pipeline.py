"""A corpus pipeline of five stages; each works on what the one before it kept, written as Parquet and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm import alike, decontam, langid, lines, packing
from territoria.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an Arrow batch between Spark and its Python workers, in all stages.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that long texts don't fill an executor by the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found and holds most of their letters; the model is fitted on the labelled fold."""
    _small_batches(spark)
    found = langid.identify(docs.select(COLUMNS), langid.fit(docs.where(~langid.held_out())), spans=False)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= langid.LEAST)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of each source out of the texts; documents of which no word is left go."""
    out = lines.dedup_lines(docs.select(COLUMNS), min_pages=lines.REPEATED)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike("\\S"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    _small_batches(spark)
    return alike.one_of_alike(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    _small_batches(spark)
    return decontam.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences, one row per piece."""
    _small_batches(spark)
    return packing.pieces(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

#: Language scores, fingerprints and tokens are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
