"""A corpus pipeline: raw documents to a mix that is ready for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.llm import decontaminate, langid, minhash, mixing, pii
from coastline.llm.common import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; the others get the predicted one."""
    parser = langid.learn(docs)
    out = langid.identify(docs, parser)
    known = F.col("lang_pred") != langid.UNKNOWN
    return _documents(out.where(known if parser.languages else F.col("text").rlike(r"\p{L}")).withColumn("lang", F.when(known, F.col("lang_pred")).otherwise(F.col("lang"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one of rows that share its id and text."""
    kept = minhash.near_duplicates(docs).where("kept and id is not null").select("id").distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return _documents(named.unionByName(docs.where("doc_id is null")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.where("not decon_drop").withColumn("text", F.col("decon_text"))
    return _documents(out.withColumn("n_chars", F.when(F.col("decon_hits") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    out = pii.find(docs)
    out = out.withColumn("text", pii.redacted(F.col("text"), F.col("pii_all")))
    return _documents(out.withColumn("n_chars", F.when(F.size("pii_all") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy."""
    mixed = mixing.mix(docs, keep=("doc_id", "text", "lang", "n_chars"))
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language ID, near-duplicates' bands and trained trees have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    at = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
