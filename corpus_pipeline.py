"""A corpus pipeline of five operators: quality classifier, exact dedup, n-gram Jaccard join, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read back as the next
stage's docs. All but the last return the columns of documents. A decision falls on rows: a row with a null doc_id is a
document like any other, and a row that repeats a doc_id is never kept, dropped or copied for another row's sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import exact_dedup, mixing, ngram_join, piece_lattice, quality
from ledgerflow.llm.common import Workspace
from ledgerflow.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones that aren't held out, doesn't reject.

    Every row is scored by its own text, with a null or repeated id too; a null id has no label.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_scores(docs, model).where("quality_good").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id.

    Rows with a null id stay if no row with that text has an id. Rows that repeat an id and a text stay or go together;
    rows that repeat an id with other texts are decided one by one.
    """
    found = exact_dedup.exact_duplicates(docs, exact_dedup.fresh_index(spark, docs))
    #: The decision is one of id and text.
    kept = found.where("kept").select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (exact_dedup.text_digest("text") == F.col("kept_sha256")), "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id.

    The operator links by id: rows with a null id are linked with nothing and stay. Rows that repeat an id are one
    document and stay or go together.
    """
    found = ngram_join.ngram_jaccard_components(docs, width=5, threshold=0.8)
    kept = docs.join(found.where("id = component").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it.

    Each row has copies of its own, three at most, whether its id is null, repeated or neither.
    """
    taken = mixing.mix_sources(docs, keep_row=True).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): sampled pieces of every text.

    Every row is encoded, with a null or repeated id too; rows with one id and text get the same pieces.
    """
    return piece_lattice.sample_pieces(docs, tokenizer_path("piece_bpe_32k.model")).select(F.col("id").alias("doc_id"), "ids")


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: The classifier and the sampled segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table for the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
