"""The queries op1 to op10 and pipeline, with SQL where SQL can express them. Each applies an operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import exact_dedup, html_extract, mixing, ngram_join, pii, piece_lattice, quality, token_count, token_output, vector_dedup
from ledgerflow.llm.common import shared_dir


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_jaccard_components(_table(spark, sf_dir, "documents"), width=3, threshold=0.9)
    return out.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(docs := _table(spark, sf_dir, "documents"), exact_dedup.fresh_index(spark, docs))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = piece_lattice.sample_pieces(_table(spark, sf_dir, "documents"), path, keep_text=True)
    return piece_lattice.check_pieces(encoded, path).withColumnRenamed("id", "doc_id")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    token_output.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_output.ids_crc32(token_output.read_token_files(spark, path))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))

    names = [f"n_{k}" for k in (*pii.BASE_KINDS, *pii.ADDED_KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in x) for x in rows], pa.int64()) for k in (*pii.BASE_KINDS, *pii.ADDED_KINDS)]
            personal = pa.array([any(s[0] != "url" for s in x) for x in rows])
            digest, text = pa.array([pii.base_digest(x) for x in rows], pa.string()), pa.array([pii.as_text(x) for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, digest, text, personal], names=["doc_id", *names, "base_sha256", "spans", "personal"])

    return found.mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string, personal boolean")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.quality_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_good").cast("int").alias("predicted"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_mix_sources, op3_exact_dedup, op4_token_counts, op5_html_extraction, op6_sentencepiece, op7_token_output, op8_pii, op9_quality_classifier, op10_vector_dedup, pipeline)
}

#: One round of the mix: documents in the order of their odds as long as they fit, and what they leave open.
_ROUND = """, u{k} AS (
          SELECT *, sum(size) OVER (PARTITION BY source, open{k} ORDER BY odds, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto{k} FROM g{k}
        ), t{k} AS (
          SELECT *, open{k} AND upto{k} <= gap{k} AS take{k}, gap{k} - coalesce(max(CASE WHEN open{k} AND upto{k} <= gap{k} THEN upto{k} END) OVER (PARTITION BY source), 0) AS gap{n} FROM u{k}
        ), g{n} AS (
          SELECT *, open{k} AND NOT take{k} AND size > 0 AND size <= gap{n} AS open{n} FROM t{k}
        )"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op2_mix_sources": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), n AS (
          SELECT *, source_size * 3 AS cap,
                 CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
        ), l AS (
          SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                 / CAST(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM n
        ), t AS (
          SELECT source, source_size, CASE WHEN w * level > cap THEN CAST(cap AS DOUBLE)
                 ELSE w * (SELECT first(level ORDER BY cap / w, source ASC NULLS LAST) FROM l WHERE NOT w * level > cap) END AS target FROM l
        ), e AS (
          SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
                 least(3.0::DOUBLE, coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0.0::DOUBLE)) AS expect,
                 CAST('0x' || substr(md5('mix' || d.doc_id), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), r AS (
          SELECT *, floor(expect) AS base, expect - floor(expect) AS p FROM e
        ), o AS (
          SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds,
                 target - sum(CAST(base AS BIGINT) * size) OVER (PARTITION BY source) AS rest FROM r
        ), g0 AS (
          SELECT *, p > 0 AS open0, rest AS gap0 FROM o
        )""" + "".join(_ROUND.format(k=k, n=k + 1) for k in range(mixing.ROUNDS)) + f"""
        SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN {" OR ".join(f"take{k}" for k in range(mixing.ROUNDS))} OR (near AND nth = 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM (SELECT *, rank() OVER (PARTITION BY source, near ORDER BY abs(size - gap{mixing.ROUNDS}), odds, doc_id, size) AS nth FROM (SELECT *, p > 0 AND NOT ({" OR ".join(f"take{k}" for k in range(mixing.ROUNDS))}) AND size > 0 AND size < 2 * gap{mixing.ROUNDS} AS near FROM g{mixing.ROUNDS}))
    """,
}
