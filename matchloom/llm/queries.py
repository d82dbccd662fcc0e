"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import (
    ann, decontaminate, langid, line_dedup, mixing, quality_mil, simhash, suffix_tree, token_alignment, toxicity,
    url_filter, vector_codes, warc)
from matchloom.llm.common import read, remainder
from matchloom.session import materialised


def _held(modulus: int, held: int):
    """Whether a row is held out; a row without an id is never learned from, so it counts as held out."""
    return F.coalesce(remainder("doc_id", modulus) == held, F.lit(True)).alias("held_out")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as bundles and reads every record back."""
    index = warc.write(read(spark, sf_dir, "pages"))
    return warc.read_all(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.train(docs, read(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", _held(3, 1), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    marked = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return marked.select("doc_id", _held(5, 0), "lang_pred", F.col("lang_score").alias("score"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_mil.score(docs, quality_mil.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held(5, 0), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs that a rule decides are the labelled ones that the trees learn from."""
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.array_join(F.transform("codes", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "").alias("code")
    # Read twice: for the labels' sums and for the rows.
    coded = materialised(coded.select("row.vec_id", "row.label", code, "error"), "codes")
    return vector_codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_neighbours": op5_neighbours,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_warc": warc.ORACLE, "op8_mixing": mixing.ORACLE, "op11_line_dedup": line_dedup.ORACLE,
           "op12_vector_codes": vector_codes.ORACLE}
