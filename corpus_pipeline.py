"""The corpus pipeline: language ID, exact dedup, near-dedup, substring dedup, packing. Part of the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from shelfmark.llm.common import documents, written

#: A document whose language is less sure than this is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with names for the columns but ``used`` that no operator gives to one of its own."""
    return docs.toDF(*(c if c in used else f"aside_{k}" for k, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the model learns from the labelled rows of the training folds.

    If those hold no label, there is no language to tell: only texts without a letter are rejected.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(_aside(docs, "doc_id", "text"), model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").toDF(*docs.columns)


def _kept(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``chosen`` (doc_id, text_key); rows that repeat both stay once."""
    aside = _aside(docs)
    doc, text = (aside.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed = aside.withColumn("key", F.xxhash64(text))
    keep = chosen.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))

    def among(some: DataFrame) -> DataFrame:
        return keyed.join(some, keyed[doc].eqNullSafe(some["doc_id"]) & (keyed["key"] == some["text_key"]), "left_semi").drop("key")

    repeated = keep.where("times > 1")
    single = among(keep.where("times = 1"))
    out = single if repeated.isEmpty() else single.unionByName(among(repeated).dropDuplicates([doc, text]))
    return out.toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest doc_id (nulls last); of several rows with that id the one with the least text key."""
    marks = written(exact_dedup.exact_dedup(docs).select("doc_id", "text_key", "text_sha256", "kept"), "exact-marks")
    kept = marks.where("kept")
    several = kept.groupBy("text_sha256").agg(F.min("text_key").alias("text_key"), F.max("text_key").alias("other")).where("text_key < other")
    if several.isEmpty():
        return _kept(docs, kept)
    first = kept.join(several.select("text_sha256", F.col("text_key").alias("least")), "text_sha256", "left").where("least IS NULL OR text_key = least")
    return _kept(docs, first)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the document with the smallest doc_id (nulls last), of several the one with the least text key."""
    return _kept(docs, written(near_dedup.cluster(docs).where("stays").select("doc_id", "text_key"), "near-marks"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id holds; texts that are left empty stay, so that no id is lost."""
    out = substring_dedup.dedup_substrings(_aside(docs, "doc_id", "text", "n_chars")).drop("removed_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("substring dedup", substrings),
    ("best-fit packing", pack),
]

#: SQL expresses none of naive Bayes, content-defined chunks and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written and read again as the next one's documents.

    Null texts and texts without a letter go in the first stage. Rows with a null doc_id are documents like others: they are compared with all, and
    come last where one of a group stays. Rows that repeat id and text stay once. Columns besides doc_id, text and lang pass through, whatever their
    names, up to packing, which drops them. Empty table: no rows.
    """
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
