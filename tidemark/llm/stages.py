"""The stages of the corpus pipeline: each takes documents (or what the stage before kept) and returns documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, hyperminhash, langid, packing, toxicity

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The posterior from which on a language counts as recognised: likelier than all others together; and the share of
#: documents that are taken to be in none of the languages before they are looked at.
LEAST_SCORE, OTHER = 0.5, 1e-4


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Null and empty texts score by the intercept alone; repeated rows and null
    doc_ids are judged like any other. Without labels of both classes every score is the labels' share."""
    weights, intercept = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, weights, intercept, DOCUMENT).where("score < 0.5").select(*DOCUMENT)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: list[str] | None = None, least: float = LEAST_SCORE, other: float = OTHER) -> DataFrame:
    """Documents in one of the languages (None: those that could be learnt) by the model's decision: the prediction is among
    them, and its posterior is at least `least`. Texts that no language explains better than pieces at random (`other` is the
    share of such texts beforehand), those that are null or without a letter, and those in other languages go. Where no language could be learnt, the model decides nothing, and
    only texts without a letter go. Repeated rows and null doc_ids are judged like any other."""
    langs, pieces = langid.learn(docs, public_tokenizers.path(PIECES))
    if not langs:
        return langid.with_letters(docs, DOCUMENT)
    wanted = F.col("lang_pred").isin(langs if languages is None else languages)
    return langid.with_languages(docs, langs, pieces, DOCUMENT, other).where(wanted & (F.col("score") >= least)).select(*DOCUMENT)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id. Rows that repeat that doc_id all stay where
    their texts differ; equal rows stay once. Texts that are null, empty or without words, and rows with a null doc_id, stay."""
    gone = hyperminhash.near_duplicates(docs).where("not kept").select("doc_id")
    kept = common.semi_join(docs, gone, "doc_id", anti=True).select(*DOCUMENT)
    again = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    twice = common.materialize(again, "repeated")
    if not twice.take(1):
        return kept
    # Whole texts are compared only where a doc_id occurs several times.
    return common.semi_join(kept, twice, "doc_id", anti=True).unionByName(common.semi_join(kept, twice, "doc_id").distinct()).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of what is left; a null or empty text is a piece of its end mark alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
