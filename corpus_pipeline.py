"""From raw documents to token ids: language, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's result to
the shared folder and reads it back as the next one's docs. All but the last return the columns of
documents, extra ones included. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, decontam, jaccard, langid
from wayline.llm.common import broadcast_if_small, written

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
WIDTH, NUM, DEN = 5, 80, 100
VOCABULARY = "byte_bpe_50k.json"


def _without(docs: DataFrame, gone: DataFrame, on: list[tuple]) -> DataFrame:
    """docs without the rows that meet `gone`; it is broadcast only if counted small."""
    both = None
    for mine, other in on:
        same = mine.eqNullSafe(gone[other])
        both = same if both is None else both & same
    return docs.join(broadcast_if_small(gone), both, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: no text, no letter, or unlike every language.

    The models learn from the labelled documents of this stage's input. A null text goes; null languages and
    ids are no hindrance. Copies are judged alike, each row for itself.
    """
    learn = F.when(langid.fold(F.col("doc_id")) != 0, F.col("lang").cast("string"))
    judged = langid.judge(docs.select(F.col("doc_id").alias("id"), learn.alias("lang"), F.col("text").cast("string").alias("text")))
    gone = written(judged.where("rejected").select(F.col("digest").alias("_wayline_digest")).distinct(), "rejected")
    return _without(docs, gone, [(F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))), "_wayline_digest")])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near duplicates, once if it is repeated.

    Of rows that share id and text but differ elsewhere, the first one as JSON stays. Rows of one id with other texts are
    documents of their own. Rows with a null id stay: nothing tells which of them is meant.
    """
    found = jaccard.jaccard_components(docs, width=WIDTH, num=NUM, den=DEN)
    gone = written(found.where("id <> component").select(F.col("id").alias("_wayline_id")).distinct(), "near")
    kept = _without(docs, gone, [(docs["doc_id"], "_wayline_id")])
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_wayline_id")), "again")
    small = broadcast_if_small(again)
    twice = kept.join(small, kept["doc_id"] == again["_wayline_id"], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    once = twice.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("_wayline_row")).select("_wayline_row.*")
    return kept.join(small, kept["doc_id"] == again["_wayline_id"], "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which at least a twentieth of the words lie in benchmark windows.

    Null texts have no words and stay. Rows that repeat id and text go or stay together; rows of one id with other texts are
    judged by their own.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contamination(docs, benchmark).where(decontam.contaminated(F.col("n_hit"), F.col("n_words")))
    gone = written(found.select(F.col("id").alias("_wayline_id"), F.col("text_hash").alias("_wayline_text")).distinct(), "contaminated")
    return _without(docs, gone, [(docs["doc_id"], "_wayline_id"), (F.xxhash64(docs["text"].cast("string")), "_wayline_text")])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row; the decoded ids must give back the text. Null texts have no ids."""
    rows = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = bpe.round_trip(rows, public_tokenizers.path(VOCABULARY))
    wrong = F.raise_error(F.lit("decoded ids differ from the text")).cast("bigint")
    n = F.when(F.col("decoded") == F.col("text"), F.size("ids").cast("bigint")).otherwise(wrong)
    return out.select("doc_id", "lang", "source", n.alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]

#: The models of the first stage can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
