"""A training-data pipeline over documents: stages that each call one operator, written and read again in between."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, langid, linededup, mixing, partenum
from folioscope.llm.common import written
from folioscope.llm.queries import RANKS, held_out

#: A document goes if its language is unknown or the net gives the best one less than this share.
MIN_SHARE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages. Texts that are null or have no letter go; empty tables stay empty; repeated rows fare alike.

    Without any labelled row there is no language to reject by, and all documents stay.
    """
    net = langid.fit(docs.where(~held_out()), "text", "lang", "doc_id")
    if net is None:
        return docs.select(*COLUMNS)
    judged = langid.predict_languages(docs.select(*COLUMNS), net)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least five documents have, except in the largest id; n_chars follows the text where lines went.

    Every row stays, also those of null ids or texts, whose values don't change; rows with equal ids are one document.
    """
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed.cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or in a chain, the least id stays (of equal ids the
    text of least hash). One of several rows with equal id and text stays. Documents without words, or with a null id, are like no others.
    """
    scheme = partenum.Scheme(words=5, num=80, den=100)
    groups = partenum.shingle_groups(docs.select("doc_id", "text"), scheme, slices=4, leads=True)
    gone = groups.where("NOT lead").select("doc_id", "mark").distinct()
    marked = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    left = marked.join(gone.hint("shuffle_hash"), ["doc_id", "mark"], "left_anti")
    # dealt by these two already, so this moves nothing
    return left.dropDuplicates(["doc_id", "mark"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources have the same number of bytes on average, and shuffle them.

    A null source is a source; a source without any bytes can't be weighed and goes; rows with equal ids are repeated alike.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return mixing.poisson_mix(docs.select(*COLUMNS), size=size).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with hashes of them and of the bytes they decode to. A null text is encoded as empty."""
    ranks = bpe.read_rank_file(public_tokenizers.path(RANKS))
    out = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, out=out).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained net, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None
