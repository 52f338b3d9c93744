"""A corpus pipeline of the text operators: documents in, token counts and digests of the mixed corpus out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.llm import byte_bpe, mixing, ngram_join, quality
from basinlens.llm.common import sized, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior chance of being good is at least one half stay.

    A null text is judged as an empty one; equal rows are judged alike and all stay or go.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Of rows that share an id, one stays for each different text (a null text being the empty
    one).  Documents without words, or without an id, are in no group and stay.
    """
    groups = ngram_join.similar_groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.expr("doc_id = component_id")).alias("copies"))
    aside = written(groups.where("copies <> 1"), "aside")  # ids that go, or that several rows share: far fewer than those that stay
    alone = docs.join(sized(aside.select("doc_id")), "doc_id", "left_anti")
    shared = docs.join(sized(aside.where("copies > 1").select("doc_id")), "doc_id", "left_semi")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return alone.unionByName(shared.withColumn("_digest", digest).dropDuplicates(["doc_id", "_digest"]).drop("_digest"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of a mixture of their sources.

    Target weights are document counts to the power 0.75.  Every document appears at least
    once; documents of sources below their weight appear again, as often as it asks.  A null
    source is a source of its own; texts play no part; an empty table stays empty.
    """
    return mixing.mix(docs, ordered=True).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: the number and digest of its token ids, and the digest of what they decode to.  A null text counts as empty."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.token_digests(docs, ranks, public_tokenizers.PATTERN, keep=("lang", "source"))


STAGES = [
    ("quality classifier (9)", good_documents),
    ("n-gram Jaccard join (6)", near_duplicates),
    ("mixing sources (5)", mixture),
    ("byte-level BPE (2)", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split(" (")[0].replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
