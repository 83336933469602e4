"""Five stages from raw documents to token ids, each by one of the operators of tidemark.llm.

Every stage works on all that the one before it kept and returns the columns of documents, but for the
last, which returns documents as token ids. Null and empty texts pass every stage by the rules of its
operator; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, pii, quality, signature_tree
from tidemark.llm.scratch import Scratch
from tidemark.llm.sieve import Sieve

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle and per cent of similarity from which documents are near duplicates.
WORDS, PERCENT = 5, 80


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels, holds to be good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, keep=COLUMNS).filter("kept").select(*COLUMNS)


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest identifier.

    Rows without an identifier are kept if their group has no other. Of rows that share the identifier
    that stays, all stay: which of them was meant cannot be told.
    """
    found = signature_tree.jaccard_components(docs, words=WORDS, percent=PERCENT)
    scratch = Scratch(spark, "stay")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    go = scratch.table("go", found.groupBy(F.col("doc_id").alias("of")).agg(stays.alias("stays")).filter("NOT stays").select("of"))
    # Most texts stay where they are: only those that may go are shuffled.
    docs, key = docs.select(*COLUMNS), F.xxhash64(F.col("doc_id").cast("long"))
    sieve = Sieve(scratch, "go_keys", go, F.xxhash64("of"))
    may_go = sieve(docs, key).join(go, F.col("doc_id").eqNullSafe(F.col("of")), "left_anti")
    return sieve(docs, key, marked=False).union(may_go)


def replace_private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text."""
    out = pii.pseudonymize(docs, "tidemark")
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in a global order. Copies keep their identifier."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens): ids of each document, as a packed little-endian array."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(F.col("ident").alias("doc_id"), (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII surrogates", replace_private),
    ("mixing sources", mix),
    ("byte-level BPE", tokenize),
]
#: A trained classifier and a tokenizer are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(str(k), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
