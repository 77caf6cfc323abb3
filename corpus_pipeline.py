"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Rows with a null text have no language and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import byte_bpe, decontaminate, jaccard_join, language_id, secret_scan
from strandline.runtime import materialize, ship_package, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the models learn from the documents' own labels."""
    ship_package(spark)
    models = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    return language_id.keep_identified(docs, models)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of the smallest id and text hash, once.

    Null ids come last. Texts without words link with nothing and stay, once for each id that is not null. Of rows
    of one id and text that differ elsewhere the smallest by all columns stays.
    """
    placed = jaccard_join.placed_rows(docs).where(F.col("component").isNotNull())
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "body")).alias("first"))
    firsts = first.select(F.col("first.id").alias("first_id"), F.col("first.body").alias("first_body"))
    same = docs["doc_id"].eqNullSafe(firsts["first_id"]) & (F.xxhash64(docs["text"]) == firsts["first_body"])
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(~wordless).join(firsts, same, "left_semi").unionByName(docs.where(wordless & F.col("doc_id").isNotNull()))
    smallest = F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    stays = named.groupBy("doc_id", F.xxhash64("text")).agg(smallest.alias("row")).select("row.*")
    return stays.unionByName(docs.where(wordless & F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    found = decontaminate.verdicts(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad"), "body").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["bad"]) & (F.xxhash64(docs["text"]) == found["body"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for each secret and n_chars of the new text."""
    ship_package(spark)
    clean = secret_scan.redact(docs, secret_scan.train(docs, "text", "doc_id"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the decoded bytes."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: Learned models and the tokenizer have no SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
