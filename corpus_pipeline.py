"""A pipeline over documents: each stage's kept rows, written as Parquet and read again, are the next one's input.

1. Toxicity: documents that the nearest labelled examples call toxic go.
2. Exact dedup: of documents that are equal without white space one stays.
3. Near duplicates: of documents connected by five-word shingle sets of a Jaccard similarity of 0.8 the one of the
   smallest doc_id stays.
4. Decontamination: documents that contain a benchmark item to 80 percent go.
5. Byte-level BPE: ids of what is left, and whether they decode to the text.

Documents without doc_id pass stage 3; null texts count as empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontamination, exact_dedup, jaccard_join, toxicity
from folio.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train_from_tables(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL can't express the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
