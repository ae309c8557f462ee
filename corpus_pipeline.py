"""A training corpus from documents: toxic documents and near copies go, repeats and benchmark text are cut, the rest is encoded.

Each stage works on all that its predecessor kept. ``run`` writes each stage's result as Parquet in
the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcavec.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from arcavec.llm.queries import vocabulary
from arcavec.llm.scratch import Table

#: Near copies: Jaccard similarity in hundredths over shingles of so many words (op6 has its own contract).
NEAR_SHINGLE, NEAR_THRESHOLD = 5, 80
#: Passages of over 50 words that repeat across documents go, however short their words are.
PASSAGE_WORDS = 51


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that was cut."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles the one with the least doc_id stays; rows without a doc_id stay. Of rows that share a doc_id, which link as one document, each different text stays once; all go where any of them links to a lesser doc_id."""
    groups = ngram_join.join(docs, shingle=NEAR_SHINGLE, threshold=NEAR_THRESHOLD)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    # by two hashes, as texts can be long
    one = one.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(0x5EED), "text")}).dropDuplicates(["doc_id", "_h1", "_h2"]).drop("_h1", "_h2")
    return one.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and more that occur again, and runs of over 50 words that another document holds, are cut; a document that is nothing else goes."""
    return _recounted(suffix_dedup.strip_repeats(docs, words=PASSAGE_WORDS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut; a document that is left without words goes."""
    return _recounted(decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary()).drop("byte_offsets")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("byte_bpe", encode),
]

#: Learned weights, suffix arrays and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES:
        table = Table(stage(spark, docs, sf_dir))
        if last:
            last.drop()
        docs, last = table.df, table
    return docs
