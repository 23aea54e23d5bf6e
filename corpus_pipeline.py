"""Corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination,
mixing sources to target weights, token-ID / binary output.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; :func:`run` writes its
result as Parquet in the shared folder and rereads it for the next one.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, ngram_join, storage, token_files, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; nulls and empty texts stay."""
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.train(docs, labels))
    return scored.filter(F.col("toxicity") < toxicity.ToxicityParams().threshold).select(*COLUMNS)


def with_key(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``key``: the doc_id where one row has it, else (null or repeated) a negative hash of id and text."""
    docs = docs.select(*COLUMNS)
    own = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63)))
    again = storage.materialise(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-ids")
    if again.isEmpty():
        return docs.withColumn("key", F.coalesce("doc_id", own))
    marked = docs.join(again.withColumn("again", F.lit(True)), "doc_id", "left")
    keyed = marked.withColumn("key", F.when(F.col("again") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id")))
    return storage.materialise(keyed.select(*COLUMNS, "key"), "pipeline-keyed")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id.

    Empty texts and null ids form no class and stay; of repeated rows of one
    doc_id and text one stays; different texts of one doc_id are documents of
    their own, and go before others of their class as the one that stays.
    """
    keyed = with_key(docs)
    classes = ngram_join.near_duplicates(keyed.filter("doc_id IS NOT NULL").select(F.col("key").alias("doc_id"), "text"))
    gone = classes.filter("class_id <> doc_id").select(F.col("doc_id").alias("key")).distinct()
    kept = keyed.join(gone.hint("merge"), "key", "left_anti")
    repeated = F.coalesce(F.col("key") != F.col("doc_id"), F.lit(False))
    one = Window.partitionBy("key").orderBy("source", "lang", "n_chars")
    again = kept.filter(repeated)
    if again.isEmpty():
        return kept.select(*COLUMNS)
    first = again.withColumn("k", F.row_number().over(one)).filter("k = 1").select(*COLUMNS)
    return kept.filter(~repeated).select(*COLUMNS).unionByName(first)


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each row by its own text; null and empty texts stay."""
    keyed = with_key(docs)
    leaks = decontaminate.find_leaks(keyed.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = leaks.select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(gone.hint("merge"), "key", "left_anti").select(*COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of the mix, one row per document that it takes from.

    A document's text is what the mix takes of it: whole passes over the text,
    then its drawn stretches, separated by line ends; a text that is taken
    exactly once stays as it is.  Documents without words have nothing to mix
    and documents outside the drawn blocks are left out.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def write_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; per document (doc_id, start, n_tokens, ids_crc32) as read back."""
    folder = storage.fresh_path(spark, "pipeline-tokens")
    return token_files.read_tokens(token_files.write_tokens(docs, folder), folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The tokenizer and the seeded draws can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
