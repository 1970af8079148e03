"""A training-corpus pipeline over ``documents``: each stage's rows are written as Parquet and read again as the next one's input.

Toxic documents go, then exact copies, then near copies (five-word shingles, Jaccard 0.8 or more); what is left is mixed by source
weights, a document as often as the mix takes it (quality weights come from the text, so that no text is joined); the last stage gives its token ids and the digest of the text decoded from them. Every stage but the last
returns the columns of ``documents``. The first and last stages are beyond SQL, so there is no oracle; tests hold
the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, passing_tables, scratch_path, stored
from lectern.llm.exact_dedup import drop_exact_duplicates
from lectern.llm.langid import held_out_of
from lectern.llm.mixing import mixed_rows, text_quality
from lectern.llm.ngram_join import Join, drop_near_duplicates
from lectern.llm.toxicity import drop_toxic
from lectern.llm.word_bpe import bpe_round_trip

ORACLE_SQL = None
NEAR = Join(words=5, percent=80)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, _labels(spark, sf_dir).filter(~held_out_of(F.col("doc_id"), 5, 0)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, NEAR)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs, text_quality(F.col("text")))


def word_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("source_mix", source_mix), ("word_bpe", word_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with passing_tables(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
        if before:  # only this stage read it
            discard(spark, before)
        before = path
    return docs
