"""From raw documents to packed sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import forget, materialize, row_key, table
from lodestone.llm.exact_dedup import exact_survivors
from lodestone.llm.langid import UNDETERMINED, fit_language_model, identify_language
from lodestone.llm.mixing import label_quality, mix_sources
from lodestone.llm.near_dups import near_survivors
from lodestone.llm.packing import best_fit_packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words a shingle.
SHINGLE = 5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the others carry the predicted one. Rows stay where they are.

    Null and empty texts and texts without a letter have no language; whole texts
    count, of any length. Repeated rows are documents of their own, an empty
    table stays empty, and columns other than those of ``documents`` are dropped
    here as in every stage.
    """
    carry = ("text", "source", "n_chars")
    found = identify_language(docs, fit_language_model(docs), carry=carry)
    return found.where(F.col("lang_pred") != UNDETERMINED).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest identifier. Texts move once, without each partition's own copies.

    Null texts count as empty ones. Of rows that share text and identifier one
    stays; a null identifier is smaller than any other. Texts may have any length.
    """
    return exact_survivors(docs.select(*COLUMNS))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest identifier; links are Jaccard similarities of 0.8 or more among what the self-join of tries of wide SimHash fingerprints, pairs of nodes with a bit budget, lets meet. Texts move once."""
    return near_survivors(docs.select(*COLUMNS), shingle=SHINGLE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; that at the edge of its source's target counts if at least half of it is taken. Documents without words stay as they are.

    What is taken is decided on rows without text; then texts move once, to meet
    it by a hash of identifier and text. Rows that share both are one document
    with the copies of all.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    mixed = mix_sources(keyed, quality=label_quality(table(spark, sf_dir, "labels")), carry=("key",))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")))
    times = mixed.groupBy("key").agg(F.sum(copies).cast("int").alias("times"), F.count("*").alias("rows")).where("times > 0")
    taken = keyed.join(times, "key")
    once = taken.where("rows = 1").unionByName(taken.where("rows > 1").dropDuplicates(["key"]))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Null and empty texts are one piece of the closing id alone; longer documents
    than a sequence are cut. Repeated rows are packed as often as they come.
    """
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", simhash_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Language identification and packing can't be stated in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
