"""Prompt assembly, citations and exported rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of a context's header, in order, and the fields they show.
HEADER = (("Document", "doc_name"), ("Category", "category"), ("Section", "section"))


def context_with_header(text: Column, fields: dict[str, Column]) -> Column:
    """``[Label: value | Label: value]``, a line break, the text; blank fields are left out."""
    pieces = F.concat_ws(" | ", *[F.when(F.trim(fields[f].cast("string")) != "", F.concat(F.lit(f"{label}: "), fields[f].cast("string"))) for label, f in HEADER if f in fields])
    return F.when(pieces != "", F.concat(F.lit("["), pieces, F.lit("]\n"), text)).otherwise(text)


def build_prompts(questions: DataFrame, contexts: DataFrame, template: str = "Context:\n{contexts}\n\nQuestion: {question}\nAnswer:", max_chars: int = 24_000) -> DataFrame:
    """``(query_id, prompt, n_contexts, truncated)`` from ``questions(query_id, question)`` and ranked ``contexts(query_id, rank, text)``."""
    numbered = contexts.select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "text").alias("text"))
    listed = numbered.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]).alias("parts"))
    rows = questions.join(listed, "query_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    whole = F.replace(F.replace(F.lit(template), F.lit("{contexts}"), F.array_join("parts", "\n\n")), F.lit("{question}"), F.coalesce("question", F.lit("")))
    made = rows.withColumn("whole", whole)
    return made.select("query_id", F.substring("whole", 1, max_chars).alias("prompt"), F.size("parts").alias("n_contexts"), (F.length("whole") > max_chars).alias("truncated"))


def citations(hits: DataFrame, fields: list[str]) -> DataFrame:
    """An array of structs of each query's hits, by rank."""
    kept = ["rank", *[f for f in fields if f in hits.columns and f != "rank"]]
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("citations"))


def export_rows(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Result rows with parallel arrays of what was retrieved; empty arrays where nothing was."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("item_id"), "score", "text"))).alias("h"))
    rows = results.join(listed, "query_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<rank:int,item_id:string,score:double,text:string>>")))
    return rows.select(
        *results.columns, F.transform("h", lambda x: x["item_id"]).alias("retrieved_chunk_ids"), F.transform("h", lambda x: x["score"]).alias("retrieved_scores"),
        F.transform("h", lambda x: x["text"]).alias("retrieved_context_texts"), F.size("h").alias("n_retrieved"),
    )
