"""The corpus pipeline: documents to a weighted training mix in five stages.

Each stage is one operator of hireflow.llm. It takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``;
each works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireflow.llm.common import cut, row_key, table
from hireflow.llm.decontaminate import decontaminate
from hireflow.llm.language_id import UNKNOWN, language_id
from hireflow.llm.line_dedup import without_removed_lines
from hireflow.llm.mixing import mix
from hireflow.llm.ngram_join import ngram_join
from hireflow.session import shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null text, or text without a letter. ``lang`` is
    filled in where it is null."""
    found = language_id(docs).filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.{c}")
                          for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, and with them documents of which no word is left."""
    kept = without_removed_lines(docs).filter(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, Jaccard 0.8) the one with the smallest doc_id stays (of those
    with equal doc_ids the one with the least key, of repeated rows one). A document that
    links with nothing stays whatever its doc_id."""
    linked = cut(ngram_join(docs, words=5, percent=80).filter("links").select("doc_id", "row_key", "component"))
    first = linked.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    status = linked.select("row_key").distinct().join(
        first.select("first.row_key", F.lit(True).alias("stays")), "row_key", "left")
    marked = docs.withColumn("row_key", row_key()).join(
        status.select("row_key", F.coalesce("stays", F.lit(False)).alias("stays")), "row_key", "left")
    alone = marked.filter("stays is null")
    return alone.unionByName(marked.filter("stays").dropDuplicates(["row_key"])).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("key")
    return docs.withColumn("key", row_key()).join(hit.distinct(), "key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: of each document that gives words to it, how many, how often it is passed
    whole, the word ranges taken beyond that, and the text that they count words of."""
    carry = tuple(c for c in docs.columns if c not in ("text", "doc_id"))
    keyed = docs.withColumn("mix_key", row_key())
    texts = keyed.select("mix_key", "text").dropDuplicates(["mix_key"])
    mixed = mix(keyed, carry=(*carry, "mix_key")).filter("taken > 0").withColumn("mix_key", F.col("row.mix_key"))
    mixed = mixed.join(texts, "mix_key")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["stop"])), ",")
    return mixed.select("doc_id", *[F.col(f"row.{c}") for c in carry], "size", "source_size", "target", "taken",
                        "passes", F.coalesce(spans, F.lit("")).alias("spans"), "text")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot express the language model, the seeded blocks, or the similarity joins at
#: full size; tests/llm holds every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the shared folder."""
    base = shared_path(spark, f"corpus-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{base}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
