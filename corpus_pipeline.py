"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

1. quality: documents that the quality scorer rejects go.
2. near duplicates: of each component of the n-gram Jaccard join the smallest doc_id stays.
3. repeated passages: bytes that an earlier document holds go; documents of which nothing is left go.
4. mixing: each source is taken up to its target, documents as often and as far as the mix takes them.
5. packing: the pieces of the mixed documents with their places in sequences of 1024 tokens.

Stages 1 to 4 return the columns of documents, ``n_chars`` being recounted where the text changes.
Where the mix takes a document k times, it has k rows; a turn that begins or ends within it keeps the words
it takes.  Null, empty and repeated rows go through every stage; columns besides those of documents are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm.common import Scratch, small_batches
from querywright.llm.mixing import mix, n_words
from querywright.llm.ngram_join import similar_documents
from querywright.llm.packing import pack_documents
from querywright.llm.quality import quality_scores
from querywright.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "doc_id long, text string, lang string, source string, n_chars long"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_scores(docs.select(*COLUMNS)).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat a doc_id count as one document and stay together."""
    kept = similar_documents(docs).where("component_id = doc_id OR component_id IS NULL").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept"))).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A cut inside a character drops what is left of that character.  Each row keeps its own lang and source."""
    small_batches(spark)

    def decode(batches):
        for b in batches:
            texts = [k.as_buffer().to_pybytes().decode("utf-8", "ignore") for k in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), pa.array([len(t) for t in texts], pa.int64())], COLUMNS)

    left = remove_repeats(docs, carry=("lang", "source")).where("n_removed < n_bytes OR n_bytes = 0")
    return left.select("doc_id", "kept", "lang", "source").mapInArrow(decode, ROW)


def row_keys() -> list[Column]:
    """Two numbers that tell rows apart; rows that are equal in all columns have the same."""
    parts = [c for name in COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(*parts, F.lit(k)).alias(f"key{k}") for k in (1, 2)]


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix goes through a source and takes of the document, with the words it takes.

    Documents without words are never taken.  Rows without a doc_id and rows that repeat one are taken
    each by its own text.  The order of the slots is not kept, as documents have no column for it."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *row_keys())
    light, takes = mix(sized, scratch=Scratch(spark))
    # The blocks of a document that one cycle takes follow one another.
    spans = takes.groupBy("row_key", "cycle").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    plan = spans.join(light.select("row_key", "size", "key1", "key2"), "row_key").groupBy("key1", "key2").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    small_batches(spark)

    def cut(batches):
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for b in batches:
            at, texts = [], []
            for i, (text, size, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                raw = found = None
                for span in spans:
                    part = text
                    if span["first"] or span["last"] < size:
                        raw = raw or text.encode()
                        found = found or [m.span() for m in word.finditer(raw)]
                        part = raw[found[span["first"]][0] if span["first"] else 0 : found[span["last"] - 1][1] if span["last"] < size else None].decode()
                    at.append(i)
                    texts.append(part)
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), rows.column(2), rows.column(3), pa.array([len(t) for t in texts], pa.int64())], COLUMNS)

    # Equal rows share what is taken of all of them.
    rows = docs.select(*COLUMNS, *row_keys()).join(plan, ["key1", "key2"]).dropDuplicates(["key1", "key2"])
    return rows.select(*COLUMNS, "size", "spans").mapInArrow(cut, ROW)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers remember fewer chunks than in a query of their own, and none after a task, as other stages share their memory."""
    return pack_documents(docs, most=100_000, keep=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("packing", packing)]
#: The stages need set joins, suffix order and a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
