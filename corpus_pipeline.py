"""The training-corpus pipeline: five stages, each of which applies one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import bpe, decontaminate, jaccard, quality, suffixes
from framewell.llm.common import fresh, numbered, repeated_ids, table, trimmed, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't reject.

    Null and empty texts are scored from zero features; equal texts go or stay together.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near copies: that of the least id, and of its texts that of the least hash.

    Different texts of one id are documents of their own; of rows equal in id and text the
    least stays. Rows without an id stay. Null and empty texts are equal.
    """
    row = fresh("row", docs.columns)
    rows = numbered(docs, row).where(F.col(row).isNotNull())
    gone = jaccard.join(rows.select(F.col(row).alias("doc_id"), "text")).where("doc_id <> class_id").select(F.col("doc_id").alias(row))
    kept = rows.join(gone, row, "left_anti")
    if repeated_ids(docs):
        kept = kept.groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; characters that a cut would split stay.

    Different texts of one id are documents of their own, in order of their hashes; equal
    rows stay, cut alike. Rows without an id, null and empty texts stay as they are.
    """
    names = docs.columns
    text, size = names.index("text"), names.index("n_chars")
    row, spans = fresh("row", names), fresh("spans", names)
    own = numbered(docs, row)
    found = suffixes.covered(own.select(F.col(row).alias("doc_id"), "text"))
    joined = suffixes.with_spans(own, found, row, spans).select(*names, spans)

    def step(batches):
        for batch in batches:
            texts, cols = batch.column(text).to_pylist(), batch.columns[:-1]
            out = [t if t is None or not s else suffixes.kept_text(t, s) for t, s in zip(texts, batch.column(len(cols)).to_pylist(), strict=True)]
            cols[text] = pa.array(out, pa.string())
            cols[size] = pa.array([n if t is None else len(t) for t, n in zip(out, cols[size].to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(trimmed(step), docs.withColumn("n_chars", F.col("n_chars").cast("long")).schema)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, repeated rows go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (null: empty), encoded and decoded, by count and digests; a row for every row."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: A fitted classifier and BPE merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
