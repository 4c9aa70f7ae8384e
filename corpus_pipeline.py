"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vidlake.llm.decontaminate import decontaminate
from vidlake.llm.linededup import dedup_lines
from vidlake.llm.ngramjoin import keep_one
from vidlake.llm.packing import pack
from vidlake.llm.queries import table, tokenizer_path
from vidlake.llm.quality import keep_good
from vidlake.llm.storage import save

#: A learned verdict and the trained statistics are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep.

    Null and empty texts have too few words and go. Rows that repeat a doc_id, or have
    none, are judged each by its own text. Without labels the base rule alone decides; an
    empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more documents have; n_chars counts what is left.

    Null and empty texts come out empty. Rows that repeat a doc_id, or have none, count
    as documents of their own; an empty table stays empty.
    """
    out = dedup_lines(docs)
    kinds = dict(docs.dtypes)
    if "n_chars" in kinds:
        out = out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Null and empty texts are near nothing and stay, as do rows without a doc_id. Rows
    that repeat the smallest doc_id are one document and stay together; an empty table
    stays empty.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do rows without a doc_id; rows that repeat
    a doc_id go together. Without items all stay; an empty table stays empty.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training sequences.

    Null and empty texts have their end id alone. Rows that repeat a doc_id, or have none,
    are packed each; an empty table gives no pieces.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through every stage; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
