"""Documents to packed training sequences: quality rules, line dedup, near duplicates, mixing, packing.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C
from lanternfish.llm import op01_quality, op02_lines, op03_jaccard, op06_pack, op10_mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_quality.filter_documents(docs, C.read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op02_lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_jaccard.near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_mix.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_pack.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near), ("mix_sources", mix), ("pack_sequences", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; what a stage wrote goes as soon as the next one is done."""
    docs, old = C.read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = C.settled(partial(stage, spark, docs, sf_dir), f"stage-{name}")
        C.discard(*old)
        old = [docs]
    return docs


#: SQL has no tokenizer, so the last stage and with it run()'s rows can't be expressed; tests hold them against a plain version.
ORACLE_SQL = None
