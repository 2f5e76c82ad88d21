"""A corpus pipeline of five operators: language, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language, packing, pii, simhash
from sightline.llm._common import new_folder, read, read_spread
from sightline.llm.queries import tokenizer_path
from sightline.session import delete


OTHERS = "other_columns_"


def _held(docs: DataFrame) -> DataFrame:
    """What operators read (doc_id, text, lang), and all other columns in one, so that no name can clash with an operator's."""
    own = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(*own, F.struct(*(c for c in docs.columns if c not in own)).alias(OTHERS))


def _as_documents(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of documents again, with a new text if one is given; n_chars follows it."""
    of = {c: F.col(OTHERS)[c] if c in df.schema[OTHERS].dataType.names else F.col(c) for c in docs.columns}
    if text is not None:
        df, of["text"] = df.withColumn("new_text_", text), F.col("new_text_")
        if "n_chars" in of:
            of["n_chars"] = F.length("new_text_").cast(docs.schema["n_chars"].dataType)
    return df.select(*(of[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no language's dictionary compresses clearly best."""
    return _as_documents(language.identify(_held(docs), language.train(docs)).where("not rejected"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return _as_documents(simhash.drop_near_duplicates(_held(docs)), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts."""
    found = decontaminate.find_contamination(_held(docs), read(spark, sf_dir, "benchmark"))
    return _as_documents(found, docs, decontaminate.remove_spans(F.col("text"), F.col("spans")))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return _as_documents(pii.find(_held(docs), pii.train(docs)), docs, pii.mask(F.col("text"), F.col("spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", mask_pii),
    ("packing", pack),
]
#: SimHash, the field and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has read is deleted when its own rows are written."""
    docs, before = read_spread(spark, sf_dir, "documents"), None
    base = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
