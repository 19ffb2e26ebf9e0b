"""A corpus pipeline over `documents`: language, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the ids; run() writes
what a stage returns as Parquet to the shared folder and reads it for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import queries as Q
from tagloom.llm._common import held_out, shared_dir


PREFIX = "__doc_"


def _hidden(docs: DataFrame) -> DataFrame:
    """`docs` with a prefix to every name, so that no column is taken for an operator's output."""
    return docs.withColumnsRenamed({c: PREFIX + c for c in docs.columns})


def _shown(out: DataFrame, columns: list[str]) -> DataFrame:
    return out.select(*[F.col(f"`{PREFIX}{c}`").alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or without a letter) go."""
    from tagloom.llm.language import UNDETERMINED, identify

    train = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    path = Q.tokenizer_path("piece_bpe_32k.model")
    out = identify(_hidden(docs), train.withColumnRenamed("text", PREFIX + "text"), path, text_col=PREFIX + "text")
    return _shown(out.where(F.col("lang_pred") != UNDETERMINED), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    from tagloom.llm.exact_dedup import exact_dedup

    return _shown(exact_dedup(_hidden(docs), PREFIX + "doc_id", PREFIX + "text").where("kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest doc_id stays."""
    from tagloom.llm.simhash import near_duplicates

    groups = near_duplicates(docs.select("doc_id", "text"), carry=["doc_id"])
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(PREFIX + "stays"))
    return docs.join(stays, docs["doc_id"].eqNullSafe(F.col(PREFIX + "stays")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, however long the document is."""
    from tagloom.llm.decontaminate import find_contamination

    out = find_contamination(_hidden(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=PREFIX + "text")
    return _shown(out.where(F.col("n_hit") == 0), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each whole text, checked by decoding them again."""
    import public_tokenizers

    from tagloom.llm.byte_bpe import encode_documents

    path = Q.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    out = encode_documents(docs, path, public_tokenizers.PATTERN, carry=["doc_id", "text"], decode=True)
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return out.select("doc_id", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"), "ids", same.alias("restored"))


STAGES = [("language", language), ("exact dedup", exact), ("simhash near-dedup", near), ("decontamination", decontaminate), ("byte-level BPE", encode)]

#: SQL can't say how languages are learned; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage read is dropped once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if last:
            _drop(spark, last)
        last = place
    return docs
