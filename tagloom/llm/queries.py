"""Queries over the driver's tables, one for each operator of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(col: str) -> Column:
    return F.sha2(F.coalesce(F.col(col), F.lit(b"")), 256)


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_ids", "offsets", "lengths", "cu_seqlens", "n_ids", _sha256("input_ids").alias("ids_sha256"), _sha256("position_ids").alias("positions_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = score_quality(_table(spark, sf_dir, "documents"), labels, carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "n_words", "mean_score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import SHORT, remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), carry=["doc_id"], short=SHORT)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    shared = F.size("passages").cast("long").alias("n_passages_shared")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), _sha256("kept").alias("kept_sha256"), shared)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import document_report

    starts, ends = F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends")
    counts = ("n_units", "n_units_removed", "n_passages", "n_passages_removed", "n_passages_shared", "n_removed")
    return document_report(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), *counts, starts, ends)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    docs = _table(spark, sf_dir, "documents")
    out = encode_documents(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"], decode=True)
    return out.select("doc_id", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"), _sha256("ids").alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = _table(spark, sf_dir, "documents")
    train = docs.where(~held_out(F.col("doc_id")))
    out = identify(docs, train, tokenizer_path("piece_bpe_32k.model"), carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OPERATORS = (op1_packing, op2_quality, op3_decontaminate, op4_simhash, op5_lm_score, op6_suffix_dedup, op7_line_dedup, op8_byte_bpe, op9_language, op10_exact_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: DuckDB SQL by query; those without an entry are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op3_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k, least(len(w), 13) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.m = x.m),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit, CAST(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS bigint) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
""",
}
