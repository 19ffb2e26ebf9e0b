"""Columns of the input with the names that the operators use themselves."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tagloom.llm.byte_bpe import encode_documents
from tagloom.llm.decontaminate import find_contamination
from tagloom.llm.exact_dedup import exact_dedup
from tagloom.llm.language import identify
from tagloom.llm.line_dedup import dedup_lines
from tagloom.llm.lm_score import score_texts
from tagloom.llm.packing import pack_documents
from tagloom.llm.quality import score_quality
from tagloom.llm.simhash import near_duplicates
from tagloom.llm.substring_dedup import remove_repeats

RANKS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")

#: What the operators and their parts call columns within.
INTERNAL = (
    "id K1 k2 x y h fp at w n all_keep all_size begin block body bodies best candidate cand count counts digest differ end first gone gram grams hash hot hits2 hot_id "
    "id2 hash2 key kinds later least level lone many nulls norm near node node2 old offset order out0 out1 part parts place point rank root row rows salt share shared size some start stays "
    "step tags total u v want word words __rows __stays __text __digest __fp __block __spans __gone __k1 __label_id f0 F1 f2 a`b a.b"
).split()

OPERATORS = {
    "op2": lambda df, spark: score_quality(df, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")),
    "op3": lambda df, spark: find_contamination(df, spark.createDataFrame([(1, "same text here"), (2, "word " * 13)], "item_id long, text string")),
    "op4": lambda df, spark: near_duplicates(df),
    "op5": lambda df, spark: score_texts(df),
    "op6": lambda df, spark: remove_repeats(df),
    "op7": lambda df, spark: dedup_lines(df, passage_words=3),
    "op8": lambda df, spark: encode_documents(df, RANKS, P.PATTERN, decode=True),
    "op9": lambda df, spark: identify(df, df, PIECES),
    "op10": lambda df, spark: exact_dedup(df),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_are_carried(spark, odd, name):
    df = odd.select("*", *[F.lit(7).alias(n) for n in INTERNAL])
    plain = OPERATORS[name](odd, spark)
    out = OPERATORS[name](df, spark)
    assert out.columns[: len(df.columns)] == df.columns
    assert out.columns[len(df.columns) :] == plain.columns[len(odd.columns) :]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r[n] == 7 for r in rows for n in INTERNAL)


def test_packing_takes_no_other_columns(spark, odd):
    df = odd.select("*", *[F.lit(7).alias(n) for n in INTERNAL])
    one = pack_documents(odd, RANKS, P.PATTERN).agg(F.sum("n_ids")).first()
    assert pack_documents(df, RANKS, P.PATTERN).agg(F.sum("n_ids")).first() == one
