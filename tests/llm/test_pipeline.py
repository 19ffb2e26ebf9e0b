import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import byte_bpe
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import brute_fingerprint, brute_groups


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def expected(docs, items):
    """Ids that stay, by each stage in turn on what the one before has kept."""
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    largest = {}
    for i, t in docs.items():
        largest[low(t)] = max(i, largest.get(low(t), i))
    docs = {i: docs[i] for i in largest.values()}
    groups = brute_groups({i: brute_fingerprint(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    windows = {}
    for text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])] = 1
    stay = {}
    for i, t in docs.items():
        w, hit = words(t), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not hit:
            stay[i] = t
    return stay


def test_run_against_brute_force(spark, sf, documents):
    docs = {d.doc_id: d.text for d in documents.collect()}
    stay = expected(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    codec = byte_bpe.Codec(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(stay) and len(stay) < len(docs)
    for r in rows:
        assert bytes(r.ids) == codec.encode([stay[r.doc_id]])[0] and r.restored and r.n_tokens == len(r.ids) // 4


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_on_odd_rows_and_none(spark, sf, odd, none, stage):
    name, function = corpus_pipeline.STAGES[stage]
    extra = odd.withColumns({"fp": F.lit(1), "kept": F.lit("x"), "items": F.lit(2), "lang_pred": F.lit(3), "__norm": F.lit(4)})
    out = function(spark, extra, sf)
    rows = out.collect()
    if stage < 4:
        assert out.columns == extra.columns and all(r.kept == "x" for r in rows)
    texts = [r.text for r in extra.collect()]
    count = {0: sum(any(c.isalpha() for c in t or "") for t in texts), 1: len({low(t) for t in texts})}.get(stage, len(texts))
    assert stage == 2 or len(rows) == count, name
    assert function(spark, none, sf).count() == 0
