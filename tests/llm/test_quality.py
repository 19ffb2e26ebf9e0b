import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.quality import STATISTICS, fit, score_quality, statistics


def test_statistics():
    row = dict(zip(STATISTICS, statistics(pa.array(["AB cd. é!\nAB"]))[0].tolist()))
    size = len("AB cd. é!\nAB".encode())
    assert row["upper"] == 4 / size and row["lower"] == 2 / size and row["space"] == 2 / size and row["newline"] == 1 / size
    assert row["lead"] == row["high"] == row["exclaim"] == 1 / size
    assert row["distinct_words"] == 3 / 4 and row["capital_words"] == 2 / 4 and row["distinct_lines"] == 1
    assert not statistics(pa.array([None, ""])).any()


def test_flat_trees_descend_as_nested_ones():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    model = fit(x, y, trees=30)

    def descend(node, row):
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.limit[node] else model.right[node]
        return model.value[node]

    by_hand = [1 / (1 + np.exp(-(model.base + sum(descend(t, row) for t in model.roots)))) for row in x]
    assert np.allclose(model.score(x), by_hand)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_query_holds_out_and_is_right(spark, documents):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 0), (6, None), (5, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    rows = score_quality(odd.withColumn("Score", F.lit(1)), labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert {r.score for r in score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert score_quality(none, labels).count() == 0
