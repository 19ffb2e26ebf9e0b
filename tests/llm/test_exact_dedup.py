import hashlib

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.exact_dedup import exact_dedup


def test_query_against_sql(spark, sf):
    rows = queries.op10_exact_dedup(spark, sf).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        expected = db.execute(queries.SQL["op10_exact_dedup"]).fetchall()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == sorted(expected)


def test_hot_and_cold_groups(spark):
    texts = ["Hot text"] * 300 + ["hot TEXT"] * 33 + [f"only {i}" for i in range(300)] + ["pair", "PAIR", "é", "É", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(low(t), []).append(i)
    for n in (1, 3, 40):
        rows = exact_dedup(df, partitions=n).collect()
        assert len(rows) == len(texts)
        for r in rows:
            own = groups[low(r.text)]
            assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
            assert r.text_sha256 == hashlib.sha256(low(r.text).encode()).hexdigest()


def test_one_shuffle_of_the_texts_and_no_python(spark, documents):
    plan = exact_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan
    assert sum("Exchange" in x and "Broadcast" not in x for x in plan.split("\n")) <= 2


def test_odd_rows(spark, odd, none):
    names = ["Hash", "hot", "salt", "begin", "norm", "first", "id", "rows", "f0", "__digest", "runs"]
    rows = exact_dedup(odd.withColumns({n: F.lit(7) for n in names} | {"Kept": F.lit(1)})).collect()
    assert all(r[n] == 7 for r in rows for n in names)
    assert len(rows) == odd.count()
    same = [r for r in rows if r.text == "Same text here."]
    assert {(r.keep_id, r.group_size) for r in same} == {(10, 4)} and sum(r.kept for r in same) == 1
    assert sum(r.kept for r in rows) == len({(r.text or "").lower() for r in rows})
    assert exact_dedup(none).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.text, r.kept) for r in exact_dedup(twice).collect()) == [("a", False), ("a", True), ("b", True)]
