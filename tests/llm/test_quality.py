import numpy as np
from pyspark.sql import functions as F

from tallyvec.llm import quality as Q


def test_the_column_is_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(Q.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 7] <= 0.7)).astype(float)
    model = Q.train(x, y)
    score = model.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.95 and 0 < len(model.rules) < 200
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(Q.STATISTICS))
    assert np.allclose([r.s for r in df.select(model.column().alias("s")).collect()], score[:50])


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words of a text, and more of them."), (2, "### *** ###"), (3, None), (4, ""), (None, "a\n" * 100_000), (1, "good words")], "doc_id bigint, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in Q.classify(docs, Q.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (9, 1), (2, None)], "doc_id bigint, quality int")
    got = Q.classify(docs, Q.fit(docs, one))
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 6 and all(r.predicted == 1 for r in got.collect())
    assert Q.classify(docs.where("false"), Q.Model()).count() == 0
    assert Q.statistics(b"") == [0.0] * len(Q.STATISTICS) and len(Q.statistics(b"a b")) == len(Q.STATISTICS)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op3_quality"](spark, sf).where("held_out")
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in both) >= 0.93 * len(both)
