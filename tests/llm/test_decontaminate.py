import random

from pyspark.sql import functions as F

from tallyvec.llm import decontaminate as D

from . import brute


def _case(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "x9"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(8)]
    docs = []
    for d in range(40):
        text = say(r.randint(0, 80))
        if r.random() < 0.6:
            text += "\n" + r.choice(items)[1].upper() + "; " + say(r.randint(0, 30))
        docs.append((d, text))
    items.append((None, say(15)))
    return [*docs, (40, f"so {items[-1][1]} it is")], items


def test_same_as_brute_force_in_one_or_several_blocks(spark):
    for seed in range(3):
        docs, items = _case(seed)
        docs += [(None, None), (7, ""), docs[3]]
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, spans string, items int")
        bench = spark.createDataFrame([*items, (99, None)], "item_id bigint, text string")
        for block in (10**6, 30):
            got = D.annotate(df, bench, block_words=block).collect()
            want = sorted((str(d), *brute.contamination(t, items)[:1], sorted(brute.contamination(t, items)[1]), brute.contamination(t, items)[2], brute.contaminated(t, items)) for d, t in docs)
            assert sorted((str(r.doc_id), r.n_words, [p for s, e in r.spans for p in range(s, e)], list(r["items"]), r.contaminated) for r in got) == want
            kept = D.decontaminate(df, bench, block_words=block)
            assert kept.schema == df.schema
            assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if not brute.contaminated(t, items))


def test_remove_spans_cuts_only_the_words(spark):
    item = " ".join(f"a{i}" for i in range(13))
    df = spark.createDataFrame([(1, f"Keep this, {item.upper()}! And that."), (2, "Nothing é here"), (3, None)], "doc_id bigint, text string")
    for block in (10**6, 1):
        bench = spark.createDataFrame([(1, item), (2, "some other words of a short item")], "item_id bigint, text string")
        cut = D.remove_spans(df.withColumn("_spans", F.lit("x")), bench, block_words=block)
        assert cut.columns == ["doc_id", "text", "_spans"] and {r._spans for r in cut.collect()} == {"x"}
        assert {r.doc_id: r.text for r in cut.collect()} == {1: "Keep this, ! And that.", 2: "Nothing é here", 3: None}
    bench = bench.where("item_id = 1")
    assert {r.doc_id: r.text for r in D.remove_spans(df, bench).collect()} == {1: "Keep this, ! And that.", 2: "Nothing é here", 3: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in D.digest(D.annotate(docs, none)).collect()] == [(0, 0, False)]
    assert D.annotate(docs.where("false"), none).count() == 0


def test_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    text = "z " * 200_000 + item
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = D.digest(D.annotate(df, spark.createDataFrame([(5, item)], "item_id bigint, text string"))).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (200_020, 20, 1, False)
