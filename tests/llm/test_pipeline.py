import random

import corpus_pipeline
from tallyvec.llm import langid, tokens

from . import brute

EN = "the people of this town were there when they went home and with them other things that came before were found again in time".split()
FR = "les gens de cette ville étaient là quand ils sont rentrés chez eux avec des autres choses que nous avons vues avant dans le temps".split()


def _tables(spark, path):
    r = random.Random(6)
    say = lambda words, n: " ".join(r.choice(words) + r.choice(["", "", "a", "er"]) for _ in range(n))
    items = [(i, say(EN, 20)) for i in range(4)]
    docs = []
    for d in range(40):
        lang, words = ("en", EN) if d % 2 else ("fr", FR)
        text = "\n".join(say(words, r.randint(8, 40)) for _ in range(r.randint(1, 5)))
        if d % 7 == 0 and docs:
            text = docs[r.randrange(len(docs))][1] + r.choice(["", " more", "\n" + say(words, 30)])
        if d % 9 == 0:
            text += "\n" + items[d % 4][1]
        docs.append((d, text, lang, "s", len(text)))
    docs += [(100, None, "en", "s", 0), (101, "123 ...", "en", "s", 7), (102, docs[1][1], None, "s", 1), (103, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_same_as_brute_force(spark, tmp_path):
    docs, items = _tables(spark, str(tmp_path))
    rows = [(d, t) for d, t, *_ in docs if t and any(c.isalpha() for c in t)]
    rows = [(d, left) for (d, _), left in zip(rows, brute.dedup_lines(rows)) if left is not False]
    rows = [(d, t) for (d, t), c in zip(rows, brute.near_components(rows)) if d == c]
    rows = {d: t for d, t in rows if not brute.contaminated(t, items)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(rows)
    assert all(sum(r.length for r in got if r.doc_id == d) == len(tokens.ids(t)) for d, t in rows.items())


def test_stages_keep_the_columns(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("node", langid.F.lit(1))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "best_fit_packing"]


def test_empty_documents(spark, tmp_path):
    _tables(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
