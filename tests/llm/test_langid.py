import random
from collections import Counter

from tallyvec.llm import langid as L


def _greedy(codes, body):
    """Phrases of a plain greedy parse of codes by substrings of body."""
    n, phrase = 1, []
    text = "".join(map(chr, body))
    for c in codes:
        if "".join(map(chr, [*phrase, c])) in text:
            phrase.append(c)
        else:
            n += 1
            phrase = [c] if chr(c) in text else []
    return n


def test_phrases_are_those_of_a_plain_greedy_parse():
    samples = {"en": ["the cat sat on the mat and the dog"], "de": ["der hund und die katze saß auf"]}
    model = L.train(samples, {"en": 2, "de": 1})
    codes = model.codes()
    for text in ("the dog sat on die katze", "Der Hund!! 123 und ß", "zzz qqq", "x"):
        counts, lettered = L.phrases([text], model, codes)
        own = [model.alphabet.get(c, L.OTHER) if c != " " else L.SPACE for c in L.normalised(text)]
        trimmed = own
        for k, name in enumerate(model.languages):
            body = [model.alphabet.get(c, L.OTHER) if c != " " else L.SPACE for c in L.normalised(samples[name][0])]
            tail = [L.SPACE] if not text[-1].isalpha() else []
            assert counts[0, k] == _greedy(trimmed + tail, body)
        assert lettered[0]


def test_phrases_cross_segments(monkeypatch):
    r = random.Random(5)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    en, de = ["the", "cat", "sat", "on", "mats"], ["der", "hund", "saß", "auf", "dem"]
    samples = {"en": [say(en, 300)], "de": [say(de, 200)]}
    model = L.train(samples, {"en": 2, "de": 1})
    codes = model.codes()
    texts = [say(en + de, 700), say(en, 1500), None, "q" * 3000, "", "the " * 2000 + "x", samples["en"][0] * 3, "a" * 512, "a" * 513]
    body = {k: [model.alphabet.get(c, L.OTHER) if c != " " else L.SPACE for c in v[0]] for k, v in samples.items()}
    for rounds in (8, 1, 0):
        monkeypatch.setattr(L, "ROUNDS", rounds)
        counts, _ = L.phrases(texts, model, codes)
        for i, text in enumerate(texts):
            own = [model.alphabet.get(c, L.OTHER) if c != " " else L.SPACE for c in text or ""]
            assert counts[i].tolist() == [_greedy(own, body[k]) if text else 0 for k in model.languages]


def test_all_learned_letters_are_told_apart():
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    alphabet = L._alphabet(Counter(letters))
    assert len(set(alphabet.values())) == 3000
    spelled = [tuple(L.spelled([alphabet[c]]).tolist()) for c in letters]
    assert len(set(spelled)) == 3000 and {len(x) for x in spelled} == {1, 3}
    assert all((x[0] >= L.LEAD) == (len(x) == 3) and max(x) < L.PAD for x in spelled)
    # two languages of one script without a letter in common, of unequal amounts of text
    r = random.Random(6)
    say = lambda some, n: " ".join("".join(r.choices(some, k=4)) for _ in range(n))
    a, b = letters[::2][:400], letters[1::2][:400]
    model = L.train({"a": [say(a, 2000)], "b": [say(b, 300)]}, {"a": 2, "b": 1})
    got, scores = L._predicted([say(a, 50), say(b, 50), "123"], model, model.codes())
    assert got == ["a", "b", "und"] and all(0 <= x <= 1 for x in scores)


def test_phrases_are_normalised_by_the_amount_of_text():
    model = L.train({"x": ["abab" * 1000], "y": ["ab"]}, {"x": 1, "y": 1})
    assert model.weights[0] > model.weights[1]
    bits = L.phrases(["ab"], model, model.codes())[0][0] * model.weights
    assert L._predicted(["ab"], model, model.codes())[0] == [model.languages[bits.argmin()]] == ["y"]


def test_predictions_edges_and_extra_columns(spark):
    en, fr = "the people of the town were there and then they went with them ", "les gens de la ville étaient là et puis ils sont partis avec eux "
    rows = [(1, en * 20, "en"), (2, fr * 20, "fr"), (3, en, "en"), (4, None, "en"), (5, "", None), (6, "123 !!", "fr"), (7, fr + "!", None), (7, fr + "!", None), (None, en.upper() * 5000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "a") for r in rows], "doc_id bigint, text string, lang string, score double, lang_pred string")
    model = L.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "fr"), (3, "en"), (4, "und"), (5, "und"), (6, "und"), (7, "fr"), (7, "fr"), (None, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in L.predict(docs, model).collect())
    kept = L.reject(docs, model)
    assert kept.schema == docs.schema and kept.count() == 6


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    model = L.fit(docs)
    assert [(r.lang_pred, r.score) for r in L.predict(docs, model).collect()] == [("und", 0.0)]
    assert L.predict(docs.where("false"), model).count() == 0


def test_held_out_accuracy(spark):
    import os

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    got = entry.queries()["op9_language"](spark, sf).where("held_out")
    both = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.97 * len(both)


def test_tables_are_as_wide_as_their_letters(monkeypatch):
    """Each worker holds the table: no column for codes that no text has; results don't depend on how texts are parsed together."""
    r = random.Random(7)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))
    model = L.train({"a": [say("abcdef", 400)], "b": [say("defghi", 300)]}, {"a": 2, "b": 1})
    states = sum(len(L._substrings(L.spelled([model.alphabet.get(c, L.SPACE) for c in body]).tolist())) for body in (say("abcdef", 400),))
    assert model.table.nbytes <= 3 * states * 4 * (9 + 4)
    codes = model.codes()
    texts = [say("abcdefghi", n) for n in (3, 900, 40)] + [None, "", "1 2", "zq ab zzz", "\u4e2d abc"] + [say("abc", 60) for _ in range(20)]
    want = L._predicted(texts, model, codes)
    for most in (1, 100, 1500):
        monkeypatch.setattr(L, "TOGETHER", most)
        assert L._predicted(texts, model, codes) == want
    assert L._predicted([], model, codes) == ([], [])
