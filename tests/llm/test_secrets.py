import math
import random
import re

from tallyvec.llm import secrets as S


def _plain(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_are_the_patterns():
    r = random.Random(1)
    parts = ["token", "API_KEY", "apikey", " = ", ":", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "deadbee", " ", "é", "x=y", "PassWord", "s3cr3t_value", "'", "\n", "ſecret=abcdefgh"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert sorted(S.base_spans(text)) == _plain(text), text


def test_learned_formats_find_what_has_no_keyword(spark):
    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(400)]
    plain = [f"mail{r.randint(0, 99)}.example-host-{r.choice('abcdefgh')}{r.randint(10, 99)}.org" for _ in range(400)]
    rows = [(i, f"so token = {h} and {p} end") for i, (h, p) in enumerate(zip(hexes, plain))]
    loose = "".join(r.choice("0123456789abcdef") for _ in range(23))
    rows += [(1000, f"left {loose} here"), (1001, None), (1002, ""), (1001, None), (1003, "x" * 300_000 + " " + plain[0])]
    docs = spark.createDataFrame([(*x, 3, "q") for x in rows], "doc_id bigint, text string, n_hex int, spans string")
    model = S.fit(docs)
    got = {r.doc_id: r for r in S.scan(docs, model).collect()}
    assert got[1000].spans == f"format:5:{5 + 23}" and got[1000].n_format == 1
    assert (got[1001].spans, got[1002].spans, got[1003].spans) == ("", "", "")
    for i, text in rows[:400]:
        assert got[i].n_assign == 1 and got[i].n_hex == 1 and got[i].n_format == 0
    assert S.scan(docs, model).count() == len(rows)
    assert S.scan(docs.where("false"), S.fit(docs.where("false"))).count() == 0


def test_merged_states_of_a_regular_format():
    r = random.Random(3)
    model = S.infer(["".join(r.choice("0123456789") for _ in range(12)) for _ in range(500)])
    assert model.likelihood("123456789012") > model.likelihood("12345678901x") + 3


def test_probabilities_are_those_of_the_source():
    """Every character is a digit nine times of ten, wherever it stands: one state, with these shares on its edges."""
    r = random.Random(4)
    words = ["".join(r.choice("0123456789") if r.random() < 0.9 else r.choice("ghjkmnpqrstuvwxyz") for _ in range(r.randint(12, 40))) for _ in range(1500)]
    model = S.infer(words)
    state = 0
    for c in S.symbols(words[0][:10]):
        state, share = model.moves[state][c]
        assert abs(math.exp(share) - (0.9 if c == "0" else 0.05)) < 0.08, c
    for moves, end in zip(model.moves, model.ends):
        assert sum(math.exp(x) for _, x in moves.values()) + math.exp(end) <= 1 + 1e-9


def test_planted_formats_without_keyword(spark):
    """Two formats that are labelled by keyword in some documents are found bare in others; ordinary look-alikes aren't."""
    r = random.Random(6)
    key = lambda: "gk_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    number = lambda: "-".join("".join(r.choice("0123456789ABCDEF") for _ in range(5)) for _ in range(5))
    plain = lambda: f"www.page{r.randint(1, 99)}.example.com/articles/{r.choice(['one', 'two', 'three'])}-{r.randint(100, 999)}"
    rows = [(i, f"set token={r.choice([key, number])()} then see {plain()} ok") for i in range(800)]
    bare = [(1000 + i, f"bare {r.choice([key, number])()} here") for i in range(100)]
    clean = [(2000 + i, f"read {plain()} today") for i in range(100)]
    docs = spark.createDataFrame(rows + bare + clean, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.n_format for x in S.scan(docs, S.fit(docs)).collect()}
    assert sum(got[d] == 1 for d, _ in bare) >= 95 and sum(got[d] for d, _ in clean) == 0
