import hashlib
import random

from tallyvec.llm import line_dedup as L

from . import brute


def _rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéf") for _ in range(r.randint(2, 9)))
    base = [" ".join(word() for _ in range(r.choice([1, 3, 12, 40, 80]))) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(base)
            if r.random() < 0.4 and len(x) > 5:
                at = r.randrange(len(x))
                x = x[:at] + r.choice("xyz") + x[at + 1 :]
            if r.random() < 0.3:
                x = x.upper() + "!"
            lines.append(x)
            if r.random() < 0.1:
                lines.append(r.choice(["", "   ", "###", "***", "a  b", "\t"]))
        rows.append((d, "\n".join(lines)))
    return rows + [(3, rows[3][1]), (3, "other text\n" + rows[5][1]), (None, rows[7][1]), (50, None), (51, ""), (52, "word " * 20_000)]


def test_same_as_brute_force(spark):
    for seed in range(2):
        rows = _rows(seed)
        docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id bigint, text string, row int, node string").repartition(3)
        want = brute.dedup_lines(rows)
        got = L.deduplicate(docs)
        assert got.schema == docs.schema
        assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(d), str(w)) for (d, _), w in zip(rows, want) if w is not False)
        count = lambda t: sum(bool(brute.norm_line(x)) for x in (t or "").split("\n"))
        want = brute.dedup_lines(rows, keep_empty=True)
        plain = sorted((str(d), count(t), count(w), hashlib.sha256((w or "").encode()).hexdigest()) for (d, t), w in zip(rows, want))
        assert sorted((str(r.doc_id), r.n_lines, r.n_kept, r.text_sha256) for r in L.report(docs).collect()) == plain


def test_long_lines_and_frequent_keys(spark, monkeypatch):
    """Lines of more words than packed votes hold, and keys that are dealt over tasks."""
    r = random.Random(4)
    lines = [" ".join(r.choice(["some", "few", "words", "x", "y"]) for _ in range(30)) + f" {i}" for i in range(12)] + ["a template line of the log that is long enough to be near by edits " + str(i) for i in range(100, 160)]
    rows = [(i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {brute.norm_line(x): brute.simhash(brute.norm_line(x)) for x in lines}
    assert {r.doc: r.sim & (1 << 64) - 1 for r in L.hashed(docs, "doc_id", "text", most=20).collect()} == {i: want[brute.norm_line(x)] for i, x in rows}
    monkeypatch.setattr(L, "GROUP", 4)
    monkeypatch.setattr(L, "SEEN", 1)
    got = {r.doc_id: r.n_kept for r in L.report(docs).collect()}
    assert got == {d: int(w is not False) for (d, _), w in zip(rows, brute.dedup_lines(rows))}


def test_keys_meet_within_three_bits(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        pairs.append((sign(a), sign(b)))
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select(L.keys_of("a").alias("x"), L.keys_of("b").alias("y"))
    assert all(set(r.x) & set(r.y) for r in df.collect())


def test_simhash_is_the_plain_one(spark):
    lines = ["one", "hello wonderful world again", "the of and", "mixed länger wörter ß und kurze"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc: r.sim & (1 << 64) - 1 for r in L.hashed(docs, "doc_id", "text").collect()}
    assert got == {i: brute.simhash(brute.norm_line(x)) for i, x in enumerate(lines)}


def test_line_in_many_repeated_rows(spark):
    """All copies together have more words than one sum of votes holds."""
    r = random.Random(9)
    line = " ".join("".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(100))
    docs = spark.createDataFrame([(1, line)] * 8000 + [(2, line + " of")], "doc_id bigint, text string").repartition(3)
    assert {r.sim & (1 << 64) - 1 for r in L.hashed(docs, "doc_id", "text").collect()} == {brute.simhash(line), brute.simhash(line + " of")}
    linked = (brute.simhash(line) ^ brute.simhash(line + " of")).bit_count() <= 3
    assert {(r.doc_id, r.n_lines, r.n_kept) for r in L.report(docs).collect()} == {(1, 1, 1), (2, 1, 0 if linked else 1)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.deduplicate(docs).count() == 0 and L.report(docs).count() == 0


def test_lines_that_share_a_key_by_chance_leave_their_groups(spark):
    """What is left are lines with a close one, and each close pair meets under exactly one key."""
    r = random.Random(11)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    sims, pairs = [], set()
    for i in range(120):
        a = r.getrandbits(64)
        far = a ^ (r.getrandbits(31) | 0x1F) << 33  # the first three blocks are the same
        near = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            near ^= 1 << bit
        sims += [a, far] if i % 2 else [a, near]
        if not i % 2:
            pairs.add((2 * i, 2 * i + 1))
    nodes = spark.createDataFrame([(i, 100, sign(x), i, 1) for i, x in enumerate(sims)], "node bigint, chars int, sim bigint, row bigint, n bigint")
    left = L._grouped(nodes, L.BITS, L.PERCENT)
    assert {x.node for x in left.collect()} == {x for p in pairs for x in p}
    other = left.select("key", *(L.F.col(c).alias(f"{c}_") for c in ("node", "sim")))
    met = left.join(other, "key").where("node < node_").where(L._meet(L.F.col("sim"), L.F.col("sim_"), L.F.col("before"))).collect()
    assert sorted((x.node, x.node_) for x in met) == sorted(pairs)


def test_runs_of_any_size(spark, monkeypatch):
    """Runs that are searched where they are, that just fit, and that are not."""
    rows = _rows(7) + [(100 + i, "a template line of the log that is long enough to be near by edits " + str(i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((str(d), str(w)) for (d, _), w in zip(rows, brute.dedup_lines(rows)) if w is not False)
    for small in (1, 3, 10_000):
        monkeypatch.setattr(L, "SMALL", small)
        assert sorted((str(x.doc_id), str(x.text)) for x in L.deduplicate(docs).collect()) == want


def test_few_keys_until_there_are_many_lines(spark, monkeypatch):
    """Ten keys a line, or twenty of many lines: by both, lines within three bits meet, and the same lines stay."""
    r = random.Random(13)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for _ in range(300):
        a = b = r.getrandbits(64)
        for bit in r.sample(range(64), 3):
            b ^= 1 << bit
        pairs.append((sign(a), sign(b)))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for lines, keys in ((1000, 10), (L.MANY + 1, 20)):
        numbers = L.key_numbers(lines)
        got = df.select(L.keys_of("a", numbers).alias("x"), L.keys_of("b", numbers).alias("y")).collect()
        assert all(len(x.x) == keys and set(x.x) & set(x.y) for x in got)
    rows = _rows(8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((str(d), str(w)) for (d, _), w in zip(rows, brute.dedup_lines(rows)) if w is not False)
    for many in (1 << 27, 0):
        monkeypatch.setattr(L, "MANY", many)
        assert sorted((str(x.doc_id), str(x.text)) for x in L.deduplicate(docs).collect()) == want


def test_bits_are_counted_some_words_at_a_time(spark):
    """A row for each fifteen words instead of each word, with the binary digits of every bit's count."""
    r = random.Random(14)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (1, 2, 14, 15, 16, 30, 31, 100)]
    df = spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "node bigint, words array<string>")
    got = L._planes(df, "words", ["node"]).collect()
    assert len(got) == sum(-(-len(x.split()) // 15) for x in lines)
    for i, x in enumerate(lines):
        own = [y for y in got if y.node == i]
        assert sum(y.some for y in own) == len(x.split())
        want = [sum(brute.xxhash.xxh64_intdigest(w.encode(), seed=42) >> bit & 1 for w in x.split()) for bit in range(64)]
        assert [sum((y[f"p{p}"] >> bit & 1) << p for y in own for p in range(4)) for bit in range(64)] == want
