import random

import numpy as np
import pyarrow as pa

from tallyvec.llm import ngram_join as N

from . import brute


def _rows(seed, n=60):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 4, 5, 6, 9, 40, 120]))) for _ in range(14)]
    rows = []
    for d in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocab)
        text = " ".join(w)
        if r.random() < 0.2:
            text += " " + passage
        if r.random() < 0.2:
            text = text.upper().replace(" ", "\n")
        rows.append((d, text))
    return rows + [(3, rows[9][1]), (3, rows[3][1]), (None, rows[4][1]), (None, "only this"), (90, None), (91, ""), (92, " \t "), (93, "x " * 50_000), (94, "a\x0bb\u00a0c d")]


def test_same_as_brute_force(spark, monkeypatch):
    for seed, group in ((1, 4000), (2, 2)):
        monkeypatch.setattr(N, "GROUP", group)
        rows = _rows(seed)
        docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id bigint, text string, token int, digest binary").repartition(4)
        want = sorted((str(d), len(brute.shingles(t)), str(c)) for (d, t), c in zip(rows, brute.near_components(rows)))
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.join(docs).collect()) == want
    kept = N.keep_first(docs)
    assert kept.schema == docs.schema
    first = {c for c in brute.near_components(rows) if c is not None}
    assert {r.doc_id for r in kept.collect()} >= first


def test_keeps_one_row_of_each_component(spark):
    rows = _rows(3, 40)
    rows += [(5, "a text of its own that nobody else has"), (5, rows[9][1]), (None, rows[9][1]), (None, rows[9][1] + " x"), (None, "null ids only in this component"), (None, "null ids only in THIS component"), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, _key int").repartition(4)
    kept = N.keep_first(docs)
    assert kept.schema == docs.schema
    sets, groups = [brute.shingles(t) for _, t in rows], brute.Groups()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                groups.join(i, j)
    want, order = {}, lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for i in range(len(rows)):
        want[groups.find(i)] = min(want.get(groups.find(i), order(i)), order(i))
    got = kept.collect()
    assert sorted((groups.find(r["_key"]), order(r["_key"])) for r in got) == sorted(want.items())
    assert all((r.doc_id, r.text) == rows[r["_key"]] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.join(docs).count() == 0 and N.keep_first(docs).count() == 0


def test_groups_across_batches():
    r = random.Random(7)
    names = ["token", "salt", "node", "place", "n"]
    for _ in range(200):
        rows = sorted((r.randint(0, 6), r.choice([-1, -1, 0]), n, r.randint(0, 9), 5) for n in range(r.randint(0, 25)))
        batches, at = [], 0
        while at < len(rows):
            step = r.randint(0, 5)
            part = rows[at : at + step]
            cols = list(zip(*part)) if part else [()] * 5
            batches.append(pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in cols], names=names))
            at += step
        got = [tuple(x.values()) for b in N._shared(iter(batches)) for x in b.to_pylist()]
        want = []
        for row in rows:
            group = [x for x in rows if x[:2] == row[:2]]
            if len(group) > 1 or row[1] >= 0:
                want.append((*row, *group[0][2:5]))
        assert got == want


def test_prefixes_keep_the_promise():
    r = random.Random(8)
    for _ in range(300):
        n, m = r.randint(1, 60), r.randint(1, 60)
        a, b = set(r.sample(range(70), n)), set(r.sample(range(70), m))
        if r.random() < 0.7:
            b = set(list(a)[: max(1, int(len(a) * 0.95))])
        if 100 * len(a & b) >= 75 * len(a | b):
            for need in range(1, min(6, N.least_overlap(len(a)), N.least_overlap(len(b))) + 1):
                cut = lambda s: set(sorted(s)[: len(s) - N.least_overlap(len(s)) + need])
                assert len(cut(a) & cut(b)) >= need


def test_crowds_around_the_limit(spark, monkeypatch):
    r = random.Random(11)
    vocab = [f"c{i}" for i in range(3000)]
    rows = []
    for k in range(2):
        base = [r.choice(vocab) for _ in range(150)]
        some = [[(r.randrange(150), r.choice(vocab)) for _ in range(r.randint(1, 3))] for _ in range(12)]
        for _ in range(90):
            w = list(base)
            for at, word in r.choice(some) + [(r.randrange(150), r.choice(vocab)) for _ in range(r.randint(0, 7))]:
                w[at] = word
            rows.append((len(rows), " ".join(w[r.randint(0, 3) :])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = sorted(zip((d for d, _ in rows), brute.near_components(rows)))
    assert 2 < len({c for _, c in want}) < len(rows)
    monkeypatch.setattr(N, "CROWD", 3)
    assert sorted((x.doc_id, x.component_id) for x in N.join(docs).collect()) == want


def _prefix_rows(sets, most=N.MOST_MATCHES):
    """(token, salt, node, place, rank) sorted, of sets of numbers that are their own order."""
    return sorted((x, -1, i, place, len(s)) for i, s in enumerate(sets) for place, x in enumerate(sorted(s)[: len(s) - N.least_overlap(len(s)) + most]))


def _random_sets(r):
    sets = [set(r.sample(range(3000), r.randint(1, 80))) for _ in range(60)]
    for i in range(0, 20, 2):
        sets[i + 1] = set(r.sample(sorted(sets[i]), -(-9 * len(sets[i]) // 10))) | set(r.sample(range(3000), r.randint(0, 3)))
    return sets, [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_small_groups_keep_what_may_be_similar():
    r = random.Random(12)
    for step in (7, 50, 1000):
        sets, similar = _random_sets(r)
        rows = _prefix_rows(sets)
        cut = lambda: iter([pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows[at : at + step])], names=["token", "salt", "node", "place", "rank"]) for at in range(0, len(rows), step)])
        every = {(x["token"], x["node"]) for b in N._shared(cut()) for x in b.to_pylist()}
        left = {(x["token"], x["node"]) for b in N._shared(cut(), 75) for x in b.to_pylist()}
        assert left < every and len(similar) >= 8
        of = [{x for x, _, i, *_ in rows if i == n} for n in range(60)]
        assert all({(x, a), (x, b)} <= left for a, b in similar for x in of[a] & of[b])


def test_sets_that_share_too_little_leave(spark):
    sets, similar = _random_sets(random.Random(13))
    rows = [(x, i, n) for x, _, i, _, n in _prefix_rows(sets)]
    shared = spark.createDataFrame([x for x in rows if sum(x[0] == y[0] for y in rows) > 1], "token bigint, node bigint, n bigint")
    left = {x.node for x in N._often_enough(shared, 75, N.MOST_MATCHES).select("node").distinct().collect()}
    assert {x for p in similar for x in p} <= left and len(left) < 60


def test_two_that_share_much_meet_once(spark, monkeypatch):
    r = random.Random(14)
    vocab = [f"w{i}" for i in range(9000)]
    passages, rows = [[r.choice(vocab) for _ in range(40)] for _ in range(12)], []
    for k in range(12):  # pairs of texts that share about half of their shingles, too few to be similar; what they don't share is less rare
        half = [r.choice(vocab) for _ in range(200)]
        rows += [(len(rows) + i, " ".join(half + sum(r.sample(passages, 4), []))) for i in range(2)]
    counts, written = {}, N.written

    def counted(df, name, *args):
        out = written(df, name, *args)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert all(x.component_id == x.doc_id for x in N.join(docs).collect())
    assert counts["rows"] <= 12  # before: every shared shingle of the prefixes, twice


def test_pairs_of_small_groups_are_whole(spark, monkeypatch):
    for seed in (15, 16):
        rows = _rows(seed, 50)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        want = sorted((str(d), len(brute.shingles(t)), str(c)) for (d, t), c in zip(rows, brute.near_components(rows)))
        assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in N.join(docs).collect()) == want
    for seed, most, few in ((18, 6, 8), (19, 2, 8), (20, 6, 3), (21, 1, 2)):
        monkeypatch.setattr(N, "FEW", few)
        sets, similar = _random_sets(random.Random(seed))
        rows = _prefix_rows(sets, most)
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip(zip(*rows[at : at + 40]), (np.int64, np.int64, np.int64, np.int32, np.int64))], names=["token", "salt", "node", "place", "rank"]) for at in range(0, len(rows), 40)]
        met = [x for b in N._rows_and_pairs(iter(batches), 75) for x in b.to_pylist()]
        met = spark.createDataFrame([tuple(x[c] for c in ("node", "a", "b", "n", "m", "p", "q")) for x in met], "node bigint, a bigint, b bigint, n bigint, m bigint, p int, q int")
        found = {(x.a, x.b) for x in N._pairs_of_few(met, 75, most).collect()}
        some = {(x.a, x.b) for x in met.where("a IS NOT NULL").collect()}
        assert {(min(p), max(p)) for p in similar} & some <= found and 0 < len(found) < len(some)
