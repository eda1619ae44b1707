import hashlib
import random
import struct
import zlib

from tallyvec.llm import media as M


def _plain_cuts(data):
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h << 1) + int(M.GEAR[b]) & 0xFFFFFFFF
        if i + 1 - last >= M.MOST or i + 1 - last >= M.LEAST and h >> (32 - M.MASK_BITS) == 0:
            ends.append(i + 1)
            last = i + 1
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def test_cuts_are_those_of_a_plain_rolling_hash(monkeypatch):
    r = random.Random(1)
    for n in (64, 256, 5000, 70_000):
        data = M.payload(bytes(r.choice(b"abcdefgh ") for _ in range(n)))
        assert M.cuts(data) == _plain_cuts(data)
        monkeypatch.setattr(M, "_BLOCK", 1000)
        assert M.cuts(data) == _plain_cuts(data)
        monkeypatch.undo()
    assert M.cuts(bytes(20_032)) == _plain_cuts(bytes(20_032))


def test_cuts_follow_content():
    r = random.Random(2)
    data = bytes(r.choice(b"abcdefghijklmnop") for _ in range(40_000))
    one, two = {M.digest(c) for c in M.chunks(data)}, {M.digest(c) for c in M.chunks(b"inserted" + data)}
    assert len(one & two) > 0.8 * len(one)


def _rows():
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "délta", "中文", "x"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = say(3000)
    rows = [(i, say(r.randint(0, 600)) + (shared if i % 3 == 0 else "") + say(r.randint(0, 300))) for i in range(30)]
    return rows + [(2, rows[2][1]), (100, rows[2][1]), (None, None), (101, ""), (102, "a" * 64), (103, "z" * 300_000), (102, "a" * 64)]


def test_round_trip(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, b"k", 1) for d, t in rows], "doc_id bigint, text string, key binary, n_bytes int").repartition(4)
    got = M.columns(docs).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        data = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        parts = M.chunks(data)
        form = b"CDC8" + struct.pack("<QI", len(data), len(parts)) + b"".join(M.digest(p) + struct.pack("<I", len(p)) for p in parts) + b"".join(parts)
        want.append((str(d), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(form), hashlib.sha256(form).hexdigest(), M.features(data, len(parts))))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_every_chunk_is_stored_once(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "cast(text AS binary) AS text").repartition(3)
    kept, _ = M.store(docs, M.roles_of(M._manifest(docs)))
    stored = [d for r in kept.collect() for i, d in enumerate(M.recipe(r.head)[1]) if i not in set(r.refs)]
    every = {M.digest(c) for _, t in rows for c in M.chunks(M.payload((t or "").encode()))}
    assert len(stored) == len(every) == len({bytes(x) for x in stored})


def test_the_media_are_the_bytes_in_the_store(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "cast(text AS binary) AS text").repartition(3)
    kept, _ = M.store(docs, M.roles_of(M._manifest(docs)))
    stored, samples = kept.collect(), {}
    for r in stored:
        _, digests, sizes = M.recipe(r.head)
        at = 0
        for i, (d, n) in enumerate(zip(digests, sizes)):
            if i not in set(r.refs):
                samples[d] = bytes(r.body[at : at + n])
                at += n
        assert at == len(r.body)
    forms = {bytes(r.key): bytes(r.head) + b"".join(samples[d] for d in M.recipe(r.head)[1]) for r in stored}
    got = {bytes(r.key): r for r in M.read_back(kept).collect()}
    assert {k: (len(f), hashlib.sha256(f).hexdigest()) for k, f in forms.items()} == {k: (r.media_bytes, r.media_sha256) for k, r in got.items()}
    assert all(hashlib.sha256(f[16 + 20 * len(M.recipe(f[: len(f) - got[k].payload_bytes])[1]) :]).hexdigest() == got[k].payload_sha256 for k, f in forms.items())


def test_a_broken_store_is_noticed(spark):
    import pytest

    docs = spark.createDataFrame([(1, b"some text " * 200)], "doc_id bigint, text binary")
    kept, _ = M.store(docs, M.roles_of(M._manifest(docs)))
    broken = kept.selectExpr("key", "head", "refs", "offers", "cast(concat('x', substring(cast(body AS string), 2)) AS binary) AS body")
    with pytest.raises(Exception, match="not read back as stored"):
        M.read_back(broken).collect()


def test_empty(spark):
    assert M.columns(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
