import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyvec.llm import packing as P
from tallyvec.llm import token_output as O
from tallyvec.llm import tokens as T

TRICKY = ["", " ", "a", "  two  spaces ", "don't I'll WE'VE", "é ñ ß 中文 🎉‍", "x\n\n  y\t z", "<|endoftext|> in <|endoftext|>", "1234 56,78 %%%***", " nbsp　wide", "a" * 3000, "\x00\x01 \x7f", "the  " * 200]


def test_ids_are_those_of_tokenizers():
    r = random.Random(4)
    for text in TRICKY + ["".join(r.choice("ab é\n .1'$\t中") for _ in range(60)) for _ in range(300)]:
        assert T.ids(text).tolist() == ([*T.plain_ids(text).tolist(), 0] if text else [0]), repr(text)
    assert T.ids(None).tolist() == [0]


@given(st.integers(1, 100_000), st.integers(1, 3000))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_the_document(n, capacity):
    parts = T.pieces(n, capacity)
    assert parts[0][0] == 0 and all(length == capacity for _, length in parts[1:]) and len(parts) == -(-n // capacity)
    assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) == n and 1 <= parts[0][1] <= capacity


def _bfd(sizes, capacity):
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
            b[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plan_places_everything_once_without_gaps(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    seqs, seen = {}, set()
    for s, a, b, first, each, offset in P.plan(counts, 40):
        for k in range(b - a):
            assert (s, a + k) not in seen
            seen.add((s, a + k))
            seqs.setdefault(first + k // each, []).append((offset + s * (k % each), s))
    assert len(seen) == len(sizes)
    for parts in seqs.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= 40
    assert len(seqs) <= _bfd(sizes, 40) + 1


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=100, deadline=None)
def test_segment_tree_packing(sizes):
    seqs = O.best_fit_decreasing(sizes, 30)
    assert sorted(i for s in seqs for i in s) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in s) <= 30 for s in seqs) and len(seqs) == _bfd(sizes, 30)


def _docs(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(3, TRICKY[3]), (None, None), (77, "many words here " * 3000)]
    return rows, spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, piece int, offset string").repartition(3)




def test_packed_documents(spark):
    rows, docs = _docs(spark)
    got = P.pack_documents(docs, capacity=64).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault(d, T.ids(t))
    assert sum(r.length for r in got) == sum(len(T.ids(t)) for _, t in rows)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert P.pack_documents(docs.where("false")).count() == 0


def test_matrices_round_trip(spark):
    rows, docs = _docs(spark)
    packed = O.matrices(docs, capacity=64, window_ids=500).collect()
    parts = {}
    for r in packed:
        row = np.frombuffer(r.ids, "<u2")
        assert len(row) == 64 and r.cu_lengths[0] == 0 and list(r.position_resets) == list(r.cu_lengths[:-1])
        for d, k, s, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_lengths, r.cu_lengths[1:]):
            parts.setdefault(d, {}).setdefault((k, s), []).append(row[a:b].tolist())
    texts = dict(rows)
    for d, found in parts.items():
        times = 2 if d == 3 else 1
        assert all(len(v) == times for v in found.values())
        assert [x for _, v in sorted(found.items()) for x in v[0]] == T.ids(texts[d]).tolist()
    assert len({r.sequence_id for r in packed}) == len(packed)
    segs = O.written_segments(docs, capacity=64).collect()
    assert sum(r.length for r in segs) == sum(len(T.ids(t)) for _, t in rows)
    assert all(r.ids_crc32 == zlib.crc32(T.ids(texts[r.doc_id])[r.start : r.start + r.length].tobytes()) for r in segs)
    assert O.written_segments(docs.where("false")).count() == 0
