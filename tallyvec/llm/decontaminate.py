"""Benchmark decontamination: a generalised suffix automaton of the items' words, streamed over every document.

An automaton holds a bounded number of item words, in compact arrays. Documents pass by one automaton at a time; with
more items than one holds, the hits so far are written to the shared folder between two passes, so that no worker, nor
the driver, ever has two.

Defined results. Words are maximal runs of digits, a-z (A-Z lower-cased) and characters from U+0080 on. A null or
empty text has no words, isn't hit and is kept. An item without words never occurs. An item with a null id
hits words like any other, but isn't counted or listed. Repeated items count by item_id,
repeated documents each give a row; items that share a window all occur where it does. Texts and items may be of any
length (an item of more words than an automaton takes has one of its own). An empty benchmark hits nothing, empty documents give no rows. Other columns of
the inputs are ignored by annotate() and kept by decontaminate().
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, fresh, prepare, written

WINDOW = 13
#: contaminated: hit, and the hit words are at least this share (hit * SHARE >= words).
SHARE = 20
#: Words of items in one automaton; further items go to further automata, each a pass of its own.
BLOCK_WORDS = 500_000

#: Bytes of words stay, A-Z lower-cased; all else separates. UTF-8 bytes from 0x80 on are parts of characters from U+0080 on.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Of several word sequences. Each state stands for the item substrings of lengths (length[link], length] that end at the same places."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        whole = []
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last, path = 0, []
            for w in ids:
                last = self._extend(last, w)
                path.append(last)
            whole.append((name, ids))
        self._mark(whole)
        self._pack()

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the strings of q no longer than p's and w."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, whole: list[tuple[str, list[int]]]) -> None:
        """items[s]: of the windows that end in s; short[s]: (length, item) of whole short items that are suffixes at s."""
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.window_state = [0] * n
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.window_state[s] = self.window_state[up] if self.length[up] >= self.window else s
        self.items: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for name, ids in whole:
            state = length = 0
            for w in ids:
                state, length = self.step(state, length, w)
                if length >= self.window:
                    self.items.setdefault(self.window_state[state], set()).add(name)
            if 0 < len(ids) < self.window:
                own.setdefault(state, []).append((len(ids), name))
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        if own:
            for s in order:
                if all_short := (*own.get(s, ()), *self.short.get(self.link[s], ())):
                    self.short[s] = all_short

    def _pack(self) -> None:
        """Most states have one transition: those are kept in two arrays, the root's and the others' in dictionaries."""
        self.word = array("i", (next(iter(moves)) if s and len(moves) == 1 else -1 for s, moves in enumerate(self.next)))
        self.to = array("i", (next(iter(moves.values())) if s and len(moves) == 1 else -1 for s, moves in enumerate(self.next)))
        self.many = {s: moves for s, moves in enumerate(self.next) if not s or len(moves) > 1}
        self.link, self.length, self.window_state = array("i", self.link), array("i", self.length), array("i", self.window_state)
        del self.next

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest suffix of the words so far that some item contains."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) word spans inside occurrences, and the items that occur."""
        word, only, many, link, lengths, window, short, at = self.word, self.to, self.many, self.link, self.length, self.window, self.short, self.window_state
        state = length = 0
        spans: list[list[int]] = []
        found: set[str] = set()
        for i, w in enumerate(map(self.vocab.get, words)):
            if w is None:
                state = length = 0
                continue
            while True:
                if word[state] == w:
                    state = only[state]
                    break
                if state in many and (to := many[state].get(w)) is not None:
                    state = to
                    break
                state = link[state]  # the root has every word
                length = lengths[state]
            length += 1
            reach = 0
            if length >= window:
                reach = window
                found |= self.items[at[state]]
            if state in short:
                for n, name in short[state]:
                    if n <= length:
                        reach = max(reach, n)
                        found.add(name)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, found


def blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over the items, each of a bounded number of words; only one block is on the driver at a time."""
    kept, n = [], 0
    for name, body in items.select(F.col(item_id).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        if words := words_of(bytes(body) if body is not None else None):
            kept.append((name, words))
            n += len(words)
            if n >= block_words:
                yield SuffixAutomaton(kept, window)
                kept, n = [], 0
    if kept:
        yield SuffixAutomaton(kept, window)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_ADDED = (T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType()))
_ADDED_ARROW = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))


def _pass(docs: DataFrame, text: str, added: list[str], automaton: SuffixAutomaton | None, first: bool) -> DataFrame:
    """docs with the added columns: number of words, spans and items so far, with those of this automaton."""
    place, width = docs.columns.index(text), len(docs.columns) - (0 if first else len(added))
    schema = T.StructType([*docs.schema.fields[:width], *(T.StructField(name, kind) for name, kind in zip(added, _ADDED))])
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        for batch in batches:
            before = repeat(([], [])) if first else zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist())
            n, spans, names = [], [], []
            for body, (known, listed) in zip(batch.column(place).cast(pa.binary()).to_pylist(), before):
                words = words_of(body)
                own, found = shared.value.hits(words) if shared.value else ([], set())
                found.discard(None)  # an item without id: its words are hit, but it has no name to list
                n.append(len(words))
                spans.append(_merged(known + own) if known else own)
                names.append(sorted(found.union(listed)))
            values = [pa.array(v, t) for v, t in zip((n, spans, names), _ADDED_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *values], names=schema.names)

    return docs.mapInArrow(run, schema)


def hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: number of words, merged [start, end) word positions that are hit, sorted ids (as strings) of the items that occur."""
    prepare(docs.sparkSession)
    added = fresh(docs, "_words", "_spans", "_items")
    out = tables = None
    for automaton in blocks(items, item_id, item_text, window, block_words):
        if out is not None:
            before, tables = tables, written(out, "hits")
            if before is not None:
                dropped(before)
        out = _pass(docs if out is None else tables, text, added, automaton, out is None)
    return (_pass(docs, text, added, None, True) if out is None else out), added


def _hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x[1] - x[0])


def _bad(words: str, spans: str, share: int) -> Column:
    return (F.size(spans) > 0) & (_hit(spans) * share >= F.col(words))


def annotate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, **options) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged [start, end) word positions), items (sorted ids as strings), contaminated."""
    rows, (words, spans, names) = hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), items, **options)
    return rows.select("doc_id", F.col(words).alias("n_words"), F.col(spans).alias("spans"), F.col(names).alias("items"), _bad(words, spans, share).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", share: int = SHARE, **options) -> DataFrame:
    """The documents without those whose hit words reach the coverage limit; all others unchanged, with all their columns."""
    rows, (words, spans, _) = hits(docs, items, text=text, **options)
    return rows.where(~_bad(words, spans, share)).select(*docs.columns)


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of these spans (and what separates them)."""
    if not text or not spans:
        return text
    raw = text.encode()
    marked, at, places = raw.translate(_WORD_BYTES), 0, []
    for word in marked.split():
        start = marked.index(word, at)
        at = start + len(word)
        places.append((start, at))
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : places[s][0]])
        last = places[e - 1][1]
    return (b"".join(out) + raw[last:]).decode()


def remove_spans(docs: DataFrame, items: DataFrame, *, text: str = "text", min_span: int = WINDOW, **options) -> DataFrame:
    """Every document with the spans of at least min_span words cut out of its text; the rest of each row unchanged."""
    rows, (words, spans, names) = hits(docs, items, text=text, **options)
    place, at = docs.columns.index(text), rows.columns.index(spans)

    def run(batches):
        for batch in batches:
            bodies = [cut_spans(body, [x for x in own if x[1] - x[0] >= min_span]) for body, own in zip(batch.column(place).to_pylist(), batch.column(at).to_pylist())]
            yield batch.set_column(place, batch.schema.field(place), pa.array(bodies, batch.schema.field(place).type))

    return rows.mapInArrow(run, rows.schema).drop(words, spans, names)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of annotate()."""
    return df.select("doc_id", "n_words", _hit("spans").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


