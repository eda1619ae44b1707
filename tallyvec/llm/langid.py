"""Language ID by cross-parsing entropy.

Each language gets a suffix automaton of labelled text. A text is parsed greedily into the longest pieces that the
automaton knows. Languages differ in how much text they got, so phrases are normalised: each counts as the bits that
name a place in its language's text. The language that needs the fewest normalised phrases wins. Letters are
lower-cased, anything else is a single space. A text is parsed whole: its segments of SEGMENT codes are first parsed side
by side, then again from where the one before ended until that changes nothing, so that phrases cross segments.

Every letter of the labelled texts is told apart: the most frequent are one code, all others three; letters that occur
in no labelled text are one code together.

Defined results. A null text, or one without any letter, is `und` with score 0. Ties go to the language with more
labelled rows, then by name. Without any labelled text all rows are `und`. Rows without language or text teach nothing.
Texts may be of any length. An empty table gives no rows. Repeated rows each give a row; other columns are ignored by
predict() and kept by reject().
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Labelled rows per language, and characters of them, that a fit reads at most.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 40_000
#: Characters that a fit reads of all languages together; with more than ten, each has an equal part of them. Bounds the broadcast.
ALL_CHARS = 400_000
SEGMENT = 512
#: Rounds of parsing segments side by side; what isn't settled then is parsed one code after another.
ROUNDS = 8
#: Characters parsed side by side: bounds what a batch takes beside the table. A longer text is parsed alone.
TOGETHER = 1_000_000
SPACE, OTHER, SINGLE, LEAD, PAD = 0, 1, 2, 55, 63


def _letters() -> np.ndarray:
    """1 at each code point that is a letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x323B0):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = 1
    return out


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letters())
    return _LETTERS[0]


@dataclass
class Model:
    """alphabet: of letters, up to three codes in the bytes of a number; table[state * width + column of the code]: next state * width, plus 1 if a phrase ended; weights: bits of a phrase.

    columns: of each code; those that occur in no language's text lead back to the roots alike and share one."""

    languages: list[str] = field(default_factory=list)
    alphabet: dict[str, int] = field(default_factory=dict)
    columns: np.ndarray | None = None
    table: np.ndarray | None = None
    roots: list[int] = field(default_factory=list)
    weights: np.ndarray | None = None

    def codes(self) -> np.ndarray:
        """Of every code point."""
        out = np.where(letters() == 1, OTHER, SPACE).astype(np.uint32)
        for c, k in self.alphabet.items():
            out[ord(c)] = k
            if len(c.upper()) == 1 and c.upper().lower() == c:
                out[ord(c.upper())] = k
        return out


def _substrings(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton: exactly the substrings lead somewhere from state 0."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = new
    return nxt


def _columns(automata: list[list[dict[int, int]]]) -> tuple[np.ndarray, int]:
    """The column of each code, and their even number: a table is as wide as the codes in use need, since each worker holds it whole."""
    used = sorted(set().union(*(nxt[0] for nxt in automata)) - {PAD})
    out = np.zeros(PAD + 1, np.uint8)
    out[used] = np.arange(2, len(used) + 2)
    out[PAD] = 1
    return out, (len(used) + 3) // 2 * 2


def _table(nxt: list[dict[int, int]], base: int, columns: np.ndarray, width: int) -> np.ndarray:
    """Transitions as one array; a missing one ends the phrase and starts the next with this character."""
    out = np.empty((len(nxt), width), np.int32)
    root = np.full(width, base * width | 1, np.int32)
    for c, to in nxt[0].items():
        root[columns[c]] = (base + to) * width | 1
    root[columns[PAD]] = base * width
    out[:] = root
    column = columns.tolist()
    for s, moves in enumerate(nxt):
        for c, to in moves.items():
            out[s, column[c]] = (base + to) * width
    return out


def normalised(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def _alphabet(seen: Counter) -> dict[str, int]:
    """Single codes for the most frequent letters; three, the first of them at least LEAD, for the others."""
    out, singles = {}, LEAD - SINGLE
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
        if i < singles:
            out[c] = SINGLE + i
        elif i < singles + (PAD - LEAD) * PAD * PAD:
            low, rest = (i - singles) % PAD, (i - singles) // PAD
            out[c] = LEAD + rest // PAD | (rest % PAD) << 8 | low << 16
    return out


def spelled(packed: np.ndarray) -> np.ndarray:
    """The codes one after another."""
    packed = np.asarray(packed, np.uint32)
    many = (packed & 255) >= LEAD
    if not many.any():
        return packed.astype(np.uint8)
    size = np.where(many, 3, 1)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[at] = packed & 255
    out[at[many] + 1] = packed[many] >> 8 & 255
    out[at[many] + 2] = packed[many] >> 16
    return out


def train(samples: dict[str, list[str]], rows: dict[str, int], max_chars: int = SAMPLE_CHARS) -> Model:
    """A model of these labelled texts, of max_chars codes for each language; rows: how many labelled rows each language has."""
    samples = {k: [normalised(x) for x in v if x] for k, v in samples.items()}
    samples = {k: v for k, v in samples.items() if any(v)}
    if not samples:
        return Model()
    seen = Counter(c for v in samples.values() for x in v for c in x if c != " ")
    alphabet = _alphabet(seen)
    model, automata, weights, base = Model(alphabet=alphabet), [], [], 0
    for name in sorted(samples, key=lambda k: (-rows.get(k, 0), k)):
        body = " ".join(samples[name])[:max_chars]
        codes = spelled([SPACE if c == " " else alphabet.get(c, OTHER) for c in body])[:max_chars].tolist()
        automata.append(_substrings(codes))
        weights.append(np.log2(len(codes) + 1))
        model.languages.append(name)
    model.columns, width = _columns(automata)
    table = np.empty((sum(map(len, automata)), width), np.int32)
    for nxt in automata:
        table[base : base + len(nxt)] = _table(nxt, base, model.columns, width)
        model.roots.append(base * width)
        base += len(nxt)
    model.table = table.reshape(-1)
    model.weights = np.array(weights)
    return model


def _run(table: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each lane (a column), and the states at their ends."""
    state, begun, flag = starts.copy(), np.zeros_like(starts), np.empty_like(starts)
    for row in steps:
        np.add(state, row, out=state)
        np.take(table, state, out=state, mode="clip")
        np.bitwise_and(state, 1, out=flag)
        np.add(begun, flag, out=begun)
        np.subtract(state, flag, out=state)
    return begun, state


def _parsed(table: np.ndarray, steps: np.ndarray, root: int, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane; follows: it goes on with the text of the lane before."""
    starts = np.full(steps.shape[1], root, np.int32)
    begun, ends = _run(table, steps, starts)
    for _ in range(ROUNDS):
        again = np.flatnonzero(follows & (np.roll(ends, 1) != starts))
        if not len(again):
            return begun
        starts[again] = ends[again - 1]
        begun[again], ends[again] = _run(table, np.ascontiguousarray(steps[:, again]), starts[again])
    view = memoryview(table)
    for lane in np.flatnonzero(follows):
        if starts[lane] != ends[lane - 1]:
            starts[lane] = ends[lane - 1]
            state, n = int(starts[lane]), 0
            for c in steps[:, lane].tolist():
                state = view[state + c]
                n += state & 1
                state &= -2
            begun[lane], ends[lane] = n, state
    return begun


def phrases(texts: list[str | None], model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by text and language, and which texts have a letter."""
    n = len(texts)
    counts, lettered = np.zeros((n, len(model.languages)), np.int64), np.zeros(n, bool)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        c = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.empty(len(c), bool)
        keep[0] = c[0] != SPACE
        np.logical_or(c[1:] != SPACE, c[:-1] != SPACE, out=keep[1:])
        c = c[keep]
        if not len(c):
            continue
        lettered[i] = True
        c = spelled(c)
        lanes = -(-len(c) // SEGMENT)
        padded = np.full(lanes * SEGMENT, PAD, np.uint8)
        padded[: len(c)] = c
        pieces.append(padded)
        owner.extend([i] * lanes)
    if pieces and model.languages:
        steps = np.ascontiguousarray(model.columns[np.concatenate(pieces)].reshape(-1, SEGMENT).T).astype(np.int32)
        owner = np.array(owner)
        follows = np.append(False, owner[1:] == owner[:-1])
        for k, root in enumerate(model.roots):
            counts[:, k] = np.bincount(owner, _parsed(model.table, steps, root, follows), n).astype(np.int64) + lettered
    return counts, lettered


def fit(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """From a bounded sample: per language whole texts, in order of their rows' hashes, of at most sample_rows rows and as many as sample_chars characters take (of the last, or only, text what is left of these); of all languages at most all_chars, in equal parts."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    count = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    sample_chars = max(1, min(sample_chars, all_chars // max(1, len(count))))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.select("k", "l", F.length("t").alias("n")).withColumn("r", rank).where(F.col("r") <= sample_rows).withColumn("before", before)
    chosen = first.where(F.col("before") < sample_chars).select("k", "r", F.col("l").alias("l2")).collect()
    if not chosen:
        return Model()
    spark = labelled.sparkSession
    key = rows.schema["k"].dataType.simpleString()
    ids = spark.createDataFrame([(r.k, r.r, r.l2) for r in chosen], f"k {key}, r int, l2 string")
    got = rows.join(F.broadcast(ids), "k").where("l = l2").select("l", "r", F.substring("t", 1, sample_chars).alias("t")).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(got, key=lambda x: (x.l, x.r, x.t)):
        samples.setdefault(row.l, []).append(row.t)
    return train(samples, count, sample_chars)


def _runs(texts: list[str | None]) -> list[tuple[int, int]]:
    """Start and end of runs of texts of at most TOGETHER characters, or of one text that has more."""
    out, start, held = [], 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > TOGETHER:
            out.append((start, i))
            start, held = i, 0
        held += n
    return out + [(start, len(texts))] if texts else out


def _predicted(texts: list[str | None], model: Model, codes: np.ndarray) -> tuple[list[str], list[float]]:
    parts = [phrases(texts[a:b], model, codes) for a, b in _runs(texts)]
    counts, lettered = (np.concatenate(x) for x in zip(*parts)) if parts else phrases([], model, codes)
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    bits = counts * model.weights
    best = bits.argmin(1)
    least = np.sort(bits, axis=1)
    total = least[:, :2].sum(1)
    score = least[:, 1] / np.where(total > 0, total, 1) if bits.shape[1] > 1 else np.ones(len(texts))
    return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]


def _runner(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = []

    def predicted(texts):
        if not kept:
            kept.append(shared.value.codes())
        return _predicted(texts, shared.value, kept[0])

    return predicted


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (second fewest normalised phrases over the two fewest together) for each row."""
    prepare(docs.sparkSession)
    predicted = _runner(docs, model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            names, scores = predicted(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def reject(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that are in one of the model's languages."""
    prepare(docs.sparkSession)
    predicted = _runner(docs, model)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            names, _ = predicted(batch.column(place).to_pylist())
            yield batch.filter(pa.array([x != "und" for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
