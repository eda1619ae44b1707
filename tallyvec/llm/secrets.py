"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

Labelled credentials (values of the fixed patterns, with their kind) and ordinary runs of the same characters make one
prefix tree for each label. States whose outgoing frequencies differ by less than a Hoeffding bound allows are merged,
which gives a probabilistic automaton for each format. Every other candidate run in every text is scored by the
automata; it is reported, as kind `format`, if a credential format makes it likelier than ordinary text does, by a
margin, and no less likely than the labelled credentials themselves.

Defined results. A null text counts as empty and has no spans. Positions are code points, ends exclusive. Spans of one
kind never overlap; spans of different kinds may, as a hex token assigned to a keyword is both. Without labelled
credentials nothing is added to the fixed patterns. Repeated rows each give a row. Other columns are ignored. Texts and
runs may be of any length and are read whole; formats are learned from labelled values of SHORTEST to LONGEST characters.
Equal likelihoods are no margin: such a run is ordinary. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

KINDS = ("assign", "access", "hex", "format")
# fixed values: patterns and least lengths of the base kinds
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same as HEX or ACCESS matches that are long enough: runs are maximal either way.
_HEX_LONG, _ACCESS_LONG = re.compile(r"[0-9a-f]{24,}"), re.compile(r"AKIA[A-Z0-9]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: Labelled values of each kind, and ordinary runs, that a fit reads at most.
SAMPLE = 1500
#: Lengths of the labelled values that formats are learned from; whole values are read, and candidates of any length scored.
SHORTEST, LONGEST = 12, 512
#: Confidence of the merging test; margin in nats over the ordinary model; share of labelled values below the format's floor.
ALPHA, MARGIN, TAIL = 0.05, 8.0, 0.01


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, index of kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS_LONG.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return out


def _candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs with a digit and a letter that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not run.isalpha() and any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run) and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), m.end()))
    return out


def symbols(run: str) -> str:
    """Characters by class: digit, a-f, g-z, A-F, G-Z; the rest stay."""
    return "".join("0" if c.isdigit() else ("a" if c < "g" else "g") if c.islower() else ("A" if c < "G" else "G") if c.isupper() else c for c in run)


_WITHIN = {"0": math.log(10), "a": math.log(6), "g": math.log(20), "A": math.log(6), "G": math.log(20)}


@dataclass
class Automaton:
    """moves[state][symbol]: (next state, log-probability); ends[state]: of ending there."""

    moves: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)
    floor: float = -math.inf

    def likelihood(self, run: str) -> float:
        return self.scored(run)[0]

    def scored(self, run: str) -> tuple[float, float]:
        """Log-likelihood, and that of each character without the end; symbols never seen in a state cost MISS."""
        state, total = 0, 0.0
        for c in symbols(run):
            to = self.moves[state].get(c)
            if to is None:
                total += MISS
                state = 0
            else:
                state = to[0]
                total += to[1]
            total -= _WITHIN.get(c, 0.0)
        return total + self.ends[state], total / max(1, len(run))


MISS = -9.0


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree, shallow ones first. Every edge keeps its own count, and merged edges add theirs up."""
    kids: list[dict[str, int]] = [{}]
    uses: list[dict[str, int]] = [{}]
    through, ends = [0], [0]
    for word in words:
        at = 0
        through[0] += 1
        for c in symbols(word):
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                uses.append({})
                through.append(0)
                ends.append(0)
            uses[at][c] = uses[at].get(c, 0) + 1
            at = to
            through[at] += 1
        ends[at] += 1
    radius = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > radius * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            a, b = stack.pop()
            if differ(ends[a], through[a], ends[b], through[b]):
                return False
            for c in kids[a].keys() | kids[b].keys():
                if differ(uses[a].get(c, 0), through[a], uses[b].get(c, 0), through[b]):
                    return False
                if c in kids[a] and c in kids[b] and kids[a][c] != kids[b][c]:
                    stack.append((kids[a][c], kids[b][c]))
        return True

    def merge(p: int, q: int) -> None:
        """Fold the tree under q into p."""
        stack = [(p, q)]
        while stack:
            a, b = stack.pop()
            through[a] += through[b]
            ends[a] += ends[b]
            for c, y in kids[b].items():
                uses[a][c] = uses[a].get(c, 0) + uses[b][c]
                if c in kids[a]:
                    stack.append((kids[a][c], y))
                else:
                    kids[a][c] = y

    red, place = [0], {0: 0}
    blue = [(0, c) for c in sorted(kids[0])]
    while blue:
        parent, c = blue.pop(0)
        q = kids[parent][c]
        if q in place:
            continue
        for p in red:
            if compatible(p, q):
                kids[parent][c] = p
                merge(p, q)
                blue = [(r, x) for r in red for x in sorted(kids[r]) if kids[r][x] not in place]
                break
        else:
            place[q] = len(red)
            red.append(q)
            blue += [(q, x) for x in sorted(kids[q])]
    model = Automaton()
    for s in red:
        total = ends[s] + sum(uses[s].values()) + len(kids[s]) + 1
        model.moves.append({c: (place[t], math.log((uses[s][c] + 1) / total)) for c, t in kids[s].items()})
        model.ends.append(math.log((ends[s] + 1) / total))
    return model


@dataclass
class Model:
    formats: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Automaton | None = None

    def accepts(self, run: str) -> bool:
        if not self.formats or self.ordinary is None:
            return False
        plain = self.ordinary.likelihood(run)
        return any((x := a.scored(run))[0] - plain >= MARGIN and x[1] >= a.floor for a in self.formats.values())


def train(labelled: dict[str, list[str]], ordinary: list[str], tail: float = TAIL) -> Model:
    model = Model(ordinary=infer(sorted(ordinary)) if ordinary else None)
    for kind, values in sorted(labelled.items()):
        if values:
            automaton = infer(sorted(values))
            scores = sorted(automaton.scored(v)[1] - 1e-9 for v in values)
            automaton.floor = scores[int(tail * len(scores))]
            model.formats[kind] = automaton
    # ordinary runs have no labels: those that are likelier as credentials aren't taken for ordinary ones
    likelier = lambda x: any(a.scored(x)[1] >= a.floor and a.likelihood(x) > model.ordinary.likelihood(x) for a in model.formats.values())
    if (rest := [x for x in ordinary if not likelier(x)]) and len(rest) < len(ordinary):
        model.ordinary = infer(sorted(rest))
    return model


def _labelled(text: str) -> list[tuple[str, str]]:
    """Credential values by kind, and ordinary runs as kind ''."""
    base = base_spans(text)
    out = []
    for s, k, e in base:
        run = ASSIGN.match(text, s)[2] if k == 0 else text[s:e]
        if len(run) >= SHORTEST:
            out.append((KINDS[k], run))
    return out + [("", text[s:e]) for s, e in _candidates(text, base)]


def fit(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """From a bounded sample of the distinct values, of at most longest characters, that the fixed patterns label: those of smallest hash for each kind."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = {x for body in batch.column(0).to_pylist() if body for x in _labelled(body)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    values = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, value string").where(F.length("value") <= longest)
    labelled: dict[str, list[str]] = {}
    smallest = values.groupBy("kind", (F.xxhash64("value") % 4096).alias("bucket")).agg(F.min_by("value", F.struct(F.xxhash64("value", F.lit(7)), "value")).alias("value"))
    for row in smallest.collect():
        labelled.setdefault(row.kind, []).append(row.value)
    labelled = {k: sorted(v, key=lambda x: hashlib.md5(x.encode()).digest())[:sample] for k, v in labelled.items()}
    return train({k: v for k, v in labelled.items() if k}, labelled.get("", []))


def spans(text: str | None, model: Model) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), in order."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + [(s, 3, e) for s, e in _candidates(text, base) if model.accepts(text[s:e])])


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format for each document."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]

    def run(batches):
        for batch in batches:
            counts, digests, joined = [[] for _ in KINDS], [], []
            for body in batch.column(1).to_pylist():
                found = spans(body, held.value)
                for k, out in enumerate(counts):
                    out.append(sum(x[1] == k for x in found))
                base = _joined([x for x in found if x[1] < 3])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                joined.append(_joined(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts[:3]), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(counts[3], pa.int64())], names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint")
