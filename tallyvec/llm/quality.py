"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees, grown on random halves of a bounded labelled sample, give paths; each path is a conjunctive rule. Lasso
logistic regression keeps few of the rules; the model is a bias and weighted conditions, compiled into one Spark
column expression over the statistics.

Defined results. A null text counts as empty; an empty text has all statistics 0 and is scored like any other. Labels
that are null, or belong to no document, teach nothing; with labels of one value only, or none, the score is the share
of label 1 (0.5 without labels). Several labels of one document each count. Repeated rows each give a row. Texts may be of any
length and are read whole. A score that equals the threshold is predicted 1. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Labelled rows that a fit reads at most.
SAMPLE = 6000
THRESHOLD = 0.3
TREES, DEPTH, PENALTY = 24, 3, 0.002

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "letter_share", "upper_share", "digit_share", "space_share", "symbol_share", "comma_share", "stop_share", "bang_share", "pipe_share", "bracket_share", "high_share",
    "word_bytes", "distinct_words", "distinct_lines", "line_words", "short_word_share", "long_word_share", "top_word_share", "marked_word_share", "echo_share", "deflated",
)

_UPPER = np.zeros(256, bool); _UPPER[65:91] = True
_LOWER = np.zeros(256, bool); _LOWER[97:123] = True
_HIGH = np.zeros(256, bool); _HIGH[128:] = True
_PUNCTUATION = b".,;:!?'\"()"


def statistics(text: bytes) -> list[float]:
    """The values named in STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda chars: float(sum(h[c] for c in chars)) / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    upper, lower, high = int(h[_UPPER].sum()), int(h[_LOWER].sum()), int(h[_HIGH].sum())
    marked = sum(x[-1:] in b"#$%&*@^~|" for x in counts)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), (upper + lower + high) / n, upper / max(1, upper + lower), share(b"0123456789"), share(b" \t\n\r"),
        share(b"#$%&*@^~+=<>\\_/"), share(b",;:"), share(b"."), share(b"!?"), share(b"|"), share(b"()[]{}"), high / n,
        float(sizes.mean()) if words else 0.0, len(counts) / w, len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        float((sizes <= 3).mean()) if words else 0.0, float((sizes >= 12).mean()) if words else 0.0, max(counts.values(), default=0) / w, marked / max(1, len(counts)),
        sum(map(bytes.__eq__, words, words[1:])) / w, len(zlib.compress(text, 1)) / n,
    ]


@dataclass
class Model:
    """rules: (weight, conditions), each condition (statistic, whether above, threshold)."""

    bias: float = 0.0
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for k, above, t in conditions:
                c = F.col(STATISTICS[k])
                holds = holds & ((c > t) if above else (c <= t))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + _fires(x, [c for _, c in self.rules]) @ np.array([w for w, _ in self.rules]).reshape(-1))))


def _fires(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, conditions in enumerate(rules):
        for k, above, t in conditions:
            out[:, j] *= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The statistic and threshold of the least squared error."""
    best, found = 1e-9, None
    n, total = len(y), y.sum()
    base = total * total / n
    for k in features:
        order = np.argsort(x[:, k], kind="stable")
        v, left = x[order, k], np.cumsum(y[order])[:-1]
        m = np.arange(1, n)
        gain = np.where(v[1:] > v[:-1], left**2 / m + (total - left) ** 2 / (n - m) - base, 0)
        gain[: max(0, n // 50 - 1)] = 0
        if n // 50:
            gain[-max(1, n // 50) :] = 0
        if len(gain) and gain.max() > best:
            best, i = gain.max(), int(gain.argmax())
            found = (int(k), float((v[i] + v[i + 1]) / 2))
    return found


def _paths(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: tuple, out: list) -> None:
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    if cut := _split(x, y, rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]):
        k, t = cut
        for above in (False, True):
            side = x[:, k] > t if above else x[:, k] <= t
            out.append((*path, (k, above, t)))
            _paths(x[side], y[side], depth - 1, rng, out[-1], out)


def train(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 1) -> Model:
    """Rules from trees, then lasso weights by accelerated proximal gradient steps."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 or share in (0.0, 1.0):
        return Model(float(np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))))
    rng, rules = np.random.default_rng(seed), []
    residual = y - share
    for _ in range(trees):
        half = rng.permutation(len(y))[: max(2, len(y) // 2)]
        own: list = []
        _paths(x[half], residual[half], depth, rng, (), own)
        rules += own
        if own:  # later trees look at what earlier ones leave
            leaf = _fires(x, own[-2:])
            residual = residual - 0.1 * leaf @ np.array([residual[leaf[:, j] > 0].mean() if leaf[:, j].any() else 0.0 for j in range(leaf.shape[1])])
    rules = list(dict.fromkeys(rules))
    a = _fires(x, rules)
    keep = [j for j in range(len(rules)) if 0 < a[:, j].mean() < 1]
    rules, a = [rules[j] for j in keep], a[:, keep]
    w, bias = np.zeros(len(rules)), float(np.log(share / (1 - share)))
    v, c, momentum = w.copy(), bias, 1.0
    step = 4 / max(1e-9, np.linalg.norm(np.column_stack([a, np.ones(len(y))]), 2) ** 2 / len(y))
    for _ in range(800):
        g = 1 / (1 + np.exp(-(a @ v + c))) - y
        nw = v - step * (a.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - step * penalty)
        nb = c - step * g.mean()
        nm = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, c = nw + (momentum - 1) / nm * (nw - w), nb + (momentum - 1) / nm * (nb - bias)
        w, bias, momentum = nw, nb, nm
    return Model(float(bias), [(float(q), r) for q, r in zip(w, rules) if abs(q) > 1e-6])


def measured(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text."""
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [statistics(x or b"") for x in batch.column(1).to_pylist()]
            values = np.array(rows, float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(values[:, j])) for j in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """From a bounded sample: the sample labels of smallest hash of their document's id."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), chosen.schema)
    rows = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(doc_id)).distinct()), doc_id, "left_semi")
    got = measured(rows, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "y", *STATISTICS[:2]])
    return train(got[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), got["y"].to_numpy(float))


def classify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each document."""
    score = model.column()
    return measured(docs, doc_id=doc_id, text=text).select("doc_id", score.alias("score")).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
