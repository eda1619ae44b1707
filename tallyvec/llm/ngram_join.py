"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set is its distinct 5-word shingles. Shingles have one global order, rarer ones first by a fixed-size table of
bucket counts over all documents; the order only decides cost, never results. If two sets reach the similarity, their
l-prefixes (the first |x| - ceil(t|x|) + l shingles) share at least l. Each document picks its own l from the estimated
cost of its candidates; a pair must share the smaller l of the two within the prefixes of that length before its sets
are compared exactly.

Documents that share a prefix shingle are a group. A small group (of at most FEW) gives the pairs whose sizes and places
allow them to be similar; these are counted over all small groups, and compared if they can reach the similarity. All others
share shingles of large groups only. A set leaves large groups if fewer are left than a similar set would share. They are
never expanded into all pairs. Exact copies count once; every
member is first compared with the group's pivot; then only members of different components that share shingles are
candidates, against the component that has most of the group. Of the many unsettled members of a crowd around one
component, only those are that share shingles which the pivot of the crowd lacks. Up to a shingle's place, two sets can
share no more than either has of shingles that occur in other components too: pairs that can't reach the similarity by
this are dropped in the join. Shingles that very many documents share (far over the
usual bucket count) come last in the order. Two sets that are similar without sharing a rarer one share frequent ones
only; then each is also similar to the smallest set with the other's frequent shingles, and those two are similar, so
that for frequent shingles only these smallest sets are partners. None of this loses a link that joins components.

Defined results. Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of fewer than five
words is one shingle; one without words, or null, has an empty set and only itself as component. Repeated rows and
repeated ids are documents of their own, ids of a component count once; a null id is never the smallest. An empty table
gives no rows. Other columns are ignored by join() and kept by keep_first(). Texts may be of any length.
Shingles and sets are told apart by 64-bit hashes, and so are rows by keep_first(), which keeps exactly one of each component.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, components, dropped, fresh, in_bits, prepare, settle, written

SHINGLE = 5
#: Similarity as a share of whole numbers.
PERCENT = 75
#: Longest multi-match requirement; cost of comparing two sets, in rows scanned.
MOST_MATCHES, COMPARE = 6, 20
#: Buckets of the shingle counts (2 ** BUCKET_BITS 32-bit counts, 16 MB), of which 2 ** SLOT_BITS travel together.
BUCKET_BITS, SLOT_BITS = 22, 16
#: Bits of the table that says which sets are needed again; others pass by mistake at times and only cost time.
NEED_BITS = 25
#: A shingle is frequent if its bucket's count is so far over the usual one, in documents and in deviations.
FREQUENT, DEVIATIONS = 100, 6.0
#: A shingle's group, or a pivot's pairs, are dealt over tasks beyond this many.
GROUP = 4000
#: Groups of at most so many are searched for sets that may be similar where they are, and give pairs of these instead of rows.
FEW = 8
#: Unsettled sets around one component that are compared by what the smallest of them lacks.
CROWD = 32

_LIMIT = 1_000_000
#: Bytes that are hashed together, and rows of prefixes that are given out together.
BLOCK, PREFIX_ROWS = 1 << 20, 1 << 16
# a word's hash is a polynomial of its bytes' numbers in _BASE, modulo 2 ** 64, whatever its place in the text
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_NUMBER = np.array([int.from_bytes(hashlib.blake2b(bytes([b + 32 if 65 <= b <= 90 else b]), digest_size=8).digest(), "big") | 1 for b in range(256)], np.uint64)
_NUMBER[_SPACE == 1] = 0
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 .. n, and their inverses."""
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, BLOCK), x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes; data ends with a space."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.empty(len(raw), np.uint8)
    edge[0] = space[0] ^ 1
    np.bitwise_xor(space[1:], space[:-1], out=edge[1:])
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_NUMBER[raw] * power[: len(raw)], out=total[1:])
    return starts, _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _parts(text: bytes) -> list[bytes]:
    """A long text cut between words."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        size = BLOCK
        while (cut := max(text.rfind(c, at, at + size) for c in b" \n\t\r\x0b\x0c")) <= at and at + size < len(text):
            size *= 2
        if cut <= at:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _sets_of(words: np.ndarray, firsts: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of the words from each of firsts up to the next."""
    rolled = None
    if len(words) >= width:
        rolled = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            rolled = rolled * _STEP + words[i : len(words) - width + 1 + i]
        rolled = _mixed(rolled)
    out = []
    for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = h * _STEP + w
            out.append(_mixed(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; texts are hashed many at a time."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def hashed():
        if held:
            sizes = np.cumsum([0, *(len(t) + 1 for t in held)])
            starts, words = _word_hashes(b" ".join(held) + b" ")
            out.extend(_sets_of(words, np.searchsorted(starts, sizes), width))
            held.clear()

    size = 0
    for text in texts:
        text = text or b""
        if size + len(text) > BLOCK:
            hashed()
            size = 0
        if len(text) > BLOCK:
            words = np.concatenate([_word_hashes(p + b" ")[1] for p in _parts(text)])
            out.extend(_sets_of(words, np.array([0, len(words)]), width))
        else:
            held.append(text)
            size += len(text) + 1
    hashed()
    return out


def node_of(own: np.ndarray) -> int:
    """Names a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many documents' shingles fall in each bucket; a fixed number of counts, summed over all documents."""

    def count(batches):
        table = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist())
            if sets:
                table += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(table)).astype(np.uint32)
        if table.any():
            slots = table.reshape(-1, 1 << SLOT_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in slots], pa.binary())], names=["slot", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["slot", "counts"])

    parts = docs.select(F.col(text).cast("binary")).mapInArrow(count, "slot int, counts binary")
    out = np.zeros((1 << (BUCKET_BITS - SLOT_BITS), 1 << SLOT_BITS), np.uint32)
    for row in parts.repartition(1 << (BUCKET_BITS - SLOT_BITS), "slot").mapInArrow(total, "slot int, counts binary").collect():
        out[row.slot] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


def _usual(counts: np.ndarray) -> float:
    return float(np.median(counts[counts > 0])) if (counts > 0).any() else 0.0


def signatures(docs: DataFrame, counts: np.ndarray, *, doc_id: str, text: str, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node (a hash of the set), how many shingles are rare (they come first), a key of the frequent ones, whether the same task gave none of this set before; for these token, salt, node, place and rank of the longest prefix in the global order). Salt is -1, or for a frequent shingle one of as many as its bucket's count calls for. Rank is n after how uncommon the set's shingles are on the whole, so that the middle of a group of near copies ranks first.

    Both are made from the texts: prefixes are too large a table to be written first.
    """
    usual = _usual(counts)
    most_rare = usual + max(FREQUENT, DEVIATIONS * usual**0.5)
    held_counts = docs.sparkSession.sparkContext.broadcast(counts)
    kind = docs.schema[doc_id].dataType.simpleString()

    def fresh_in(seen: set[int], node: int) -> bool:
        if node in seen:
            return False
        if len(seen) > _LIMIT:
            seen.clear()
        seen.add(node)
        return True

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            n, nodes, rare, keys, new = [], [], [], [], []
            for own in shingle_sets(batch.column(1).to_pylist()):
                node = node_of(own)
                often = own[held_counts.value[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] > most_rare]
                n.append(len(own))
                nodes.append(node)
                rare.append(len(own) - len(often))
                keys.append(node_of(often))
                new.append(fresh_in(seen, node))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(rare, pa.int64()), pa.array(keys, pa.int64()), pa.array(new, pa.bool_())], names=["doc_id", "n", "node", "rare", "often", "new"])

    names = ["token", "salt", "node", "place", "rank"]

    def given(held: list):
        tokens, over, nodes, ranks = zip(*held)
        sizes = [len(t) for t in tokens]
        node, rank = (np.repeat(np.array(x, np.int64), sizes) for x in (nodes, ranks))
        parts = np.maximum(1, np.ceil(np.concatenate(over) / GROUP)).astype(np.int64)
        salt = np.where(parts > 1, (_mixed(node.view(np.uint64)) >> np.uint64(2)).astype(np.int64) % parts, -1)
        place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(tokens), salt, node, place, rank)], names=names)

    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            held, size = [], 0
            for own in shingle_sets(batch.column(0).to_pylist()):
                node = node_of(own)
                if len(own) and fresh_in(seen, node):
                    count = held_counts.value[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    order = np.argsort(count, kind="stable")[: len(own) - least_overlap(len(own), percent) + most]
                    rank = int(1000 * (32 - np.log2(count.astype(np.float64)).mean())) << 32 | len(own)
                    held.append((own[order].view(np.int64), count[order] - usual, node, rank))
                    size += len(order)
                    if size > PREFIX_ROWS:
                        yield given(held)
                        held, size = [], 0
            if held:
                yield given(held)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, node bigint, rare bigint, often bigint, new boolean"), rows.select("text").mapInArrow(cut, "token bigint, salt bigint, node bigint, place int, rank bigint")


def _may(group: np.ndarray, place: np.ndarray, rank: np.ndarray, percent: int):
    """Of rows in groups side by side, by how far two rows of at most FEW are apart: that distance, and which rows size and place allow to be similar to the row so far behind it of the same group."""
    n, place = rank & 0xFFFFFFFF, place.astype(np.int64)
    for d in range(1, min(FEW, len(group))):
        a, b = slice(None, -d), slice(d, None)
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        most = np.minimum(place[a], place[b]) + 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1
        yield d, (group[a] == group[b]) & (high * percent <= low * 100) & (most * (100 + percent) >= (n[a] + n[b]) * percent)


def _reached(group: np.ndarray, whole: np.ndarray, place: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stay, of groups side by side: those of a whole group of at most FEW only with another of it that size and places allow to be similar, the rows of others all. And which rows are of such small groups."""
    small = whole & (np.bincount(group)[group] <= FEW)
    stays = ~small
    for d, may in _may(group, place, rank, percent):
        stays[:-d] |= may
        stays[d:] |= may
    return stays, small


def _shared(batches, percent: int | None = None):
    """Of rows (token, salt, node, place, rank) sorted by token and salt: those in groups of several, or of a salted token, with node, place and rank of their group's first row as pivot.

    Holds one batch, and of the group that goes on into the next its last row and pivot. With percent, rows of small
    groups stay only if another may be similar, and all have a column more: whether their group is one of these.
    """
    names = ["token", "salt", "node", "place", "rank", *(["small"] if percent is not None else []), "pivot", "pivot_place", "pivot_rank"]
    held, size, pivot = None, 0, None  # the last row, not given out yet; how many of its group came so far, up to 2; its group's pivot
    for batch in _and_none(batches):
        if batch is not None and not batch.num_rows:
            continue
        new = [c.to_numpy() for c in batch.columns] if batch is not None else None
        if new is not None and percent is not None:
            new.append(np.zeros(batch.num_rows, bool))
        if held is None:
            if new is None:
                return
            cols, before = new, 0
        else:
            cols, before = ([np.concatenate([h, c]) for h, c in zip(held, new)] if new is not None else held), size
        token, salt, node = cols[:3]
        if len(token) > 1:  # copies from several tasks
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            cols = [c[fresh] for c in cols]
            token, salt = cols[:2]
        if percent is not None and new is not None and len(token) > 1:
            group = np.cumsum(np.append(False, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
            whole = (salt < 0) & (group != group[-1]) & ((group > 0) | (not before))  # neither goes on nor began before
            stays, cols[5] = _reached(group, whole, cols[3], cols[4], percent)
            cols = [c[stays] for c in cols]
            token, salt = cols[:2]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        pivots = [c[starts] for c in cols[2:5]]
        counts = np.diff(np.append(starts, len(token)))
        if before:
            for p, own in zip(pivots, pivot):
                p[0] = own
            counts[0] += before - 1
        upto = len(token) if new is None else len(token) - 1
        keep = ((counts[group] > 1) | (salt >= 0))[:upto]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[:upto][keep])) for c in (*cols, *(p[group] for p in pivots))], names=names)
        held, size, pivot = [c[-1:] for c in cols], min(2, int(counts[-1])), [p[-1] for p in pivots]


def _and_none(batches):
    yield from batches
    yield None


def _rows_and_pairs(batches, percent: int):
    """Of rows (token, salt, node, place, rank) sorted by token and salt: what _shared() gives for large groups, and a pair (a, b, n, m, p, q) for every two of a small group that size and places allow to be similar, with their sizes and places, a < b. The other's columns are null."""
    for batch in _shared(batches, percent):
        small = batch.column("small").to_numpy(zero_copy_only=False)
        token, node, place, rank = (batch.column(c).to_numpy()[small] for c in ("token", "node", "place", "rank"))
        pairs = []
        for d, may in _may(token, place, rank, percent):
            x, y = np.flatnonzero(may), np.flatnonzero(may) + d
            turn = node[x] > node[y]
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            pairs.append([node[x], node[y], rank[x] & 0xFFFFFFFF, rank[y] & 0xFFFFFFFF, place[x], place[y]])
        pairs = [pa.array(np.concatenate(c)) for c in zip(*pairs)] or [pa.array([], pa.int64())] * 4 + [pa.array([], pa.int32())] * 2
        rows = batch.filter(pa.array(~small)).drop_columns(["small"])
        none = lambda some, k: [pa.nulls(k, c.type) for c in some]
        names = [*rows.schema.names, "a", "b", "n", "m", "p", "q"]
        yield pa.RecordBatch.from_arrays([*rows.columns, *none(pairs, rows.num_rows)], names=names)
        yield pa.RecordBatch.from_arrays([*none(rows.columns, len(pairs[0])), *pairs], names=names)


def _pairs_of_few(met: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b, n, m, met of the pairs of small groups that can be similar: all that share a shingle of a small group in their longest prefixes, whatever else they share.

    Shared shingles are those of small groups in both prefixes, which were counted; of large groups in both, no more
    than either has rows of; and others, no more than either has after the last place counted, and than the one has
    after its prefix whose prefix ends first.
    """
    large = met.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("large"))
    found = met.where("a IS NOT NULL").groupBy("a", "b", "n", "m").agg(F.count("*").alias("met"), F.max("p").alias("p"), F.max("q").alias("q"))
    after = lambda n: F.greatest(F.lit(0), F.ceil(F.col(n) * percent / F.lit(100)) - most)
    rest = F.least(F.col("n") - F.col("p") - 1, F.col("m") - F.col("q") - 1, F.greatest(after("n"), after("m")))
    least = _least_common("n", "m", percent)
    # most pairs end here, or as either has no row of a large group
    found = found.withColumn("missing", least - F.col("met") - rest)
    for x in ("a", "b"):
        found = found.join(large.withColumnsRenamed({"node": x, "large": f"large_{x}"}), x, "left").where(f"missing <= coalesce(large_{x}, 0)")
    return found.select("a", "b", "n", "m", "met")


def _often_enough(shared: DataFrame, percent: int, most: int) -> DataFrame:
    """The rows of sets that share as many shingles of their longest prefix with any others as the smallest set that can be similar calls for."""
    smallest = F.ceil(F.ceil(F.col("n") * percent / F.lit(100)) * percent / F.lit(100))
    met = F.count("*").over(Window.partitionBy("node"))
    return shared.withColumn("met", met).where(F.col("met") >= F.least(F.lit(most), smallest)).drop("met")


def _needed_sets(docs: DataFrame, text: str, needed: DataFrame) -> DataFrame:
    """node and items (its set) of the needed nodes; a table of fixed size lets most others stop at the scan."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bit_table(needed.select(F.unhex(F.lpad(F.hex("node"), 16, "0")).alias("node")), "node", NEED_BITS))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for own in shingle_sets(batch.column(0).to_pylist()):
                node = node_of(own)
                if node not in seen and in_bits(held.value, node.to_bytes(8, "big", signed=True), NEED_BITS):
                    if len(seen) > _LIMIT:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "node bigint, items array<bigint>").join(needed, "node").groupBy("node").agg(F.first("items").alias("items"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, exactly. A node with many pairs is dealt over several tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(GROUP))).cast("int").alias("parts"))
    left = sets.join(many, sets.node == many.a).select("a", F.col("items").alias("left"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b").join(left, ["a", "part"])
    common = F.size(F.array_intersect("left", "right"))
    return both.select("a", "b", common.alias("common"), (F.size("left") + F.size("right")).alias("sizes")).where(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b")


def _least_common(n: str, m: str, percent: int) -> Column:
    """Shingles that sets of n and m must share to reach the similarity."""
    return F.ceil((F.col(n) + F.col(m)) * percent / F.lit(100 + percent))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with met shared shingles up to the places p and q (the last shared ones): those that can still reach the similarity, as all shared shingles but those after these places are counted."""
    return pairs.where(F.col("met") + F.least(F.col("n") - F.col("p") - 1, F.col("m") - F.col("q") - 1) >= _least_common("n", "m", percent))


def _checked(docs: DataFrame, text: str, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, with sets made again from the texts of their documents."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_needed_sets(docs, text, ends), "sets")
    found = written(_verified(pairs, sets, percent), "near")
    dropped(sets)
    settle(docs.sparkSession)
    return found


def _mixed_groups(rows: DataFrame, by: list[str], party: str, name: str) -> DataFrame:
    """The rows of the groups that hold several parties, with the party that has most of the group (top) and the group's size (df)."""
    size = rows.groupBy(*by, party).agg(F.count("*").alias("c"))
    mixed = size.groupBy(*by).agg(F.max_by(party, F.struct("c", party)).alias("top"), F.sum("c").alias("df"), F.count("*").alias("k")).where("k > 1").drop("k")
    return written(rows.join(mixed, by), name)


def _crowds(open_: DataFrame) -> DataFrame:
    """node, n, crowd, pivot, m, low for the sets in crowds: at least CROWD unsettled sets whose prefix shingles are mostly those of one component. Its first set by rank is the crowd's pivot, of m shingles; its smallest has low."""
    weights = open_.groupBy("node", "n", "rank", "top").agg(F.sum("df").alias("w"))
    own = weights.groupBy("node", "n", "rank").agg(F.max_by("top", F.struct("w", "top")).alias("crowd"))
    large = own.groupBy("crowd").agg(F.count("*").alias("c"), F.min(F.struct("rank", "node", "n")).alias("s"), F.min("n").alias("low")).where(F.col("c") >= CROWD)
    return written(own.join(large, "crowd").select("node", "n", "crowd", F.col("s.node").alias("pivot"), F.col("s.n").alias("m"), "low"), "crowds")


def _within_crowds(docs: DataFrame, text: str, crowds: DataFrame, near: DataFrame, counts: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, crowd of the sets that are done within their crowds; enough links (a, b) to join what similarity joins there).

    All of a crowd meet its pivot. Whatever a set is similar to has as many shingles as the crowd's smallest set, at
    least. If that calls for more common shingles than the set has with the pivot, two such share shingles that the
    pivot lacks, at least as many as are missing. Those outside shingles, rarer ones first, have prefixes of their own,
    in which the two meet. Sets that are similar to the pivot are joined to it already; the few others aren't done.
    """
    spark = docs.sparkSession
    sets = written(_needed_sets(docs, text, crowds.select("node")), "sets")
    pivots = sets.join(crowds.select(F.col("pivot").alias("node")).distinct(), "node").select(F.col("node").alias("pivot"), F.col("items").alias("theirs"))
    both = crowds.join(sets, "node").join(pivots, "pivot")
    outside = both.select("node", "n", "crowd", "pivot", "m", "low", F.array_except("items", "theirs").alias("outside"))
    held = spark.sparkContext.broadcast(counts)

    def cut(batches):
        for batch in batches:
            items, inside, left, prefixes, done = batch.column(6), [], [], [], []
            for i, (n, low) in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist())):
                own = items[i].values.to_numpy()
                met = n - len(own)
                low = max(low, least_overlap(n, percent))
                missing = -(-(n + low) * percent // (100 + percent)) - met
                least = max(1, missing)
                count = held.value[(own.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                prefixes.append(own[np.argsort(count, kind="stable")[: max(0, len(own) - least + 1)]])
                inside.append(met)
                left.append(len(own))
                done.append(missing > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(inside, pa.int64()), pa.array(left, pa.int64()), pa.array(done, pa.bool_()), pa.array(prefixes, pa.list_(pa.int64()))], names=["node", "n", "crowd", "pivot", "m", "inside", "left", "done", "prefix"])

    close = (F.col("node") == F.col("pivot")) | (F.col("inside") * 100 >= (F.col("n") + F.col("m") - F.col("inside")) * percent)
    cuts = outside.mapInArrow(cut, "node bigint, n bigint, crowd bigint, pivot bigint, m bigint, inside bigint, left bigint, done boolean, prefix array<bigint>")
    cuts = written(cuts.withColumn("close", close).where("close OR done").drop("done"), "outside")
    dropped(sets)
    settle(spark)
    found = written(cuts.where("close AND node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), "near")
    now = components(near.union(found))
    rows = cuts.select("crowd", "node", "n", "inside", "left", F.posexplode("prefix").alias("place", "token")).join(now, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = _mixed_groups(rows, ["crowd", "token"], "label", "outside-open")
    a = mixed.where("label <> top").select("crowd", "token", F.col("node").alias("a"), "n", F.col("inside").alias("inside_a"), F.col("left").alias("left_a"), F.col("place").alias("p"), F.col("label").alias("label_"))
    b = mixed.select("crowd", "token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("inside").alias("inside_b"), F.col("left").alias("left_b"), F.col("place").alias("q"), "label", "top")
    least = _least_common("n", "m", percent) - F.least("inside_a", "inside_b")
    places = a.join(b, ["crowd", "token"]).where("label <> label_ AND (label = top OR a < b)").where((F.col("n") * percent <= F.col("m") * 100) & (F.col("m") * percent <= F.col("n") * 100))
    places = places.where(F.least("p", "q") + 1 + F.least(F.col("left_a") - F.col("p") - 1, F.col("left_b") - F.col("q") - 1) >= least)
    turned = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("p", "q"), ("q", "p"), ("left_a", "left_b"), ("left_b", "left_a"))]
    met = places.select(*turned, least.alias("least")).groupBy("a", "b", "left_a", "left_b", "least").agg(F.count("*").alias("met"), F.max("p").alias("p"), F.max("q").alias("q"))
    pairs = written(met.where(F.col("met") + F.least(F.col("left_a") - F.col("p") - 1, F.col("left_b") - F.col("q") - 1) >= F.col("least")).select("a", "b"), "pairs")
    out = found
    if pairs.limit(1).count():
        more = _checked(docs, text, pairs, percent)
        out = written(found.union(more), "near")
        for t in (found, more):
            dropped(t)
    done = written(cuts.select("node", "crowd"), "done")
    for t in (cuts, now, mixed, pairs):
        dropped(t)
    settle(spark)
    return done, out


def links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = MOST_MATCHES) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, node; labels: node, label, without those that are alone): enough links to join all sets that similarity joins."""
    spark = docs.sparkSession
    prepare(spark)
    counts = bucket_counts(docs, text)
    settle(spark)
    signed, prefixes = signatures(docs, counts, doc_id=doc_id, text=text, percent=percent, most=most)
    signed = written(signed, "signatures")
    schema = "token bigint, salt bigint, node bigint, place int, rank bigint"
    dealt = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "rank", "node")
    columns = schema + ", pivot bigint, pivot_place int, pivot_rank bigint, a bigint, b bigint, n bigint, m bigint, p int, q int"
    both = written(dealt.mapInArrow(lambda batches: _rows_and_pairs(batches, percent), columns), "met")
    settle(spark)
    # two that share a shingle of a small group are settled as pairs, and all others by the rows of large groups alone
    few = written(_pairs_of_few(both, percent, most), "few")
    met = both.where("node IS NOT NULL").drop("a", "b", "n", "m", "p", "q")
    size_of = lambda rank: F.col(rank).bitwiseAND(F.lit((1 << 32) - 1))
    sizes = {"n": size_of("rank"), "pivot_n": size_of("pivot_rank")}
    met = written(_often_enough(met.withColumns(sizes), percent, most).drop(*sizes), "shared")
    shared = met.withColumns(sizes)
    dropped(both)
    settle(spark)

    # every member against its group's pivot, and the pivots of one shingle's salts against the first of them
    heads = shared.where("salt >= 0").select("token", "pivot", "pivot_place", "pivot_n", "pivot_rank").distinct()
    first = heads.groupBy("token").agg(F.min(F.struct("pivot_rank", "pivot", "pivot_place", "pivot_n")).alias("f"))
    across = heads.join(first, "token").where("pivot <> f.pivot").select(F.col("f.pivot").alias("a"), F.col("f.pivot_place").alias("p"), F.col("f.pivot_n").alias("n"), F.col("pivot").alias("b"), F.col("pivot_place").alias("q"), F.col("pivot_n").alias("m"))
    inside = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("pivot_place").alias("p"), F.col("pivot_n").alias("n"), F.col("node").alias("b"), F.col("place").alias("q"), F.col("n").alias("m"))
    sized = inside.union(across).where((F.col("n") * percent <= F.col("m") * 100) & (F.col("m") * percent <= F.col("n") * 100))
    stars = sized.groupBy("a", "b", "n", "m").agg(F.count("*").alias("met"), F.max("p").alias("p"), F.max("q").alias("q"))
    # other groups of the same two may have other pivots, so these pairs' counts are too low: they count twice here, and what is missed is found below
    stars = _possible(stars.withColumn("met", 2 * F.col("met")), percent).select("a", "b")
    # a pivot may have left all its groups
    stars = stars.join(shared.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # of the pairs of small groups first the one of each set that shares most
    ends = few.select("a", "b", "met", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max(F.struct("met", "a", "b")).alias("x")).select("x.a", "x.b")
    stars = written(stars.union(best).distinct(), "stars")
    near = _checked(docs, text, stars, percent)
    labels = components(near)

    # what the pivots didn't settle: members of different components that share shingles of their prefixes
    open_ = _mixed_groups(shared.join(labels, "node", "left").select("token", "node", "place", "n", "rank", F.coalesce("label", "node").alias("label")), ["token"], "label", "open")
    dropped(met)
    crowds = _crowds(open_)
    done = crowds.select("node", "crowd")
    if crowds.limit(1).count():
        done, found = _within_crowds(docs, text, crowds, near, counts, percent)
        before, near = near, written(near.union(found), "near")
        for t in (before, found, labels, crowds):
            dropped(t)
        labels = components(near)
    # pairs of one crowd are done: a row's party is its crowd or else its component, and only different parties meet
    parties = open_.select("token", "node", "place", "n").join(done, "node", "left").join(labels, "node", "left")
    parties = parties.select("token", "node", "place", "n", F.coalesce("label", "node").alias("label"), F.coalesce("crowd", "label", "node").alias("party"))
    mixed_rows = _mixed_groups(parties, ["token"], "party", "parties")
    dropped(open_)
    dropped(done)
    facts = signed.where("new").select("node", "n", "rare", "often").distinct()
    smallest = facts.where("rare < n").groupBy("often").agg(F.min(F.struct("n", "node")).alias("s")).select(F.col("s.node").alias("node"), F.lit(True).alias("smallest"))
    own = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("bigint")  # places up to own are in the 1-prefix
    # a prefix that reaches frequent shingles is matched on one shingle; all rarer ones are joined as they are
    bound = F.when(F.col("rare") < own + most, F.lit(1)).otherwise(F.least(F.lit(most), F.ceil(F.col("n") * percent / F.lit(100)))).cast("int")
    # whatever a set shares with sets of other parties is in its rows: up to a place, at most the rows so far are common
    alive = F.row_number().over(Window.partitionBy("node").orderBy("place"))
    reach = mixed_rows.withColumn("alive", alive).where(F.col("alive") + F.col("n") - F.col("place") - 1 >= F.ceil(F.col("n") * percent / F.lit(100)))
    open_ = reach.join(facts.select("node", "rare"), "node").join(smallest, "node", "left").withColumns({"own": own, "bound": bound})
    scans = open_.groupBy("node").agg(F.max("bound").alias("bound"), *(F.sum(F.when(F.col("place") <= F.col("own") + i - 1, F.col("df") - 1).otherwise(0)).alias(f"scan{i}") for i in range(1, most + 1)))
    costs = F.array(*(F.struct((F.when(F.col("bound") >= i, F.col(f"scan{i}") * (1 + F.lit(float(COMPARE)) / i)).otherwise(F.lit(float("inf")))).alias("cost"), F.lit(i).alias("need")) for i in range(1, most + 1)))
    rows = written(open_.drop("bound").join(scans.select("node", F.array_min(costs)["need"].alias("need")), "node"), "rows")
    settle(spark)
    left = rows.select("token", F.col("node").alias("a"), F.col("place").alias("p"), "n", F.col("label").alias("label_"), F.col("party").alias("party_"), F.col("need").alias("need_"), F.col("own").alias("own_"), F.col("rare").alias("rare_"), F.col("alive").alias("alive_"), F.col("party") == F.col("top"))
    left = left.toDF(*left.columns[:-1], "in_top")
    right = rows.select("token", F.col("node").alias("b"), F.col("place").alias("q"), F.col("n").alias("m"), "label", "party", "top", "need", "own", "rare", "alive", "smallest")
    least = F.least("need", "need_")

    def shared_places(left: DataFrame, right: DataFrame, once: str) -> DataFrame:
        """Shingles that two of different components have in their prefixes; each once for a pair."""
        both = left.join(right, "token").where(f"label <> label_ AND party <> party_ AND {once}").where((F.col("n") * percent <= F.col("m") * 100) & (F.col("m") * percent <= F.col("n") * 100))
        both = both.where((F.col("p") <= F.col("own_") + least - 1) & (F.col("q") <= F.col("own") + least - 1))
        both = both.where(F.least("alive", "alive_") + F.least(F.col("n") - F.col("p") - 1, F.col("m") - F.col("q") - 1) >= _least_common("n", "m", percent))
        return both.select("a", "b", "n", "m", "p", "q", least.alias("least"))

    def candidates(places: DataFrame) -> DataFrame:
        found = places.groupBy("a", "b", "n", "m").agg(F.count("*").alias("met"), F.max("p").alias("p"), F.max("q").alias("q"), F.min("least").alias("least")).where("met >= least")
        return _possible(found, percent).select("a", "b")

    rare_left, often_left = left.where("p < rare_"), left.where("p >= rare_")
    rare_right, partners = right.where("q < rare"), right.where("q >= rare AND smallest")
    # which side a set is on depends on the shingle's group: pairs are turned one way before their shingles are counted
    turned = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n", "m"), ("m", "n"), ("p", "q"), ("q", "p"))]
    rare = shared_places(rare_left.where("NOT in_top"), rare_right, "(party = top OR a < b)").select(*turned, "least")
    often = shared_places(often_left.where("NOT in_top"), partners, "true").union(shared_places(often_left.where("in_top"), partners.where("party <> top"), "true"))
    of = lambda x: labels.withColumnsRenamed({"node": x, "label": f"label_{x}"})
    apart = few.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")
    rest = candidates(rare).union(candidates(often)).union(apart).distinct().join(stars, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    if rest.limit(1).count():
        more = _checked(docs, text, rest, percent)
        if more.limit(1).count():
            dropped(labels)
            labels = components(near.union(more))
        dropped(more)
    for t in (few, stars, mixed_rows, rows, rest, near):
        dropped(t)
    settle(spark)
    return signed.select("doc_id", "n", "node"), labels


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = MOST_MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    rows, labels = links(docs, doc_id=doc_id, text=text, percent=percent, most=most)
    firsts = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = written(firsts.join(least, "label").select("node", "component_id"), "classes")
    return rows.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, that are left when exactly one row of each component stays: one of its smallest id, null ids last. Rows with an empty set all stay. Rows are told apart by a hash of id and text; of rows that repeat both, any one stands for all."""
    (key,) = fresh(docs, "_key")
    own = F.xxhash64(F.col(doc_id), F.col(text))
    rows, labels = links(docs.select(F.struct(F.col(doc_id).alias("id"), own.alias("key")).alias("place"), F.col(text).alias("text")), doc_id="place", text="text", percent=percent)
    place = F.struct(F.col("doc_id.id").isNull().alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.key").alias("key"))
    places = written(rows.where("n > 0").groupBy("node", place.alias("place")).agg(F.count("*").alias("copies")), "places")
    firsts = places.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("c")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = firsts.groupBy("label").agg(F.min("first").alias("kept"), F.sum("c").alias("c")).where("c > 1").select("label", F.col("kept.key").alias("kept"))
    gone = firsts.select("node", "label").join(least, "label").join(places, "node").where("place.key <> kept").select(F.col("place.key").alias(key), F.lit(False).alias("stays"))
    # a row that stays and occurs several times: all but one go
    once = places.where("copies > 1").select(F.col("place.key").alias(key), F.lit(True).alias("stays")).join(gone.select(key), key, "left_anti")
    found = written(gone.union(once), "gone")
    dropped(places)
    keyed = docs.withColumn(key, own)
    left = keyed.join(found.select(key), key, "left_anti").select(*docs.columns)
    if not found.where("stays").limit(1).count():
        return left
    return left.union(keyed.join(found.where("stays").select(key), key, "left_semi").dropDuplicates([key]).select(*docs.columns))
