"""Media columns by content-defined chunking.

A text's payload is its UTF-8 bytes, filled with bytes 0 up to a positive multiple of 64. A rolling gear hash cuts it
where its content says so; chunks are told apart by digest. A Spark join of the digests picks one owner for each chunk:
the store has every chunk once, in its owner's body, and every payload as an ordered list of chunk digests. Reading
back takes a payload's own chunks from its body, fetches the others by a join on their digests, and verifies the result.

Only payloads that share chunks, or occur several times, are shuffled; the rest are stored by the task that reads them.
A bit table of fixed size says at the scan which are surely alone; if it mistakes one, that one is shuffled too.

The stored form (media) of a payload: its head (MAGIC, its length and chunk count, digest and length of each chunk),
which is stored with it, then its chunks' 8-bit samples in order, each of which is stored in its owner's body. The store
holds these bytes as they are; only Parquet compresses them. Reading back takes head and samples from the store.

Defined results. A null text counts as empty; an empty text is 64 bytes 0. Equal texts are stored once and give equal
values. Repeated rows each give a row. Texts may be of any length that a row may have. Of several places of one chunk,
the least key and place owns it. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, dropped, in_bits, prepare, written

UNIT = 64
LEAST, MOST, MASK_BITS = 256, 8192, 10
MAGIC = b"CDC8"
NEED_BITS = 23
_SPAN = 32  # bytes that the 32-bit gear hash depends on
_BLOCK = 1 << 22
_LIMIT = 1_000_000
#: The gear: a 32-bit number for each byte value, from a fixed rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "big") for b in range(256)], np.uint32)
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _marks(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) after bytes where the gear hash has its top bits 0; the first _SPAN - 1 bytes are left out."""
    h = GEAR[data]
    width = 1
    while width < _SPAN:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return np.flatnonzero((h[_SPAN - 1 :] & _MASK) == 0) + _SPAN


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one payload."""
    raw = np.frombuffer(data, np.uint8)
    marks: list[int] = []
    for at in range(0, len(raw), _BLOCK):
        start = max(0, at - _SPAN + 1)
        marks += (_marks(raw[start : at + _BLOCK]) + start).tolist() if len(raw) - start >= _SPAN else []
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[s:e] for s, e in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def head(data: bytes, parts: list[bytes], digests: list[bytes]) -> bytes:
    return MAGIC + struct.pack("<QI", len(data), len(parts)) + b"".join(d + struct.pack("<I", len(p)) for d, p in zip(digests, parts))


def recipe(stored: bytes) -> tuple[int, list[bytes], list[int]]:
    """Of a stored head: the payload's length, its chunks' digests and lengths."""
    length, n = struct.unpack_from("<QI", stored, len(MAGIC))
    pairs = list(struct.iter_unpack("<16sI", stored[len(MAGIC) + 12 :]))
    if not stored.startswith(MAGIC) or len(pairs) != n or sum(size for _, size in pairs) != length:
        raise ValueError("a stored head is not one of a payload")
    return length, [d for d, _ in pairs], [size for _, size in pairs]


def features(data: bytes, n_chunks: int) -> str:
    """Of the 8-bit samples: chunks, mean, deviation, entropy in bits."""
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    values = np.arange(256)
    p = h / len(data)
    mean = float((values * p).sum())
    spread = max(0.0, float((values * values * p).sum()) - mean * mean) ** 0.5
    q = p[p > 0]
    return f"chunks={n_chunks};mean={mean:.4f};deviation={spread:.4f};entropy={abs(float(-(q * np.log2(q)).sum())):.4f}"


def _manifest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, key (of the payload), digests of its chunks (null where the same task gave them before)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            n, keys, lists = [], [], []
            for body in batch.column(1).to_pylist():
                data = payload(body)
                key = hashlib.sha256(data).digest()
                n.append(len(body or b""))
                keys.append(key)
                if key in seen:
                    lists.append(None)
                else:
                    if len(seen) > _LIMIT:
                        seen.clear()
                    seen.add(key)
                    lists.append([digest(c) for c in chunks(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "key", "digests"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, key binary, digests array<binary>")


_STORE = "key binary, head binary, refs array<int>, offers array<int>, body binary"
_STORE_ARROW = pa.schema([("key", pa.binary()), ("head", pa.binary()), ("refs", pa.list_(pa.int32())), ("offers", pa.list_(pa.int32())), ("body", pa.binary())])


def _stored(data: bytes, key: bytes, refs: list[int], offers: list[int]) -> tuple:
    parts = chunks(data)
    other = set(refs)
    return key, head(data, parts, [digest(c) for c in parts]), refs, offers, b"".join(c for i, c in enumerate(parts) if i not in other)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _STORE_ARROW.types)] if rows else [pa.array([], t) for t in _STORE_ARROW.types], schema=_STORE_ARROW)


def store(docs: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store, and the table its shuffled part came from. roles: key, refs, offers of payloads that share chunks or occur several times."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bit_table(roles, "key", NEED_BITS))

    def scan(batches):
        seen = set()
        for batch in batches:
            rows = []
            for body in batch.column(0).to_pylist():
                data = payload(body)
                key = hashlib.sha256(data).digest()
                if not in_bits(held.value, key, NEED_BITS):
                    rows.append(_stored(data, key, [], []))
                elif key not in seen:
                    if len(seen) > _LIMIT:
                        seen.clear()
                    seen.add(key)
                    rows.append((key, None, None, None, data))
            yield _batch(rows)

    def divided(batches):
        for batch in batches:
            yield _batch([_stored(data, key, refs or [], offers or []) for key, data, refs, offers in zip(*(c.to_pylist() for c in batch.columns))])

    first = written(docs.select("text").mapInArrow(scan, _STORE), "store", "zstd")
    shared = first.where("head IS NULL").groupBy("key").agg(F.first("body").alias("body")).join(roles, "key", "left").select("key", "body", "refs", "offers")
    second = written(shared.mapInArrow(divided, _STORE), "store", "zstd")
    return first.where("head IS NOT NULL").union(second), first


def read_back(kept: DataFrame) -> DataFrame:
    """key and values of every payload, gathered from the store and verified against its key."""

    def offered(batches):
        for batch in batches:
            names, parts = [], []
            for stored, refs, offers, body in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                _, digests, sizes = recipe(stored)
                at, other, wanted = 0, set(refs), set(offers)
                for i, n in enumerate(sizes):
                    if i not in other:
                        if i in wanted:
                            names.append(digests[i])
                            parts.append(body[at : at + n])
                        at += n
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(parts, pa.binary())], names=["digest", "part"])

    def gathered(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, stored, refs, _, own, found in zip(*(c.to_pylist() for c in batch.columns)):
                length, digests, sizes = recipe(stored)
                at, got, parts, other = 0, {x["at"]: x["part"] for x in found or []}, [], set(refs)
                for i, n in enumerate(sizes):
                    if i in other:
                        parts.append(got[i])
                    else:
                        parts.append(own[at : at + n])
                        at += n
                data = b"".join(parts)
                sha = hashlib.sha256(data)
                if len(data) != length or sha.digest() != key or any(digest(p) != d for p, d in zip(parts, digests)):
                    raise ValueError(f"payload {key.hex()} was not read back as stored")
                form = stored + data
                for column, value in zip(out, (key, len(data), sha.hexdigest(), zlib.crc32(data[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(data, len(parts)))):
                    column.append(value)
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "key binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    parts = kept.where(F.size("offers") > 0).mapInArrow(offered, "digest binary, part binary")
    at = len(MAGIC) + 12
    place = F.lit(at + 1) + F.col("at") * F.lit(20)  # in the head, each chunk has a digest of 16 bytes and its length
    wanted = kept.where(F.size("refs") > 0).select("key", F.explode("refs").alias("at"), "head").select("key", "at", F.col("head").substr(place, F.lit(16)).alias("digest"))
    found = wanted.join(parts, "digest").groupBy("key").agg(F.collect_list(F.struct("at", "part")).alias("found"))
    whole = kept.where(F.size("refs") == 0).withColumn("found", F.lit(None).cast("array<struct<at:int,part:binary>>")).mapInArrow(gathered, schema)
    return whole.union(kept.where(F.size("refs") > 0).join(found, "key", "left").select(*kept.columns, "found").mapInArrow(gathered, schema))


def roles_of(manifest: DataFrame) -> DataFrame:
    """key, refs (places of chunks that another payload owns), offers (places of own chunks that others refer to). A chunk's owner: its least key and place."""
    repeated = manifest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    lists = manifest.where("digests IS NOT NULL").groupBy("key").agg(F.first("digests").alias("digests"))
    rows = lists.select("key", F.posexplode("digests").alias("at", "digest"))
    owner = rows.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    several = rows.join(owner, "digest").withColumn("own", F.struct("key", "at") == F.col("owner"))
    places = lambda own: F.sort_array(F.collect_list(F.when(F.col("own") == own, F.col("at"))))
    found = several.groupBy("key").agg(places(False).alias("refs"), places(True).alias("offers"))
    none = F.array().cast("array<int>")
    return found.join(repeated, "key", "full").select("key", F.coalesce("refs", none).alias("refs"), F.coalesce("offers", none).alias("offers"))


def columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every document."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    manifest = written(_manifest(rows), "manifest")
    kept, source = store(rows, written(roles_of(manifest), "roles"))
    values = written(read_back(kept), "values")
    dropped(source)
    return manifest.select("doc_id", "n_bytes", "key").join(values, "key").drop("key")
