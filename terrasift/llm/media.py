"""Media columns with content-defined chunking.

A payload is stored as 8-bit PCM samples behind a WAV header. A rolling gear hash cuts the media into chunks where its
content says so, so equal passages give equal chunks wherever they stand. Chunks are known by digest; Spark joins find
which digests occur in more than one place. Those chunks are kept once in a chunk table, the others beside the list of
chunks that their media is made of. Reading back puts the ordered lists together again and verifies every digest.

Bytes of a media move only if it shares a chunk, and then once, keyed by the media's digest: copies move once for all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_column, checkpoint, map_batches, positional

UNIT = 192
RATE = 8000
#: Least, usual and most bytes of a chunk.
LEAST, USUAL, MOST = 512, 2048, 16384
#: Shared digests (8 bytes each) that are broadcast at most; beyond it every chunk is treated as shared.
SHARED = 4_000_000
GEAR = np.random.default_rng(20240502).integers(0, 1 << 32, 256, dtype=np.uint32)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload and the text's own bytes: spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def wav(payload: bytes) -> bytes:
    """Mono 8-bit samples at RATE, one for each byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file; its chunks are walked, so a header of another length is read too."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last 32 bytes, by doubling: h[i] = sum of GEAR[b[i - j]] << j, modulo 2**32."""
    h = GEAR[data]
    for k in range(5):
        step = 1 << k
        if len(h) > step:
            h = np.concatenate((h[:step], h[step:] + (h[:-step] << np.uint32(step))))
    return h


def cuts(media: bytes) -> list[int]:
    """Where chunks end: behind a byte whose hash has its top bits clear, within LEAST and MOST bytes of the last cut."""
    n = len(media)
    if n <= LEAST:
        return [n]
    h = gear_hashes(np.frombuffer(media, np.uint8))
    marks = np.flatnonzero((h >> np.uint32(21)) == 0) + 1  # one in USUAL
    out, last = [], 0
    while n - last > LEAST:
        k = np.searchsorted(marks, last + LEAST)
        end = int(marks[k]) if k < len(marks) else n
        last = min(end, last + MOST, n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(media: bytes) -> list[tuple[int, bytes]]:
    """(digest as a signed 64-bit part of SHA-256, bytes) of each chunk in order."""
    out, last = [], 0
    for end in cuts(media):
        piece = media[last:end]
        out.append((int.from_bytes(hashlib.sha256(piece).digest()[:8], "big", signed=True), piece))
        last = end
    return out


def features(payload: bytes, count: int) -> str:
    """Statistics of the samples as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32)
    hist = np.bincount(x, minlength=256) / len(x)
    entropy = -(hist[hist > 0] * np.log2(hist[hist > 0])).sum()
    step = np.abs(np.diff(x))
    return f"chunks={count};mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};step={step.mean():.4f};crossings={int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())}"


READ = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def read_back(media: bytes, sha: str, count: int) -> tuple:
    """A row of READ, from stored bytes alone; a media whose digest isn't the one it was stored under is an error."""
    if hashlib.sha256(media).hexdigest() != sha:
        raise ValueError(f"media {sha} does not have its digest")
    payload = samples(media)
    return sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), features(payload, count)


_READ_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_sha256, digests): the ordered chunk list of every row's media."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, shas, lists = [], [], []
            for text in batch.column(1):
                payload, n = padded(text.as_py())
                media = wav(payload)
                sizes.append(n)
                shas.append(hashlib.sha256(media).hexdigest())
                lists.append([d for d, _ in chunks(media)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "media_sha256", "digests"])

        return step

    return map_batches(docs, make, "doc_id long, n_bytes long, media_sha256 string, digests array<long>")


def store(docs: DataFrame, shared: np.ndarray | None) -> DataFrame:
    """The stored form, a row for each chunk that must travel and for each media.

    kind 0: a media none of whose chunks is shared, as it is; kind 1: a media's chunk list with the bytes of its own
    chunks (null where shared); kind 2: a shared chunk. Bytes are compressed. shared None: every chunk counts as shared.
    A task sends a media or chunk that it has sent before once more at most after every million of them.
    """
    bound = docs.sparkSession.sparkContext.broadcast(shared)

    def make():
        known = bound.value
        seen: set = set()
        pack = zstandard.ZstdCompressor(level=3).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, keys, shas, places, pieces, counts = [], [], [], [], [], []
            for text in batch.column(1):
                media = wav(padded(text.as_py())[0])
                sha = hashlib.sha256(media).hexdigest()
                if len(seen) > 1_000_000:
                    seen.clear()
                if sha in seen:
                    continue
                seen.add(sha)
                own = chunks(media)
                digests = np.array([d for d, _ in own])
                if known is None:
                    common = np.ones(len(own), bool)
                else:
                    at = np.minimum(np.searchsorted(known, digests), max(0, len(known) - 1))
                    common = known[at] == digests if len(known) else np.zeros(len(own), bool)
                if not common.any():
                    rows = [(0, None, sha, 0, pack(media))]
                else:
                    rows = [(1, d if c else None, sha, k, None if c else pack(piece)) for k, ((d, piece), c) in enumerate(zip(own, common.tolist(), strict=True))]
                    for (d, piece), c in zip(own, common.tolist(), strict=True):
                        if c and d not in seen:
                            seen.add(d)
                            rows.append((2, d, None, 0, pack(piece)))
                for kind, key, name, place, piece in rows:
                    kinds.append(kind)
                    keys.append(key)
                    shas.append(name)
                    places.append(place)
                    pieces.append(piece)
                    counts.append(len(own))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(shas, pa.string()), pa.array(places, pa.int32()), pa.array(counts, pa.int32()), pa.array(pieces, pa.binary())], names=["kind", "digest", "media_sha256", "place", "count", "bytes"])

        return step

    return map_batches(docs, make, "kind int, digest long, media_sha256 string, place int, count int, bytes binary")


def rebuilt(stored: DataFrame) -> DataFrame:
    """READ for each media of the stored form; media that share chunks get them by a join on the digest."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = [read_back(unpack(b.as_py()), s.as_py(), c.as_py()) for s, c, b in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _READ_TYPES, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for sha, parts in zip(*batch.columns, strict=True):
                pieces = {p["place"]: p["bytes"] for p in parts.as_py()}
                rows.append(read_back(b"".join(unpack(pieces[k]) for k in sorted(pieces)), sha.as_py(), len(pieces)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _READ_TYPES, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    alone = stored.filter("kind = 0").select("media_sha256", "count", "bytes").mapInArrow(whole, READ)
    parts = stored.filter("kind = 1").select("media_sha256", "place", "digest", "bytes")
    table = stored.filter("kind = 2").groupBy("digest").agg(F.first("bytes").alias("chunk"))
    refs = parts.filter("bytes IS NULL").select("media_sha256", "place", "digest").distinct()
    got = refs.join(table, "digest").select("media_sha256", "place", F.col("chunk").alias("bytes"))
    own = parts.filter("bytes IS NOT NULL").select("media_sha256", "place", "bytes")
    lists = own.unionByName(got).groupBy("media_sha256").agg(F.collect_list(F.struct("place", "bytes")).alias("parts"))
    return alone.dropDuplicates(["media_sha256"]).unionByName(lists.mapInArrow(joined, READ))


def chunked_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = SHARED) -> DataFrame:
    """A row for each document with what was read back from its stored media.

    A null text is empty, and an empty one is UNIT spaces. Equal texts share one media and all its values; repeated rows
    and ids each get a row; an empty table has none; texts of any length are stored whole; other columns are ignored,
    whatever their names. Beyond `most` shared digests every chunk goes through the join; the values are the same.
    """
    rows = positional(docs).select(at_column(docs, id_column).cast("long").alias("doc_id"), at_column(docs, text_column).cast("string").alias("text"))
    lists = checkpoint(manifests(rows))
    uses = lists.select("media_sha256", F.explode("digests").alias("digest"))
    twice = checkpoint(uses.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))
    shared = None
    if twice.count() <= most:
        shared = np.sort(twice.toArrow().column(0).to_numpy())
    media = rebuilt(checkpoint(store(rows, shared)))  # written once, read by kind
    return lists.select("doc_id", "n_bytes", "media_sha256").join(media, "media_sha256")
