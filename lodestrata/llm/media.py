"""Media columns: payloads stored as content-defined chunks, each chunk once, and rebuilt from ordered chunk lists.

Rolling gear hash cuts divide a medium (here: 8-bit mono WAV) into chunks. A first pass keeps only digests; Spark counts
them, and the digests that occur more than once fill a Bloom filter of bounded size. A second pass writes media: chunks that
occur once stay in their medium's row, in order; the others go, once from each task, to the chunk table, which Spark
deduplicates by digest. Media whose chunks are all their own are rebuilt where they are read; only the rest join the chunk
table. A false find of the filter merely sends a chunk the second way. Every chunk read is verified against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import cut_points
from .common import Bloom, stored, text_slices

UNIT, HEADER, RATE = 64, 44, 8000
_MEDIA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(data: bytes) -> bytes:
    """A WAV file of 8-bit mono samples: the bytes, filled with zeros to a positive multiple of 64."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size) + data.ljust(size, b"\0")


def samples(media: bytes) -> np.ndarray:
    """The samples of a WAV file as to_media() makes it."""
    riff, size, wave, _, _, coding, channels, _, _, _, bits, data, length = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, data, coding, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or length != len(media) - HEADER:
        raise ValueError("not an 8-bit mono WAV file")
    return np.frombuffer(media, np.uint8, offset=HEADER)


def features(x: np.ndarray) -> str:
    """Mean, root mean square about 128, crossings of 128 for each sample, and peak."""
    centred = x.astype(np.int32) - 128
    crossings = np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0))
    return f"mean={x.mean():.6f};rms={np.sqrt((centred * centred).mean()):.6f};crossings={crossings / len(x):.6f};peak={int(np.abs(centred).max())}"


def _media_of(part: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[bytes], list[bytes]]]:
    """Of each row: the text's bytes, the medium, its chunks and their digests."""
    texts = [(t or "").encode() for t in part.column("text").to_pylist()]
    media = [to_media(t) for t in texts]
    cuts = cut_points(np.frombuffer(b"".join(media), np.uint8), np.cumsum([len(m) for m in media]))
    for text, medium, ends in zip(texts, media, cuts, strict=True):
        chunks = [medium[a:b] for a, b in zip([0, *ends], ends)]
        yield len(text), medium, chunks, [hashlib.sha256(c).digest() for c in chunks]


def _recipe(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).digest()


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        rows = [(n, _recipe(d), d) for n, _, _, d in _media_of(part)]
        yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.binary()))))], names=["id", "n_bytes", "recipe", "digests"])


_PARTS = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))


def _store(shared: Bloom):
    """For mapInArrow: media rows (recipe, parts, null where a part is shared) and shared chunks (digest, data), each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media_seen, chunk_seen = set(), set()
        for part in text_slices(batches):
            rows = []
            for _, _, chunks, digests in _media_of(part):
                recipe = _recipe(digests)
                if recipe in media_seen:
                    continue
                parts, whole = [], True
                for chunk, digest in zip(chunks, digests, strict=True):
                    if int.from_bytes(digest[:8], "big") in shared:
                        whole = False
                        parts.append({"digest": digest, "data": None})
                        if digest not in chunk_seen:
                            chunk_seen.add(digest)
                            rows.append(("chunk", digest, [{"digest": digest, "data": chunk}]))
                    else:
                        parts.append({"digest": digest, "data": chunk})
                if not whole:  # a medium that is only its own has no copy
                    media_seen.add(recipe)
                rows.append(("whole" if whole else "parts", recipe, parts))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), _PARTS))], names=["kind", "key", "parts"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media rows (key, parts) to what is computed from the bytes read."""
    for batch in batches:
        out = []
        for recipe, parts in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            for p in parts:
                if p["data"] is None or hashlib.sha256(p["data"]).digest() != p["digest"]:
                    raise ValueError(f"chunk {p['digest'].hex()} is missing or damaged")
            if _recipe([p["digest"] for p in parts]) != recipe:
                raise ValueError(f"medium {recipe.hex()} is not whole")
            medium = b"".join(p["data"] for p in parts)
            x = samples(medium)
            payload = x.tobytes()
            out.append((recipe, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(medium), hashlib.sha256(medium).hexdigest(), features(x)))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["recipe", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def _head(column: str):
    return F.conv(F.hex(F.substring(column, 1, 8)), 16, -10).cast("long")


def store(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store texts as media: the rows (id, n_bytes, recipe), the media (kind, key, parts) and the chunk table (digest, data)."""
    docs = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = df.schema[id_column].dataType.simpleString()
    rows = stored(docs.mapInArrow(_recipes, f"id {kind}, n_bytes long, recipe binary, digests array<binary>"))
    repeated = rows.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    shared = Bloom.of(stored(repeated.select(_head("digest").alias("head"))), "head")
    staged = stored(docs.select("text").mapInArrow(_store(shared), "kind string, key binary, parts array<struct<digest:binary,data:binary>>"), partition_by=["kind"])
    chunks = staged.filter("kind = 'chunk'").select(F.col("key").alias("digest"), F.col("parts")[0]["data"].alias("data")).dropDuplicates(["digest"])
    return rows.drop("digests"), staged.filter("kind <> 'chunk'"), stored(chunks)


def load(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rebuild media from the stored bytes: recipe and what is computed from each distinct medium."""
    whole = media.filter("kind = 'whole'").select("key", "parts").mapInArrow(_read, f"recipe binary, {_MEDIA}")
    lists = media.filter("kind = 'parts'").select("key", "parts").dropDuplicates(["key"])
    parts = lists.select("key", F.posexplode("parts").alias("at", "p")).select("key", "at", "p.digest", F.col("p.data").alias("own"))
    joined = parts.filter("own is null").join(chunks, "digest", "left").select("key", "at", "digest", "data").unionByName(parts.filter("own is not null").select("key", "at", "digest", F.col("own").alias("data")))
    gathered = joined.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "data"))).alias("parts"))
    gathered = gathered.select("key", F.transform("parts", lambda p: F.struct(p["digest"].alias("digest"), p["data"].alias("data"))).alias("parts"))
    return whole.unionByName(gathered.mapInArrow(_read, f"recipe binary, {_MEDIA}"))


def media_columns(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty; an empty payload is one unit of zeros. Equal texts have equal values. Repeated rows and null
    ids stay as they are. Other columns are not read. An empty table gives an empty result.
    """
    rows, media, chunks = store(df, id_column, text_column)
    values = stored(load(media, chunks))
    return rows.join(values, "recipe").drop("recipe").withColumnRenamed("id", id_column)
