"""Media columns: 8-bit sound made of content-defined chunks that are stored once.

A text's bytes, padded with spaces to a positive multiple of ``FRAME``, are the
samples of a mono 8-bit WAV file.  The file is cut where a rolling gear hash of
the last ``WINDOW`` bytes has its top bits zero, so equal passages give equal
chunks wherever they stand.

* Writing: each task appends the chunks that are new to it, compressed, to a pack
  of its own, and returns a recipe for each row: the ordered digests of its
  chunks and where the task put them.
* Deduplication: an aggregation over digests gives every chunk one place; recipes
  are joined with it on the digest, so only digests and places are shuffled,
  never payloads.  Copies in other packs are no longer referred to.
* Reading: the recipes of different files are sorted by place, and tasks read the
  byte ranges they need, neighbours in one read; each file is rebuilt and checked
  against the digest of the file that was stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, mixed, saved, slices
from sparkloom.llm.files import Input, Output, coalesced, reading_tasks

#: Bytes of a frame of samples, sample rate.
FRAME, RATE = 192, 8000
#: Least, usual (a power of two) and greatest bytes of a chunk; bytes that decide on a cut.
LEAST, USUAL, MOST, WINDOW = 2048, 8192, 65536, 32
_GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_DIGEST_BYTES = 16
#: Packs are closed at this size; reads are joined over this gap, up to this length.
PACK_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 256 << 10, 8 << 20
#: Stored bytes of the files that are rebuilt together.
HELD_BYTES = 4 << 20


def wav_header(samples: int) -> bytes:
    """The 44 bytes before the samples of an 8-bit mono WAV file."""
    def u(x: int, n: int) -> bytes:
        return x.to_bytes(n, "little")

    return b"RIFF" + u(36 + samples, 4) + b"WAVEfmt " + u(16, 4) + u(1, 2) + u(1, 2) + u(RATE, 4) + u(RATE, 4) + u(1, 2) + u(8, 2) + b"data" + u(samples, 4)


def to_media(text: str | None) -> tuple[bytes, int]:
    """The stored form of a text and the bytes of the text itself."""
    raw = (text or "").encode()
    samples = raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME)
    return wav_header(len(samples)) + samples, len(raw)


def samples_of(media: bytes) -> bytes:
    """The samples of a stored file."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this format")
    return media[44 : 44 + int.from_bytes(media[40:44], "little")]


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the gear hash of the last WINDOW bytes: the sum of their gears, each shifted left by its distance."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)  # doubles the window
        width *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    wanted = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - (USUAL - LEAST).bit_length() + 1) == 0) + 1
    ends, at = [], 0
    while len(data) - at > LEAST:
        k = np.searchsorted(wanted, at + LEAST)
        end = min(int(wanted[k]) if k < len(wanted) else len(data), at + MOST, len(data))
        ends.append(end)
        at = end
    if at < len(data) or not ends:
        ends.append(len(data))
    return ends


def _pieces(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=_DIGEST_BYTES).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store_chunks(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the chunks of every row's file and return the recipes, a table in the shared folder.

    (doc_id, n_bytes, media_id, pack, chunks): the bytes of the text, the SHA-256
    of the file, the pack written by the task, and for each chunk in order its
    digest and its offset and length in the pack.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "packs")
    chunk = pa.struct([("digest", pa.binary()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6).compress
        out = None
        known: dict[bytes, tuple[int, int]] = {}
        for batch in slices(batches, 500):
            if out is None or out.size > PACK_BYTES:
                if out:
                    out.close()
                out, known = Output(folder, ".pack"), {}
            sizes, names, lists = [], [], []
            for text in batch.column(1).to_pylist():
                media, size = to_media(text)
                parts = []
                for piece in _pieces(media):
                    d = _digest(piece)
                    if d not in known:
                        data = squeeze(piece)
                        known[d] = (out.write(data), len(data))
                    parts.append((d, *known[d]))
                sizes.append(size)
                names.append(hashlib.sha256(media).digest())
                lists.append([dict(zip(("digest", "offset", "length"), x, strict=True)) for x in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array([out.path] * len(sizes), pa.string()), pa.array(lists, pa.list_(chunk))], names=["doc_id", "n_bytes", "media_id", "pack", "chunks"])
        if out:
            out.close()

    return saved(_texts(docs).mapInArrow(write, "doc_id long, n_bytes long, media_id binary, pack string, chunks array<struct<digest: binary, offset: bigint, length: bigint>>"), "recipes")


def deduplicated(recipes: DataFrame) -> DataFrame:
    """(media_id, parts) of every file once: the ordered places of its chunks, each digest having one place."""
    each = recipes.select("media_id", "pack", F.posexplode("chunks").alias("number", "chunk")).select("media_id", "number", "pack", "chunk.*")
    places = each.groupBy("digest").agg(F.min(F.struct("pack", "offset", "length")).alias("place"))
    first = recipes.groupBy("media_id").agg(F.first("chunks.digest").alias("digests"))
    wanted = first.select("media_id", F.posexplode("digests").alias("number", "digest")).join(places, "digest")
    return wanted.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("number", "place.pack", "place.offset", "place.length"))).alias("parts"))


def rebuilt(files: DataFrame) -> DataFrame:
    """(media_id, media) of every row of ``files`` (media_id, parts), read from the packs and verified."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        for names, parts in groups(batches):
            by_pack: dict[str, set[tuple[int, int]]] = {}
            for p in (p for x in parts for p in x):
                by_pack.setdefault(p["pack"], set()).add((p["offset"], p["length"]))
            chunks: dict[tuple[str, int], bytes] = {}
            for pack, wanted in by_pack.items():
                source, ranges = Input(pack), sorted(wanted)
                for at, length, lo, hi in coalesced(ranges, GAP_BYTES, READ_BYTES):
                    data = source.read(at, length)
                    for offset, n in ranges[lo:hi]:
                        chunks[pack, offset] = data[offset - at : offset - at + n]
                source.close()
            media = [b"".join(grow(chunks[p["pack"], p["offset"]]) for p in x) for x in parts]
            if any(hashlib.sha256(m).digest() != n for m, n in zip(media, names, strict=True)):
                raise ValueError("a rebuilt file differs from the one that was stored")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(media, pa.binary())], names=["media_id", "media"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[list[dict]]]]:
        """Files whose stored chunks have up to HELD_BYTES together, or one larger file."""
        for batch in batches:
            names, parts, size = [], [], 0
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = sum(p["length"] for p in part)
                if names and size + more > HELD_BYTES:
                    yield names, parts
                    names, parts, size = [], [], 0
                names.append(name)
                parts.append(part)
                size += more
            if names:
                yield names, parts

    bytes_ = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    tasks = reading_tasks(files.select(bytes_.alias("length")))
    near = files.repartitionByRange(tasks, F.col("parts")[0]["pack"], F.col("parts")[0]["offset"]).sortWithinPartitions(F.col("parts")[0]["pack"], F.col("parts")[0]["offset"])
    return near.select("media_id", "parts").mapInArrow(build, "media_id binary, media binary")


def sound_features(samples: bytes) -> str:
    """Mean, standard deviation, share of zero crossings around the mean and loudest frame of 8-bit samples, as text."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean()
    high = x > mean
    frames = x.reshape(-1, FRAME).astype(np.float64)
    loud = np.sqrt(((frames - 128) ** 2).mean(1)).max()
    return f"mean={mean:.4f};std={x.std():.4f};zcr={np.mean(high[1:] != high[:-1]):.4f};peak={loud:.4f}"


def media_features(media: DataFrame) -> DataFrame:
    """(media_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored files (media_id, media)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            files = batch.column(1).to_pylist()
            samples = [samples_of(m) for m in files]
            columns = [
                batch.column(0),
                pa.array(map(len, samples), pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples], pa.string()),
                pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                pa.array(map(len, files), pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in files], pa.string()),
                pa.array(map(sound_features, samples), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(read, "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row of ``docs`` (doc_id, text).

    Null and empty texts are one frame of spaces.  Everything but doc_id and
    n_bytes is computed from the file as rebuilt from the store, once for equal
    texts.
    """
    recipes = store_chunks(docs)
    features = media_features(rebuilt(saved(deduplicated(recipes), "files")))
    return recipes.select("doc_id", "n_bytes", "media_id").join(features, "media_id").drop("media_id")
