"""Operator 2: media columns of ISO media containers.

``probe`` walks the nested boxes of a container and decodes the sample tables of its tracks (times, chunks, sizes, offsets,
sync samples), from which come codec, duration and the byte ranges of keyframes; payloads are neither decoded nor, but for
``extract``, touched. ``pack`` stores bytes losslessly in such a container: one track of 8-bit samples in frames of ``FRAME``
bytes, ``PER_CHUNK`` frames in a chunk, every ``KEY_EVERY``-th frame a keyframe.

Defined results: a null or empty text is packed as one frame of spaces; null media give nulls; media that break off or
contradict themselves have null features and an ``error``; equal texts give equal bytes; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm.common import documents, free_name, slices, written

FRAME = 192
PER_CHUNK = 64
KEY_EVERY = 25
RATE = 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(payload: bytes) -> bytes:
    """A container of ``payload``, whose length is a positive multiple of ``FRAME``."""
    frames = len(payload) // FRAME
    chunks = -(-frames // PER_CHUNK)
    rest = frames - (chunks - 1) * PER_CHUNK
    long = len(payload) > 0xF0000000
    entry = box(b"raw ", b"\0" * 6, struct.pack(">HQHHII", 1, 0, 1, 8, 0, RATE << 16))
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, PER_CHUNK)] * (chunks > 1) + [(chunks, rest)] * (chunks == 1 or rest != PER_CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if long else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if long else ">u4").tobytes()),
        )
        info = box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        length = frames * FRAME
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, b"\0" * 8, version=1, flags=3),
                box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), info),
            ),
        )

    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join([head, movie(len(head) + len(movie(0)) + len(lead)), lead, payload])


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box as (path of kinds, start and end of its body), parents first."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if at + size < body or at + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield (*path, kind), body, at + size
        if kind in NESTED and len(path) < 16:
            yield from walk(data, body, at + size, (*path, kind))
        at += size
    if at != end and path:
        raise ValueError("bytes left over in a box")


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    sync: np.ndarray  # from 0

    @property
    def keyframes(self) -> list[tuple[int, int]]:
        return [(int(a), int(a + n)) for a, n in zip(self.offsets[self.sync], self.sizes[self.sync])]


def _table(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + skip)
    width = np.dtype(kind).itemsize * columns
    if at + skip + 4 + n * width > end:
        raise ValueError("a table breaks off")
    return np.frombuffer(data, kind, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


def tracks(media: bytes) -> list[Track]:
    """The tracks of a container, from its boxes alone."""
    data, found = memoryview(media), []
    for path, a, b in walk(data):
        if path[-1] == b"moof":
            raise ValueError("a fragmented file")
        if path[-1] == b"trak":
            found.append({})
        elif found:
            found[-1][path[-1]] = (a, b)
    out = []
    for own in found:
        a, b = own[b"mdhd"]
        timescale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        (codec,) = struct.unpack_from(">4s", data, own[b"stsd"][0] + 12)
        a, b = own[b"stsz"]
        same, n = struct.unpack_from(">II", data, a + 4)
        sizes = np.full(n, same, np.int64) if same else _table(data, a, b, 1, skip=8)[:, 0]
        times = _table(data, *own[b"stts"], 2)
        if times[:, 0].sum() != n:
            raise ValueError("times and sizes differ in number")
        chunks = (_table(data, *own[b"co64"], 1, ">u8") if b"co64" in own else _table(data, *own[b"stco"], 1))[:, 0]
        runs = _table(data, *own[b"stsc"], 3)
        each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if each.sum() != n or len(each) != len(chunks):
            raise ValueError("chunks and sizes differ in number")
        before = np.concatenate([[0], np.cumsum(sizes)])
        first = np.cumsum(each) - each  # of each chunk, its first sample
        offsets = np.repeat(chunks - before[first], each) + before[:-1]
        if n and (offsets < 0).any() or n and (offsets + sizes > len(data)).any():
            raise ValueError("samples lie outside the file")
        sync = _table(data, *own[b"stss"], 1)[:, 0] - 1 if b"stss" in own else np.arange(n)
        if len(sync) and (sync.min() < 0 or sync.max() >= n):
            raise ValueError("sync samples that are not there")
        out.append(Track(codec.decode("latin-1"), timescale, length or int((times[:, 0] * times[:, 1]).sum()), offsets, sizes, sync))
    return out


def extract(media: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in their order."""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(np.append(True, track.offsets[1:] != ends[:-1]))  # runs of samples that lie side by side
    return b"".join(media[a:b] for a, b in zip(track.offsets[cut].tolist(), ends[np.append(cut[1:] - 1, len(ends) - 1)].tolist())) if len(ends) else b""


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media``: each text in a container of its own."""
    at, kinds = df.columns.index(text), [t for _, t in df.dtypes]
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pack(padded(t)) for t in batch.column(at).to_pylist()], pa.binary())], names=[*names, "media"])

    return df.toDF(*names).mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in zip(names, kinds)), "media binary"])).toDF(*df.columns, free_name(df, "media"))


PROBED = "codec string, duration_ms bigint, n_samples bigint, keyframes array<struct<start:bigint,end:bigint>>, tracks array<struct<codec:string,duration_ms:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, error string"


def probe(df: DataFrame, media: str = "media", digests: bool = False) -> DataFrame:
    """Adds codec, duration, number of samples and keyframe byte ranges of the first track, and ``tracks`` with those of all; with ``digests`` also those of the first one's payload. Fragmented files are an ``error``, as their samples are not in the tables."""
    at, kinds = df.columns.index(media), [t for _, t in df.dtypes]
    names, added = [f"c{i}" for i in range(len(kinds))], [p.strip().split(" ")[0] for p in PROBED.split(", ")]

    def features(track: Track) -> dict:
        return {"codec": track.codec, "duration_ms": track.duration * 1000 // track.timescale, "n_samples": len(track.sizes), "keyframes": [{"start": a, "end": b} for a, b in track.keyframes]}

    def one(raw: bytes | None) -> dict:
        if raw is None:
            return dict.fromkeys(added)
        try:
            found = tracks(raw)
            track = found[0]
            out = features(track) | {"tracks": [features(t) for t in found]}
            if digests:
                payload = extract(raw, track)
                out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
            return out
        except (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error) as e:
            return {"error": f"{type(e).__name__}: {e}"[:200]}

    first = [("codec", pa.string()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    kind = pa.struct([*first, ("tracks", pa.list_(pa.struct(first))), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                found = pa.array([one(m) for m in batch.column(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, *found.flatten()], names=[*names, *added])

    out = df.toDF(*names).mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in zip(names, kinds)), PROBED]))
    return out.toDF(*df.columns, *[free_name(df, c) for c in added])


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of containers is written to the shared folder, and its media column read back and probed."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    stored = written(with_media(docs).select("doc_id", "n_bytes", "media"), "media", compression="zstd")
    ranges = F.crc32(F.to_json("keyframes").cast("binary"))
    feature = F.concat_ws(";", "codec", F.concat(F.lit("ms="), "duration_ms"), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("ranges="), F.lower(F.hex(ranges))))
    rows = probe(stored.withColumns({"media_bytes": F.octet_length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)}), digests=True)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration_ms", "keyframes")
