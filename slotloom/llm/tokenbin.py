"""Operator 1: token ids in binary files, by an adaptive context-mixing range coder.

Documents are dealt in ranges of doc_id, encoded with the tokenizers library and an end id each, and written as chunks of whole
documents. A chunk's ids become symbols, fewer than the ids (see ``phrases``), which are coded in blocks of ``BLOCK``, each reset, checksummed and
decodable by itself with the chunk's tables (see ``coder``). The files are Parquet tables of chunks: ``part`` and ``chunk`` give their order, ``doc_ids``
and ``lengths`` their documents, ``ids`` and ``phrases`` what its symbols stand for, ``checksum`` the crc32 of its ids, ``data`` the blocks.

Defined results: a null or empty text holds the end id alone; null doc_ids come first; rows of one doc_id lie side by side, the
lesser text first; an empty table gives no chunks; damaged blocks or tables raise ValueError rather than give wrong ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.llm import coder, phrases
from slotloom.llm.bpe import default_tokenizer
from slotloom.llm.common import documents, slices, written
from slotloom.llm.pieces import encoder

#: Symbols of a block. Blocks advance together, so that more and shorter ones are faster, and fewer and longer ones smaller. A chunk with few symbols has shorter blocks still.
BLOCK = 1 << 11
LEAST = 1 << 8
TOGETHER = 512
#: A chunk is closed once it has so many ids; a longer document is a chunk of its own.
CHUNK = 6 << 20
#: Bytes of text that are encoded together: the more, the fewer distinct words, each of which is looked at once in a slice.
SLICE = 24 << 20
END = 2
FILES = "part int, chunk int, doc_ids array<bigint>, lengths array<bigint>, ids array<int>, phrases array<int>, checksum bigint, data binary"


def write_tokens(docs: DataFrame, tokenizer: str, end: int = END, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Writes the token files of ``docs (doc_id, text)`` to the shared folder and returns them as a table of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        names, lengths, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            symbols, different, pairs = phrases.shorten(ids)
            size = min(block, max(LEAST, 1 << (len(symbols) // TOGETHER).bit_length()))
            data = b"".join(coder.encode(symbols, len(different) + len(pairs), size))
            many, some = pa.list_(pa.int64()), pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([names], many), pa.array([lengths], many), pa.array([different.astype(np.int32)], some)]
                + [pa.array([pairs.ravel().astype(np.int32)], some), pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "chunk", "doc_ids", "lengths", "ids", "phrases", "checksum", "data"],
            )

        for whole in batches:
            for batch in slices(whole, 1, rows=1 << 14, size=SLICE):
                ids, counts = encode(batch.column(1))
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
                stops, at = np.cumsum(counts), 0
                while at < len(counts):
                    first = int(stops[at - 1]) if at else 0
                    to = min(len(counts), int(np.searchsorted(stops, first + chunk - held)) + 1)
                    names += batch.column(0).slice(at, to - at).to_pylist()
                    lengths += counts[at:to].tolist()
                    parts.append(ids[first : stops[to - 1]])
                    held, at = held + int(stops[to - 1]) - first, to
                    if held >= chunk:
                        yield closed()
                        number, names, lengths, parts, held = number + 1, [], [], [], 0
        if names:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, FILES), "tokens", compression="none")


def read_tokens(files: DataFrame) -> DataFrame:
    """``(part, chunk, before, doc_id, ids)`` of each document: how many ids of its chunk come before it, and its own as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                different, pairs = np.array(row["ids"], np.int64), np.array(row["phrases"], np.int64).reshape(-1, 2)
                ids = phrases.restore(coder.decode(row["data"], len(different) + len(pairs)), different, pairs)
                if zlib.crc32(ids) != row["checksum"]:
                    raise ValueError("a chunk's checksum differs")
                ends = np.cumsum(row["lengths"])
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("blocks and documents differ in length")
                for a in range(0, len(ends), 512):
                    stop = ends[a : a + 512]
                    start = stop - row["lengths"][a : a + 512]
                    n = len(stop)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()), pa.array(start), pa.array(row["doc_ids"][a : a + 512], pa.int64()), pa.array([ids[x:y].tobytes() for x, y in zip(start, stop)], pa.binary())],
                        names=["part", "chunk", "before", "doc_id", "ids"],
                    )

    return files.mapInArrow(run, "part int, chunk int, before bigint, doc_id bigint, ids binary")


def chunk_starts(files: DataFrame) -> DataFrame:
    """``(part, chunk, first)``: how many ids come before each chunk. The driver adds up one number for each part."""
    sizes = files.select("part", "chunk", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in parts]).tolist()
    offsets = files.sparkSession.createDataFrame([(r["part"], e - r["n"]) for r, e in zip(parts, ends)], "part int, offset bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("before", before).join(offsets, "part").select("part", "chunk", (F.col("offset") + F.col("before")).alias("first"))


def op1_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(documents(spark, sf_dir, "doc_id", "text"), default_tokenizer())
    rows = read_tokens(files).select("part", "chunk", "before", "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(chunk_starts(files), ["part", "chunk"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
