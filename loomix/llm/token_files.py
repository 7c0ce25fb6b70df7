"""Token-ID output: documents as token ids in bit-plane-shuffled binary files.

File layout (integers little-endian):

    magic b"LMXTOK1\\n"
    chunks, one after the other, each holding whole documents:
        zstd frame of the planes of the documents' ids
    index, a zstd frame of int64 values: for each document its id and its number of ids,
    and for each chunk its offset, packed size, number of ids and of documents
    footer: int64 number of chunks, int64 number of documents, int64 index offset, magic

A chunk's ids are cut into blocks of ``block`` ids; a block is transposed into its 32 bit
planes (``planes="bit"``) or 4 byte planes (``planes="byte"``), so that the seldom used high
bits of all ids lie together and compress to almost nothing.

Defined results: the string of an added token in a text, such as <|endoftext|>, gets that token's id, as in
the library; a null or empty text yields only the end id; rows with a null id are sorted
first, in files as any other, with their id stored as the smallest int64 and read as null;
rows that repeat an id follow one another in the order of a hash of their texts, then of the texts, each as
often as it occurs; an empty table writes no file and reads as
an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..paths import new_path
from . import _bpe
from ._text import slices

MAGIC = b"LMXTOK1\n"
NO_ID = -(2**63)
#: Ids in a chunk, as near as whole documents allow.
CHUNK_IDS = 1 << 18


def shuffle_planes(ids: np.ndarray, block: int = 4096, planes: str = "bit") -> bytes:
    """The planes of each block of 32-bit ids; the last block is filled with zeros."""
    n = -len(ids) % block
    blocks = np.concatenate([ids.astype("<u4"), np.zeros(n, "<u4")]).reshape(-1, block)
    if planes == "byte":
        return np.ascontiguousarray(blocks.view(np.uint8).reshape(len(blocks), block, 4).transpose(0, 2, 1)).tobytes()
    bits = np.unpackbits(blocks.view(np.uint8).reshape(len(blocks), block, 4), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").tobytes()


def restore_planes(data: bytes, n: int, block: int = 4096, planes: str = "bit") -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if planes == "byte":
        out = np.ascontiguousarray(raw.reshape(-1, 4, block).transpose(0, 2, 1))
    else:
        bits = np.unpackbits(raw.reshape(-1, 32, block // 8), axis=2, bitorder="little")
        out = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return out.reshape(-1).view("<u4")[:n]


class Writer:
    """Writes one file, chunk after chunk."""

    def __init__(self, out, block: int, planes: str, level: int = 3):
        self.out, self.block, self.planes, self.packer = out, block, planes, zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) or len(MAGIC)
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.chunks: list[tuple[int, int, int, int]] = []

    def chunk(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        packed = self.packer.compress(shuffle_planes(ids, self.block, self.planes))
        self.out.write(packed)
        self.chunks.append((self.at, len(packed), len(ids), len(doc_ids)))
        self.docs.append((doc_ids, counts))
        self.at += len(packed)

    def close(self) -> None:
        docs = np.concatenate([np.stack(x, 1) for x in self.docs]) if self.docs else np.zeros((0, 2), np.int64)
        index = np.concatenate([docs.reshape(-1), np.array(self.chunks, np.int64).reshape(-1)]).astype("<i8")
        self.out.write(self.packer.compress(index.tobytes()))
        self.out.write(struct.pack("<qqq", len(self.chunks), len(docs), self.at) + MAGIC)


def read_file(f, block: int, planes: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of a file: ids of documents, ids in each, all ids."""
    f.seek(f.size() - 32)
    n_chunks, n_docs, at = struct.unpack("<qqq", (foot := f.read(32))[:24])
    if foot[24:] != MAGIC:
        raise ValueError("not a token file")
    size = f.size() - 32 - at
    f.seek(at)
    unpack = zstandard.ZstdDecompressor()
    index = np.frombuffer(unpack.decompress(f.read(size)), "<i8")
    docs, chunks = index[: 2 * n_docs].reshape(-1, 2), index[2 * n_docs :].reshape(-1, 4)
    if len(chunks) != n_chunks:
        raise ValueError("damaged index")
    first = 0
    for offset, packed, n, count in chunks:
        f.seek(int(offset))
        yield docs[first : first + count, 0], docs[first : first + count, 1], restore_planes(unpack.decompress(f.read(int(packed))), int(n), block, planes)
        first += count


def write_token_files(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, files: int | None = None, block: int = 4096, planes: str = "bit") -> DataFrame:
    """Writes one file per range of ids under path; returns (part, name, docs, ids) of the files.

    Files are ascending: all ids of a file precede those of the next. A task writes under its
    own name and moves the file into place at its end, so a task may be run again at any time.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = ["id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(path)
        name, draft = f"part-{part:06d}.tok", f"part-{part:06d}.{task.taskAttemptId()}.draft"
        encoder, out, held, docs, total = _bpe.cached(tokenizer), None, [], 0, 0

        def flush() -> None:
            writer.chunk(*(np.concatenate(x) for x in zip(*held)))
            held.clear()

        for _, s in slices(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{draft}")
                writer = Writer(out, block, planes)
            ids, counts = encoder.encode(s, end_id)
            doc_ids = s.ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            held.append((doc_ids, counts, ids))
            docs, total = docs + len(doc_ids), total + len(ids)
            if sum(len(x[2]) for x in held) >= CHUNK_IDS:
                flush()
        if out is not None:
            if held:
                flush()
            writer.close()
            out.close()
            fs.move(f"{root}/{draft}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "name", "docs", "ids"])

    return rows.mapInArrow(write, "part int, name string, docs long, ids long")


def read_token_files(spark: SparkSession, path: str, files: list[tuple[str, int]], block: int = 4096, planes: str = "bit", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    files: each file's name and the number of ids in the files before it.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    for doc_ids, counts, ids in read_file(f, block, planes):
                        ends = np.cumsum(counts)
                        begins = ends - counts
                        raw = ids.tobytes()
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                        columns = [pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), pa.array(begins + start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), pa.array(ids, pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, c.type) for n, c in zip(["doc_id", "start", "n_tokens", "ids_crc32", "ids"], columns)]))
                        start += len(ids)

    table = spark.createDataFrame(files, "name string, start long")
    return table.repartition(len(files)).mapInArrow(read, schema)


def token_files(df: DataFrame, tokenizer: str, path: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Writes df's texts as token files and reads them back.

    The driver gathers one row per file, never per document.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "tokens")
    found = sorted(write_token_files(df, path, tokenizer, **options).collect())
    starts = np.concatenate([[0], np.cumsum([x["ids"] for x in found])]).tolist()
    keep = {k: v for k, v in options.items() if k in ("block", "planes")}
    return read_token_files(spark, path, [(x["name"], s) for x, s in zip(found, starts)], with_ids=with_ids, **keep)
