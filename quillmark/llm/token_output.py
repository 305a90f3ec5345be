"""Token-id output: binary shards of patched frame-of-reference blocks, written and read by Spark tasks.

A shard holds documents in ascending ``doc_id`` order::

    magic, version           8 bytes, u32
    n_docs, n_ids, block     u64, u64, u32
    sizes of the sections    4 x u64
    doc ids                  i64 each (a null id is the smallest i64)
    ids of each document     u64 each
    block starts             u64 each, offsets into the block section
    block section            one block after the other

A block of 256 ids: u32 minimum, u8 width, u8 zero, u16 number of exceptions, the low ``width`` bits
of each id less the minimum (eight lanes of 32 values, packed into 32-bit words), then a u8 position
and a u32 of high bits for each exception. The width is a percentile of the widths that the block's
values need, so that a few large ids don't widen the whole block.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.tokens import WordEncoder, default_tokenizer

MAGIC, VERSION, BLOCK = b"QMPFOR\x00\x01", 1, 256
_HEAD = "<8sIQQIQQQQ"
_NULL = np.iinfo(np.int64).min


def _lanes(values: np.ndarray, width: int) -> np.ndarray:
    """Pack the low ``width`` bits: (n, 256) values to (n, 8 * width) words."""
    n = len(values)
    v = values.reshape(n, 32, 8)
    out = np.zeros((n, width, 8), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out.reshape(n, -1)


def _unlanes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    w = words.reshape(n, width, 8)
    out = np.zeros((n, 32, 8), np.uint32)
    mask = np.uint32((1 << width) - 1) if width < 32 else np.uint32(0xFFFFFFFF)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        v = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            v = v | (w[:, word + 1] << np.uint32(32 - shift))
        out[:, i] = v & mask
    return out.reshape(n, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """The blocks of ``ids``; the last is filled up with its own last id."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    v = np.concatenate([ids.astype(np.uint32), np.repeat(ids[-1:].astype(np.uint32), short)]).reshape(-1, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    need = np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.uint8) + 1, 0).astype(np.uint8)
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(need, at, axis=1)[:, at]
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        own = v[rows]
        packed = _lanes(own & np.uint32((1 << w) - 1 if w < 32 else 0xFFFFFFFF), w) if w else np.zeros((len(rows), 0), np.uint32)
        high = own >> np.uint32(w) if w < 32 else np.zeros_like(own)
        where, pos = np.nonzero(high)
        values, pos = high[where, pos].astype("<u4"), pos.astype(np.uint8)
        cuts = np.searchsorted(where, np.arange(len(rows) + 1))
        for k, r in enumerate(rows.tolist()):
            a, b = cuts[k], cuts[k + 1]
            out[r] = struct.pack("<IBBH", int(low[r]), w, 0, int(b - a)) + packed[k].astype("<u4").tobytes() + pos[a:b].tobytes() + values[a:b].tobytes()
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids (with the filling) of the blocks that begin at ``starts`` in ``raw``."""
    out = np.zeros((len(starts), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBBH", raw, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            words = np.frombuffer(b"".join(raw[s + 8 : s + 8 + 32 * w] for s in starts[rows].tolist()), "<u4").reshape(len(rows), 8 * w)
            out[rows] = _unlanes(words, w)
    for r, (low, w, _, n) in enumerate(heads):
        if n:
            at = int(starts[r]) + 8 + 32 * w
            pos = np.frombuffer(raw, np.uint8, n, at)
            out[r, pos] |= np.frombuffer(raw, "<u4", n, at + n) << np.uint32(w)
        out[r] += np.uint32(low)
    return out.reshape(-1)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI or a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


class _Shard:
    """One pair of files that is being written: blocks as they fill up, the index at the end."""

    def __init__(self, folder: str, number: int, part: int, percentile: float):
        self.fs, place = file_system(folder)
        self.fs.create_dir(place, recursive=True)
        # Another name for each attempt; the manifest names the one that counts.
        self.number, self.part, self.percentile, name = number, part, percentile, f"shard-{number:06d}-{part:04d}-{uuid.uuid4().hex}"
        self.path, self.place = f"{folder}/{name}", f"{place}/{name}"
        self.sink = self.fs.open_output_stream(f"{self.place}.blocks")
        self.doc_ids, self.sizes, self.starts, self.at, self.n_ids, self.rest = [], [], [], 0, 0, np.zeros(0, np.uint32)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.sizes.append(sizes.astype("<u8"))
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids, self.percentile)
        ends = self.at + np.cumsum([0, *map(len, blocks)])
        self.starts.append(ends[:-1].astype("<u8"))
        self.at = int(ends[-1])
        self.sink.write(b"".join(blocks))

    def close(self) -> pa.RecordBatch:
        """Finish both files; the shard's row of the manifest."""
        self._put(self.rest)
        self.sink.close()
        parts = [np.concatenate(x).tobytes() for x in (self.doc_ids, self.sizes, self.starts)]
        n_docs = len(parts[0]) // 8
        with self.fs.open_output_stream(f"{self.place}.index") as sink:
            sink.write(struct.pack(_HEAD, MAGIC, VERSION, n_docs, self.n_ids, BLOCK, *map(len, parts), self.at))
            for p in parts:
                sink.write(p)
        row = {"shard": self.number, "part": self.part, "path": self.path, "n_docs": n_docs, "n_ids": self.n_ids, "n_bytes": self.at}
        return pa.record_batch([pa.array([v], pa.string() if k == "path" else pa.int64()) for k, v in row.items()], names=list(row))


def _writer(folder: str, tokenizer: str, end: int, percentile: float, shard_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, part, shard = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for a, b in common.byte_slices(texts, 8 << 20):
                ids, n = encoder.encode(texts.slice(a, b - a), end)
                shard = shard or _Shard(folder, number, part, percentile)
                shard.add(ids_col.slice(a, b - a).fill_null(int(_NULL)).to_numpy(), ids, n)
                if shard.n_ids >= shard_ids:
                    yield shard.close()
                    shard, part = None, part + 1
        if shard is not None:
            yield shard.close()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 2, percentile: float = 0.9, shard_ids: int = 1 << 26, task_bytes: int = 256 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards in ascending ``doc_id`` order; the manifest is returned.

    Spark deals the texts by ranges of ``doc_id``, about ``task_bytes`` of text each, and sorts each
    range; a task writes one shard after the other and begins a new one at ``shard_ids`` ids, so memory
    is bounded by a slice of texts and a shard's index. The manifest ``(shard, part, path, n_docs,
    n_ids, n_bytes, start)`` lists only the files of the attempts that counted: a task that is run
    again writes other names. Null or empty text: only the end id. Null ids come first. Equal ids keep
    no order among themselves, and all of one id are in one task. An empty table: an empty manifest.
    Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-volume // task_bytes))
    sorted_rows = rows.repartitionByRange(int(tasks), "doc_id").sortWithinPartitions("doc_id")
    schema = "shard long, part long, path string, n_docs long, n_ids long, n_bytes long"
    shards = common.written(sorted_rows.mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end, percentile, shard_ids), schema), "manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shard(path: str, blocks_at_once: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, ids of each, all their ids) of runs of documents of one shard, in order."""
    where, place = file_system(path)
    with where.open_input_stream(f"{place}.index") as f:
        raw = f.read()
    magic, version, n_docs, n_ids, block, a, b, c, size = struct.unpack_from(_HEAD, raw)
    if magic != MAGIC or version != VERSION or block != BLOCK:
        raise ValueError(f"{path} isn't a shard of this version")
    at = struct.calcsize(_HEAD)
    doc_ids, sizes, starts = np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, "<u8", n_docs, at + a).astype(np.int64), np.frombuffer(raw, "<u8", c // 8, at + a + b).astype(np.int64)
    ends = np.append(starts[1:], size)
    upto, done, have, rest = np.cumsum(sizes), 0, 0, np.zeros(0, np.uint32)
    with where.open_input_stream(f"{place}.blocks") as f:
        for k in range(0, len(starts), blocks_at_once):
            some = starts[k : k + blocks_at_once]
            part = f.read(int(ends[min(k + blocks_at_once, len(starts)) - 1] - some[0]))
            ids = decode_blocks(part, some - some[0])
            rest = np.concatenate([rest, ids[: max(0, min(len(ids), n_ids - k * BLOCK))]])
            full = int(np.searchsorted(upto, have + len(rest), "right"))
            if full > done:
                n = int(upto[full - 1] - have)
                yield doc_ids[done:full], sizes[done:full], rest[:n]
                rest, have, done = rest[n:], int(upto[full - 1]), full


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for doc_ids, sizes, ids in read_shard(path):
                raw, cuts = ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc_ids, mask=doc_ids == _NULL), pa.array(start + cuts[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                start += int(cuts[-1])


def _dealt(manifest: DataFrame, *columns: str) -> DataFrame:
    """The shards dealt out one to a partition; a manifest is too small for Spark to do so by size."""
    return manifest.repartitionByRange(max(1, manifest.count()), "shard", "part").select(*columns)


def read_digest(manifest: DataFrame) -> DataFrame:
    """Read all shards of a manifest: ``(doc_id, start, n_tokens, ids_crc32)`` of each document."""
    return _dealt(manifest, "path", "start").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            for doc_ids, sizes, ids in read_shard(path):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([pa.array(doc_ids, mask=doc_ids == _NULL), lists], names=["doc_id", "ids"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read all shards of a manifest: ``(doc_id, ids array<int>)``."""
    return _dealt(manifest, "path").mapInArrow(_ids_reader, "doc_id long, ids array<int>")
