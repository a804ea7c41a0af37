"""Token-id files with fixed-width bit packing.

Layout of a file: MAGIC; blocks of ``block_ids`` ids (the last may be shorter), each id in ``bits``
bits, lowest bit first, a block filled up to a whole byte; the document ids (int64) and each document's
first id's position in the file (int64, one more at the end); the byte offset of each block (int64,
one more at the end); a JSON footer; its length (uint32); MAGIC. Any range of ids needs only the
blocks that hold it, and numpy unpacks a block at once.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, only, released, text_batches
from .tokens import SLICE, text_ids, vocabulary_size

MAGIC = b"QMTOK1\0\0"


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a local path or a URI that pyarrow.fs knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, lowest first, to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype("<u4").view(np.uint8).reshape(-1, 4)) if len(ids) else np.empty((0, 4), np.uint8)
    return np.packbits(np.unpackbits(flags, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: bits * count].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Streams one file: at most a block and the documents' positions are held. The file appears under
    its name when it is whole; writing it again replaces it."""

    def __init__(self, uri: str, bits: int, block_ids: int):
        self.bits, self.block_ids = bits, block_ids
        self.fs, self.path = filesystem(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.blocks, self.at, self.held, self.n_held = [len(MAGIC)], len(MAGIC), [], 0
        self.doc_ids, self.starts, self.n_ids, self.n_null = [], [np.zeros(1, np.int64)], 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.n_null += doc_ids.null_count
        self.doc_ids.append(np.asarray(doc_ids.fill_null(0), dtype=np.int64))
        self.starts.append(offsets[1:] + self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            full = len(whole) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(whole[i : i + self.block_ids])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        if self.n_held:
            self._block(np.concatenate(self.held))
        doc_ids = np.concatenate(self.doc_ids) if self.doc_ids else np.empty(0, np.int64)
        footer = {"bits": self.bits, "block_ids": self.block_ids, "n_ids": self.n_ids, "n_docs": len(doc_ids), "n_null_ids": self.n_null, "n_blocks": len(self.blocks) - 1, "index_at": self.at}
        for part in (doc_ids, np.concatenate(self.starts), np.array(self.blocks, np.int64)):
            self.out.write(part.astype("<i8").tobytes())
        text = json.dumps(footer).encode()
        self.out.write(text + np.uint32(len(text)).tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(doc_ids), self.n_ids


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        length = int(np.frombuffer(tail[:4], np.uint32)[0])
        self.meta = json.loads(self.file.read_at(length, size - 12 - length))
        n, b, at = self.meta["n_docs"], self.meta["n_blocks"], self.meta["index_at"]
        index = np.frombuffer(self.file.read_at(8 * (2 * n + 1 + b + 1), at), "<i8")
        self.doc_ids, self.starts, self.blocks = index[:n], index[n : 2 * n + 1], index[2 * n + 1 :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; reads the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        each = self.meta["block_ids"]
        first, last = start // each, (stop - 1) // each
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        out = []
        for k in range(first, last + 1):
            count = min(each, self.meta["n_ids"] - k * each)
            out.append(unpack(data[self.blocks[k] - self.blocks[first] : self.blocks[k + 1] - self.blocks[first]], self.meta["bits"], count))
        return np.concatenate(out)[start - first * each : stop - first * each]

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16) -> DataFrame:
    """Writes all texts' ids in ascending order of the id (nulls first; equal ids by text) into files
    under ``out`` and returns their manifest: part, uri, n_docs, n_ids, first_id (ids in files before).

    Null and empty texts give only end_id. A partition by ranges of the id makes a file, and a task
    streams it; the manifest has a row a file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ordered = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pa.set_cpu_count(1)
        part, writer = TaskContext.get().partitionId(), None
        uri = f"{out}/part-{part:06d}.tok"
        for batch in text_batches(batches, slice_bytes=SLICE):
            if writer is None:
                writer = Writer(uri, max(1, (vocabulary_size(vocabulary) - 1).bit_length()), block_ids)
            writer.add(batch.column(0), *text_ids(batch.column(1), vocabulary, end_id, added=True))
            released()
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "n_docs": n_docs, "n_ids": n_ids}])

    rows = sorted(ordered.mapInArrow(write, "part long, uri string, n_docs long, n_ids long").collect())
    before, manifest = 0, []
    for row in rows:
        manifest.append((*row, before))
        before += row["n_ids"]
    return spark.createDataFrame(manifest, "part long, uri string, n_docs long, n_ids long, first_id long")


def read_token_files(manifest: DataFrame, with_ids: bool = True, step_ids: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with with_ids, ids.

    Files are read by as many tasks, about step_ids ids at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(row["uri"])
                n_null, n = file.meta["n_null_ids"], file.meta["n_docs"]
                at = 0
                while at < n:
                    to = min(n, max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + step_ids))))
                    low = int(file.starts[at])
                    ids = file.ids(low, int(file.starts[to]))
                    raw, ends = memoryview(ids.astype("<u4")).cast("B"), (4 * (file.starts[at : to + 1] - low)).tolist()
                    sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                    columns = {
                        "doc_id": pa.array(file.doc_ids[at:to], mask=np.arange(at, to) < n_null),
                        "start": pa.array(file.starts[at:to] + row["first_id"]),
                        "n_tokens": pa.array(np.diff(file.starts[at : to + 1])),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array((file.starts[at : to + 1] - low).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                    at = to
                file.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = max(1, manifest.count())
    return manifest.select("uri", "first_id").repartition(files).mapInArrow(read, schema)


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Round trip through files in the shared folder: what ``read_token_files`` finds there, without ids. An empty table
    gives none; other columns play no part."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "tokens"), vocabulary, **options), with_ids=False)
