"""Token-ID output: Arrow IPC files of equal-length sequences.

One pair of files per range of doc_id: ``NAME.seq.arrow`` holds record batches with
two fixed-size-list columns, ``ids`` and ``mask``, whose value buffers are one flat
run of the range's ids (the last sequence is padded and masked out), so sequence i is
a slice of a memory-mapped buffer; ``NAME.doc.arrow`` holds each document's place.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import blocks, shared_encoder

MANIFEST = "part long, name string, n_docs long, n_tokens long"
PLACES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class _Writer:
    """Cuts a stream of ids into sequences and writes ``rows`` of them a batch. Files
    appear under their final name only when whole, so a task may run twice."""

    def __init__(self, uri: str, name: str, length: int, dtype: str, rows: int):
        self.fs, root = _filesystem(uri)
        self.fs.create_dir(root, recursive=True)
        self.base, self.tmp = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.ids_type = pa.list_(pa.from_numpy_dtype(self.dtype), length)
        self.mask_type = pa.list_(pa.bool_(), length)
        schema = pa.schema([("ids", self.ids_type), ("mask", self.mask_type)])
        self.out = {k: self.fs.open_output_stream(f"{self.tmp}.{k}.arrow") for k in ("seq", "doc")}
        self.seq = ipc.new_file(self.out["seq"], schema)
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.doc = ipc.new_file(self.out["doc"], self.doc_schema)
        self.held, self.n_held, self.total, self.n_docs = [], 0, 0, 0
        self.places: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.places.append((doc_id, self.total, n))
        self.held.append(ids)
        self.total, self.n_held, self.n_docs = self.total + n, self.n_held + n, self.n_docs + 1
        if self.n_held >= self.rows * self.length:
            self._flush(self.rows * self.length)
        if len(self.places) >= 8192:
            self._flush_places()

    def _flush(self, step: int) -> None:
        flat = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        at = 0
        while len(flat) - at >= step:
            self._batch(flat[at : at + step], step)
            at += step
        self.held, self.n_held = [flat[at:].tobytes()], len(flat) - at

    def _batch(self, flat: np.ndarray, n: int) -> None:
        values, mask = np.zeros(n, self.dtype), np.zeros(n, bool)
        values[: len(flat)], mask[: len(flat)] = flat, True
        self.seq.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values), type=self.ids_type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask_type)], names=["ids", "mask"]))

    def _flush_places(self) -> None:
        if self.places:
            self.doc.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.places)], schema=self.doc_schema))
            self.places = []

    def close(self) -> None:
        flat = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        if len(flat):
            self._batch(flat, -(-len(flat) // self.length) * self.length)
        self._flush_places()
        for k, writer in (("seq", self.seq), ("doc", self.doc)):
            writer.close()
            self.out[k].close()
            self.fs.move(f"{self.tmp}.{k}.arrow", f"{self.base}.{k}.arrow")


class TokenFile:
    """Reads one file: ``file[i]`` gives (ids, mask) of sequence i without copying ids;
    ``file.ids(start, n)`` yields the slices that hold ids start .. start + n - 1."""

    def __init__(self, uri: str, name: str):
        fs, root = _filesystem(uri)
        opened = lambda k: pa.memory_map(f"{root}/{name}.{k}.arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{root}/{name}.{k}.arrow")
        self._seq, self._doc = ipc.open_file(opened("seq")), ipc.open_file(opened("doc"))
        self.length = self._seq.schema.field("ids").type.list_size
        self.rows = self._seq.get_batch(0).num_rows if self._seq.num_record_batches else 0
        self._now: tuple[int, pa.RecordBatch | None] = (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._now[0] != k:
            self._now = (k, self._seq.get_batch(k))
        return self._now[1]

    def __len__(self) -> int:
        n = self._seq.num_record_batches
        return self.rows * (n - 1) + self._batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k, r = divmod(i, self.rows)
        b, s = self._batch(k), slice(r * self.length, (r + 1) * self.length)
        return b.column("ids").values.to_numpy()[s], b.column("mask").values.slice(s.start, self.length).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        step = self.rows * self.length
        while n > 0:
            k, at = divmod(start, step)
            take = min(n, step - at)
            yield self._batch(k).column("ids").values.to_numpy()[at : at + take]
            start, n = start + take, n - take

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self._doc.num_record_batches):
            yield self._doc.get_batch(k)


def write_token_files(df: DataFrame, uri: str, tokenizer: str, *, end_id: int = 2, length: int = 2048, dtype: str = "uint16", rows: int = 64) -> DataFrame:
    """Encodes ``text`` of every row (null: empty), appends ``end_id`` and writes the
    ids in ascending (doc_id, text) order under ``uri``, a folder all executors share.
    Returns the manifest: one row per file pair, in order.

    The rows are dealt by ranges of doc_id once; a task holds ``rows`` sequences at a
    time, whatever the size of its range. ``dtype`` must hold every id. Equal doc_ids
    stay in one range, ordered by text; a null doc_id comes first; an empty table
    writes nothing; columns other than doc_id and text are not read.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end, writer, name = None, np.array([end_id], dtype).tobytes(), None, f"part-{part:06d}"
        for frame in frames:
            ids, texts = frame["doc_id"], frame["text"].tolist()
            ids = [None if pd.isna(i) else int(i) for i in ids]
            if writer is None and ids:
                encode, writer = shared_encoder(tokenizer, dtype), _Writer(uri, name, length, dtype, rows)
            for a, b in blocks(texts):
                for doc_id, x in zip(ids[a:b], encode([t or "" for t in texts[a:b]])):
                    writer.add(doc_id, x + end)
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"part": [part], "name": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.total]})

    dealt = df.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    found = dealt.mapInPandas(write, MANIFEST).collect()  # a row per file, not per document
    rows_ = sorted((r.part, r.name, r.n_docs, r.n_tokens) for r in found)
    return spark.createDataFrame(rows_, MANIFEST).coalesce(1)


def read_places(manifest: DataFrame, uri: str) -> DataFrame:
    """Reads the files of a manifest back: each document's global start, its number of
    ids, and the CRC-32 of its ids as little-endian 32-bit integers."""
    spark = manifest.sparkSession
    files, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((r.name, before))
        before += r.n_tokens

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, offset in zip(frame["name"], frame["before"]):
                file = TokenFile(uri, name)
                for docs in file.documents():
                    crcs = []
                    for start, n in zip(docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()):
                        crc = 0
                        for x in file.ids(int(start), int(n)):
                            crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pd.DataFrame({"doc_id": docs.column("doc_id").to_pandas().astype("Int64"), "start": docs.column("start").to_numpy() + offset, "n_tokens": docs.column("n_tokens").to_numpy(), "ids_crc32": crcs})

    if not files:
        return spark.createDataFrame([], PLACES)
    listed = spark.sparkContext.parallelize(files, len(files)).toDF("name string, before long")
    return listed.mapInPandas(read, PLACES)
