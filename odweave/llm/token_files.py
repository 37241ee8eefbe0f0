"""Token-id files with directly addressable codes.

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id; a bitmap tells which ids go on, and level
k + 1 holds the next chunk of just those. A rank directory (ones before every 512th bit) leads from an id to its chunk on
the next level, so any token is read from one chunk, one bit and one rank per level: no block is decoded.

A file: magic; segments; a directory (JSON) of the segments; its length (8 bytes); magic. A segment: per level its chunks, its
bitmap and its rank directory; then the documents' ids, whether they are there, and where each document starts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.encoder import id_encoder
from odweave.llm.files import new_file, store
from odweave.llm.tables import texts

_MAGIC = b"DACTOK01"
_RANK = 512
#: A segment is closed after the document with which it has so many ids.
SEGMENT_IDS = 1 << 20


class Level:
    """One chunk level: chunks, continuation bits, ones before every 512th bit."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    def rank(self, i: int) -> int:
        """How many of the first ``i`` ids of this level go on."""
        block = i // _RANK
        tail = np.unpackbits(self.bits[block * (_RANK // 8) : (i + 7) // 8], bitorder="little")[: i - block * _RANK]
        return int(self.ranks[block]) + int(tail.sum())


def encode_levels(ids: np.ndarray) -> list[Level]:
    levels = []
    while True:
        rest = ids >> 8
        more = rest > 0
        ones = np.concatenate([[0], np.cumsum(more)])[::_RANK].astype("<u4")
        levels.append(Level((ids & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), ones))
        if not more.any():
            return levels
        ids = rest[more]


def read_tokens(levels: list[Level], start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` up to ``stop``; those that go on lie side by side on the next level."""
    out = np.zeros(stop - start, dtype="<u4")
    at = np.arange(stop - start)
    for k, level in enumerate(levels):
        out[at] |= level.chunks[start:stop].astype("<u4") << np.uint32(8 * k)
        more = np.unpackbits(level.bits[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
        at = at[more]
        if not len(at):
            break
        start = level.rank(start)
        stop = start + len(at)
    return out


class SegmentWriter:
    def __init__(self, out):
        self.out, self.place, self.directory = out, 0, []
        self.keys: list[int | None] = []
        self.ids: list[bytes] = []
        self.held = self.n_docs = self.n_ids = 0
        self._put(_MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.held += len(ids) // 4
        if self.held >= SEGMENT_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.keys:
            return
        lengths = np.array([len(x) // 4 for x in self.ids])
        levels = encode_levels(np.frombuffer(b"".join(self.ids), dtype="<u4"))
        entry = {"offset": self.place, "docs": len(self.keys), "levels": [len(x.chunks) for x in levels]}
        for level in levels:
            self._put(level.chunks.tobytes() + level.bits.tobytes() + level.ranks.tobytes())
        there = np.array([k is not None for k in self.keys], dtype=np.uint8)
        keys = np.array([k or 0 for k in self.keys], dtype="<i8")
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        self._put(keys.tobytes() + there.tobytes() + starts.tobytes())
        self.directory.append(entry | {"length": self.place - entry["offset"]})
        self.n_docs += len(self.keys)
        self.n_ids += int(starts[-1])
        self.keys, self.ids, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        footer = json.dumps(self.directory).encode()
        self._put(footer + len(footer).to_bytes(8, "little") + _MAGIC)


class Segment:
    """A segment in memory: ``token(i)`` and ``document(d)`` read it in place."""

    def __init__(self, data: bytes, entry: dict):
        place = 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal place
            part = np.frombuffer(data, dtype=kind, count=n, offset=place)
            place += part.nbytes
            return part

        self.levels = [Level(take(n, "u1"), take((n + 7) // 8, "u1"), take(n // _RANK + 1, "<u4")) for n in entry["levels"]]
        self.keys, self.there = take(entry["docs"], "<i8"), take(entry["docs"], "u1")
        self.starts = take(entry["docs"] + 1, "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        return int(read_tokens(self.levels, i, i + 1)[0])

    def document(self, d: int) -> np.ndarray:
        return read_tokens(self.levels, int(self.starts[d]), int(self.starts[d + 1]))


def open_segments(uri: str) -> Iterator[Segment]:
    """The segments of a file, found by its directory and read one after another."""
    fs, path = store(uri)
    with fs.open_input_file(path) as f:
        end = f.size() - len(_MAGIC)
        f.seek(end - 8)
        length = int.from_bytes(f.read(8), "little")
        if f.read(len(_MAGIC)) != _MAGIC:
            raise ValueError(f"{uri} is no token file")
        f.seek(end - 8 - length)
        for entry in json.loads(f.read(length)):
            f.seek(entry["offset"])
            yield Segment(f.read(entry["length"]), entry)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes token files in ascending doc_id order, one per range of ids.

    Gives the list of files (also stored as ``folder``/files): file, path, n_docs, n_ids. A missing text is empty: just the
    end id. Missing doc_ids come first; repeated rows are written one by one, those of one doc_id in order of a hash of their
    text; an empty table gives no documents; other columns are not read. A task that is run again writes a file of a new
    name; only files in the list count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, out, end = id_encoder(tokenizer), TaskContext.get().partitionId(), None, end_id.to_bytes(4, "little")
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if out is None:
                    uri = new_file(folder, task, ".dac")
                    fs, path = store(uri)
                    stream = fs.open_output_stream(path)
                    out = SegmentWriter(stream)
                out.add(key, ids.encode(text) + end)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": task, "path": uri, "n_docs": out.n_docs, "n_ids": out.n_ids}])

    fs, path = store(folder)
    fs.create_dir(path)
    order = [F.col("doc_id").asc_nulls_first(), F.col("same")]
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).withColumn("same", F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(write, "file bigint, path string, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/files")
    return docs.sparkSession.read.parquet(f"{folder}/files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, each by direct access."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for segment in open_segments(row["path"]):
                    n = np.diff(segment.starts)
                    crc = [zlib.crc32(segment.document(d).tobytes()) for d in range(len(n))]
                    keys = pa.array(segment.keys, mask=segment.there == 0)
                    columns = [keys, pa.array(segment.starts[:-1] + start), pa.array(n), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(segment.starts[-1])

    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    spread = placed.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
