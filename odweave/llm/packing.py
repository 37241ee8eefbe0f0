"""Sum-of-squares packing of documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.encoder import id_encoder
from odweave.llm.tables import texts
from odweave.session import materialize

#: Pieces that one task packs; beyond, the pieces are dealt into more groups, whose part-filled sequences are packed anew.
GROUP_PIECES = 50_000


def cut(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """Per piece of at most ``size`` ids: doc_id, piece, start, length, ids_crc32. Only longer documents are cut.

    A missing text is empty (just the end id); a missing doc_id stays missing; repeated rows are cut one by one; an empty
    table gives no pieces; other columns are not read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, step = id_encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * size
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                all_ids = ids.encode(text) + end
                for k, at in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[at : at + step]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, placed one after another.

    With N(g) open bins of residual gap g, a piece goes where the sum of N(g)^2 becomes smallest: into a bin of gap g, which
    is then one of gap g - length (or closed), or into a new bin. Among equals the smallest gap wins.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    bins_of: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    never, used = np.iinfo(np.int64).max, 0
    for i, n in enumerate(lengths.tolist()):
        there = counts[n:]
        change = 2 * (counts[: size - n + 1] - there) + 2  # gap g for g from n to size
        change[0] = 1 - 2 * there[0]  # a bin that becomes full is open no more
        change[there == 0] = never
        change[-1] = 2 * counts[size - n] + 1 if n < size else 0  # a new bin
        gap = n + int(change.argmin())
        if gap == size:
            place, used = used, used + 1
        else:
            place = bins_of[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = place, size - gap
        if gap > n:
            bins_of[gap - n].append(place)
            counts[gap - n] += 1
    return bins, offsets


def pack_group(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing in the better of two orders.

    The method suits a random order, whose last sequences the shortest fifth then fills; few pieces fit better from the
    longest to the shortest.
    """
    falling = np.argsort(-lengths, kind="stable")
    short = np.zeros(len(lengths), dtype=bool)
    short[falling[len(falling) - len(falling) // 5 :]] = True
    mixed = np.random.default_rng(0).permutation(len(lengths))
    best = None
    for order in (falling, np.concatenate([mixed[~short[mixed]], falling[short[falling]]])):
        bins, offsets = sum_of_squares(lengths[order], size)
        if best is None or bins.max() < best[0].max():
            best = np.empty_like(bins), np.empty_like(offsets)
            best[0][order], best[1][order] = bins, offsets
    return best


def _placed(pieces: DataFrame, size: int, groups: int, turn: int) -> DataFrame:
    """Adds sequence_id, offset and gap (what the piece's sequence leaves free) to pieces dealt into groups by a hash of their row."""

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        lengths = rows["length"].to_numpy()
        bins, offsets = pack_group(lengths, size)
        gaps = size - np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        rows = rows.drop_columns(["group"])
        for name, values in (("sequence_id", bins + (turn << 58) + (key[0].as_py() << 32)), ("offset", offsets), ("gap", gaps)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group").applyInArrow(place, f"{schema}, sequence_id bigint, offset bigint, gap bigint")


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``size``: at most ``size`` ids per sequence, no gaps.

    The pieces are stored once, numbered and dealt into groups by a hash of their number, so that neither a document nor a
    source decides where a piece goes and no group grows with the table. Of several groups the sequences that are full stay;
    the pieces of all others are dealt anew into fewer groups, round by round, until one group or few full sequences are left
    (a round that fills less than half of its pieces' sequences is the last).
    """
    rest = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    left, turn, out = rest.count(), 0, None
    while True:
        groups = max(1, -(-left // GROUP_PIECES))
        placed = _placed(rest, size, groups, turn)
        again = 0
        if groups > 1:
            placed = materialize(placed)
            again = placed.filter("gap > 0").count()
        last = not again or 2 * again > left
        kept = placed if last else placed.filter("gap = 0")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out.drop("row", "gap")
        rest, left, turn = placed.filter("gap > 0").drop("sequence_id", "offset", "gap"), again, turn + 1
