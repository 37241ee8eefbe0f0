"""Importance resampling towards a target's distribution of hashed word runs.

A dictionary automaton (Aho-Corasick) over the delimiter-bounded distinct words of a slice of text carries each word's
CRC-32 and length as its payload. One scan of the slice emits the payloads; the checksum of two or three adjacent words is
composed from theirs, never from letters. A first scan counts buckets, a second one sums the gains of each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.operators.windows import add_row_id
from odweave.session import materialize

#: Bytes of text that share one automaton; its size is bounded by theirs.
SLICE = 4 << 20
#: Words of a run, at most.
RUN = 3
# Letters A-Z become lower case, every other ASCII byte but letters and digits is a delimiter, all other bytes are letters.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@lru_cache(maxsize=4)
def _shifts(level: int) -> np.ndarray:
    """What n * 256**level zero bytes make of a checksum, for n below 256: [n, byte of the checksum, its value]."""
    table = np.zeros((256, 4, 256), dtype=np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    if level:
        lower, all_but_one = _shifts(level - 1)[1], _shifts(level - 1)[255]
        unit = _applied(lower, _applied(all_but_one, table[0]))
    else:
        zero_byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
        unit = zero_byte[table[0] & 255] ^ (table[0] >> 8)
    for n in range(1, 256):
        table[n] = _applied(unit, table[n - 1])
    return table


def _applied(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 255] ^ step[1][crc >> 8 & 255] ^ step[2][crc >> 16 & 255] ^ step[3][crc >> 24]


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings written one after the other, from their checksums and the second one's length in bytes."""
    level, rest = 0, length
    while rest.any():
        table, n = _shifts(level), rest & 255
        first = table[n, 0, first & 255] ^ table[n, 1, first >> 8 & 255] ^ table[n, 2, first >> 16 & 255] ^ table[n, 3, first >> 24]
        level, rest = level + 1, rest >> 8
    return first ^ second


def _pieces(texts: Iterable[str | None], size: int) -> Iterator[tuple[int, bytes, int]]:
    """(document, lower-cased bytes, words repeated from the piece before): a text longer than ``size`` is cut between words."""
    for doc, text in enumerate(texts):
        rest, known = (text or "").encode().translate(_LETTERS), b""
        while len(rest) > size:
            cut = rest.find(b" ", size)
            if cut < 0:
                break
            piece = known + b" " + rest[:cut]
            yield doc, piece, len(known.split())
            known, rest = b" ".join(piece.rsplit(None, RUN - 1)[1 - RUN :]), rest[cut:]
        yield doc, known + b" " + rest, len(known.split())


def _slices(texts: Iterable[str | None], size: int) -> Iterator[list[tuple[int, bytes, int]]]:
    held, total = [], 0
    for piece in _pieces(texts, size):
        if held and total + len(piece[1]) > size:
            yield held
            held, total = [], 0
        held.append(piece)
        total += len(piece[1])
    if held:
        yield held


def _dictionary(pieces: list[tuple[int, bytes, int]]) -> ahocorasick.Automaton:
    """The distinct words between delimiters; payload: length in bytes, then CRC-32."""
    found = ahocorasick.Automaton()
    for word in {word for _, piece, _ in pieces for word in piece.split()}:
        found.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
    if len(found):
        found.make_automaton()
    return found


def features(texts: Iterable[str | None], buckets: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: the document of each word, and the document and bucket of each run of 1 to 3 words."""
    space = np.uint32(zlib.crc32(b" "))
    for pieces in _slices(texts, size):
        automaton = _dictionary(pieces)
        if not len(automaton):
            continue
        emitted: list[int] = []
        counts = np.zeros(len(pieces), dtype=np.int64)
        for k, (_, piece, _) in enumerate(pieces):
            before = len(emitted)
            emitted += [payload for _, payload in automaton.iter(f" {piece.decode('latin-1')} ")]
            counts[k] = len(emitted) - before
        payload = np.array(emitted, dtype=np.int64)
        crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
        doc = np.repeat([d for d, _, _ in pieces], counts)
        place = np.arange(len(payload)) - np.repeat(np.cumsum(counts) - counts, counts)
        new = place >= np.repeat([known for _, _, known in pieces], counts)
        spaced = joined_crc(np.full(len(crc), space), crc, length)
        runs, docs, found = crc, [doc[new]], [crc[new] % buckets]
        for words in range(2, RUN + 1):
            runs = joined_crc(np.concatenate([runs[:1], runs[:-1]]), spaced, length + 1)
            whole = new & (place >= words - 1)
            docs.append(doc[whole])
            found.append(runs[whole] % buckets)
        yield doc[new], np.concatenate(docs), np.concatenate(found)


def bucket_counts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """Per bucket that occurs: how many runs of all texts fall into it. A task gives each bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column(0).to_pylist(), buckets):
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    parts = docs.select(docs[text].alias("t")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """Per bucket: a thousand times the logarithm of the target's smoothed share over that of all documents, rounded down.

    Only the counts of the buckets, a fixed number, come to the driver.
    """
    counts = [np.zeros(buckets), np.zeros(buckets)]
    for side, table in zip(counts, (docs, target), strict=True):
        for row in bucket_counts(table, buckets, text).collect():
            side[row["bucket"]] = row["n"]
    (s, t) = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_features and weight, the sum of the gains of its runs."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = gain.value
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), dtype=np.int64)
            for word, doc, bucket in features(batch.column(1).to_pylist(), len(gained)):
                sums[0] += np.bincount(word, minlength=batch.num_rows)
                sums[1] += np.bincount(doc, minlength=batch.num_rows)
                sums[2] += np.bincount(doc, weights=gained[bucket], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["k", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(weigh, f"k {kind}, n_words bigint, n_features bigint, weight bigint")
    return made.withColumnRenamed("k", key)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: key, n_features, weight, score, rank.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; features are all runs of 1 to 3 words. The
    score is the weight plus Gumbel noise from a hash of seed and key. Of the N rows with ``least_words`` words or more,
    the floor(percent * N / 100) highest scores get ranks from 1, ties to the smaller key; all others have no rank.

    A missing text has no words (weight 0); a missing key counts as an empty string in the hash and comes last among ties;
    repeated rows are ranked one by one; with an empty ``target`` its shares are even; an empty table gives no rows; other
    columns are not read. Texts of any length are scanned whole, in slices.
    """
    gain = docs.sparkSession.sparkContext.broadcast(gains(docs, target, buckets, text))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    uniform = (drawn.cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 32))
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = materialize(weights(docs, gain, key, text).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    number = scored.filter(able).agg(F.floor(F.count(F.lit(1)) * percent / 100)).scalar()
    ranked = add_row_id(scored.filter(able), ["-score", key], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= number, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(key, "n_features", "weight", "score", "rank")
