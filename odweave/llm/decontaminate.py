"""Benchmark decontamination: SimHash windows of the items' sizes, multi-index Hamming search, exact check.

A window of a document is as many words as an item has. Its 64-bit fingerprint is compared with those of the items of that
size: within a radius of 23 bits at least one of four 16-bit blocks differs by five bits at most, so an index of the blocks'
bytes finds all fingerprints within the radius. What is found counts only if the shingles' weighted Jaccard similarity
(weights: how often a shingle occurs) reaches the threshold.

Only items that share enough shingles with the whole text are looked up, and windows that hold too few shingles of any of them
get no fingerprint: by the same bound the exact check would refuse them. The exact check of an item takes all windows at once:
an occurrence of a shingle that the item has c times counts in the windows that hold it and not its c-th predecessor, which is
a run of window starts; the sums over such runs are the weighted overlaps.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.shingles import shingles, word_hashes
from odweave.llm.tables import texts

WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
_BLOCKS = 4
#: Window starts whose bits are counted at once, and pairs of a window and an item that are compared at once.
_SPAN, _PAIRS = 1 << 16, 1 << 20
#: Items are searched for in blocks of about so many, of about so many bytes; each block is one broadcast index.
ITEMS, ITEM_BYTES = 4096, 16 << 20
_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def plain_words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts words as white space does."""
    return text.lower().encode().translate(_SPACES).split()


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles: bit b is set if more than half of the shingles' hashes have it.

    ``starts`` ascend.
    """
    marks = np.zeros((len(starts), 8), dtype=np.uint8)
    edge = 0
    while edge < len(starts):
        low = int(starts[edge])
        until = int(np.searchsorted(starts, low + _SPAN))
        at = starts[edge:until] - low
        bits = np.unpackbits(hashes[low : low + int(at[-1]) + size].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        marks[edge:until] = np.packbits(2 * (ones[at + size] - ones[at]) > size, axis=1)
        edge = until
    return marks


@dataclass
class SizeClass:
    """The items with one number of shingles, and their block index: ``far[k][byte]`` tells how far the items' byte k is from it."""

    size: int
    items: list[int] = field(default_factory=list)
    marks: np.ndarray | None = None
    far: np.ndarray | None = None

    def index(self, marks: list[np.ndarray], radius: int) -> None:
        self.marks = np.stack(marks)
        keys = np.arange(256, dtype=np.uint8)
        self.far = np.stack([_ONES[keys[:, None] ^ self.marks[None, :, k]] for k in range(8)])

    def search(self, marks: np.ndarray, radius: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) places of all fingerprints within the radius, among the items at ``places`` (all unless given)."""
        places = np.arange(len(self.marks)) if places is None else places
        far = self.far[:, :, places]
        found = np.zeros((len(marks), len(places)), dtype=bool)
        for k in range(0, 8, 8 // _BLOCKS):
            found |= far[k][marks[:, k]] + far[k + 1][marks[:, k + 1]] <= radius // _BLOCKS
        window, item = np.nonzero(found)
        close = _ONES[marks[window] ^ self.marks[places[item]]].sum(axis=1) <= radius
        return window[close], places[item[close]]


@dataclass
class Holders:
    """Which items hold a shingle: those of ``seeds[k]`` are ``items[first[k]:first[k + 1]]``."""

    seeds: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, numbers: list[int], bags: list[np.ndarray]) -> Holders:
        held = np.concatenate(bags)
        order = np.argsort(held, kind="stable")
        seeds, first = np.unique(held[order], return_index=True)
        items = np.repeat(np.array(numbers), [len(b) for b in bags])[order]
        return cls(seeds, np.append(first, len(held)), items)

    def shared(self, used: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items that hold one of the seeds ``used``, and how many of their occurrences in the text each of them explains."""
        n = self.first[used + 1] - self.first[used]
        at = np.arange(n.sum()) + np.repeat(self.first[used] - (np.cumsum(n) - n), n)
        items, which = np.unique(self.items[at], return_inverse=True)
        return items, np.bincount(which, weights=np.repeat(times, n)).astype(np.int64)


def overlaps(places: np.ndarray, kinds: np.ndarray, limits: np.ndarray, starts: int, size: int) -> np.ndarray:
    """Per window start: the sum over kinds of the smaller of its occurrences in the window of ``size`` and its limit.

    ``places`` (ascending) are the occurrences, ``kinds`` what occurs there, ``limits`` the limit of each occurrence's kind.
    """
    order = np.argsort(kinds, kind="stable")
    place, kind, limit = places[order], kinds[order], limits[order]
    back = np.arange(len(order)) - limit
    same = (back >= 0) & (kind[back] == kind)
    low = np.maximum(np.where(same, place[back], -1), place - size) + 1
    high = np.minimum(place, starts - 1)
    some = low <= high
    steps = np.bincount(low[some], minlength=starts + 1) - np.bincount(high[some] + 1, minlength=starts + 1)
    return np.cumsum(steps[:starts])


class ItemIndex:
    """Index of benchmark items; items without words never match."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.ids: list[int] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        self.classes: dict[tuple[int, int], SizeClass] = {}
        marks: dict[tuple[int, int], list[np.ndarray]] = {}
        for key, text in items:
            words = word_hashes(plain_words(text or ""))
            if not len(words):
                continue
            hashes = shingles(words, WORDS)
            kind = (min(WORDS, len(words)), len(hashes))  # words of a shingle, shingles of the item
            self.classes.setdefault(kind, SizeClass(len(hashes))).items.append(len(self.ids))
            marks.setdefault(kind, []).append(fingerprints(hashes, np.array([0]), len(hashes))[0])
            self.ids.append(key)
            self.bags.append(np.unique(hashes, return_counts=True))
        for kind, c in self.classes.items():
            c.index(marks[kind], radius)
        self.sizes = np.zeros(len(self.ids), dtype=np.int64)
        for c in self.classes.values():
            self.sizes[c.items] = c.size
        self.holders: dict[int, Holders] = {}
        for words in {k[0] for k in self.classes}:
            numbers = [i for k, c in self.classes.items() if k[0] == words for i in c.items]
            self.holders[words] = Holders.of(numbers, [self.bags[i][0] for i in numbers])

    def least(self, a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
        """The common shingles that bags of a and b shingles need to reach the similarity."""
        return np.ceil(self.similarity / (1 + self.similarity) * (a + b) - 1e-9)

    def find(self, text: str) -> Iterator[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window for each item found in the text."""
        words = word_hashes(plain_words(text))
        for length, holders in self.holders.items():
            if len(words) < length:
                continue
            hashes = shingles(words, length)
            seed = np.minimum(np.searchsorted(holders.seeds, hashes), len(holders.seeds) - 1)
            hits = np.flatnonzero(holders.seeds[seed] == hashes)
            if not len(hits):
                continue
            used, kinds, times = np.unique(seed[hits], return_inverse=True, return_counts=True)
            items, shared = holders.shared(used, times)
            sizes = self.sizes[items]
            enough = shared >= self.least(np.minimum(sizes, len(hashes)), sizes)
            for size in np.unique(sizes[enough]).tolist():
                found = self._windows(hashes, hits, kinds, holders.seeds[used], items[enough & (sizes == size)], self.classes[length, size])
                for i, similarity, start, n in found:
                    yield self.ids[i], similarity, start, n + length - 1

    def _windows(
        self, hashes: np.ndarray, hits: np.ndarray, kinds: np.ndarray, seeds: np.ndarray, items: np.ndarray, c: SizeClass
    ) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of the best window for each of the ``items``, all of one class.

        ``hits`` are the places of the shingles ``seeds[kinds]``.
        """
        size = min(c.size, len(hashes))

        def limit(k: int) -> np.ndarray:
            held, n = self.bags[items[k]]
            at = np.minimum(np.searchsorted(held, seeds), len(held) - 1)
            return np.where(held[at] == seeds, n[at], 0)

        any_item = np.zeros(len(seeds), dtype=bool)
        for k in range(len(items)):
            any_item |= limit(k) > 0
        before = np.zeros(len(hashes) + 1, dtype=np.int64)
        before[hits[any_item[kinds]] + 1] = 1
        before = np.cumsum(before)
        starts = np.flatnonzero(before[size:] - before[: len(before) - size] >= self.least(size, c.size))
        if not len(starts):
            return
        marks, which = np.unique(fingerprints(hashes, starts, size).view("<u8").ravel(), return_inverse=True)
        marks = marks.view(np.uint8).reshape(-1, 8)
        places = np.searchsorted(c.items, items)
        step = max(1, _PAIRS // len(marks))
        for edge in range(0, len(items), step):
            window, place = c.search(marks, self.radius, places[edge : edge + step])
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            each, first = np.unique(place[order], return_index=True)
            for k, windows in zip(np.searchsorted(places, each).tolist(), np.split(window[order], first[1:]), strict=True):
                near = np.zeros(len(marks), dtype=bool)
                near[windows] = True
                near = starts[near[which]]
                row = limit(k)[kinds]
                mine = row > 0
                common = overlaps(hits[mine], kinds[mine], row[mine], len(hashes) - size + 1, size)[near]
                similarity = common / (size + c.size - common)
                best = int(similarity.argmax())
                if similarity[best] >= self.similarity:
                    yield int(items[k]), float(similarity[best]), int(near[best]), size


def item_blocks(items: DataFrame, similarity: float = SIMILARITY) -> list[Broadcast]:
    """The items (item_id, text) as broadcast indexes of bounded size; any number of items makes more blocks, none is left out."""
    rows = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].alias("text"))
    n, size = rows.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [
        rows.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in rows.filter(place == k).collect()], similarity))
        for k in range(blocks)
    ]


def contaminated(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """Per document and item found in it: doc_id, item_id, similarity, first_word, n_words (of the best window).

    A document shorter than an item is one window. Texts or items that are missing or without words match nothing; an item of
    fewer than five words is one shingle of all its words; a missing doc_id stays missing; repeated rows of either table each
    give their rows; of equally similar windows the first counts; empty tables give no rows; other columns are not read.
    """

    def search(block: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (key, *found)
                    for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)
                    for found in block.value.find(text)
                ]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return run

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    out = rows.mapInArrow(search(blocks[0]), schema)
    for block in blocks[1:]:
        out = out.unionByName(rows.mapInArrow(search(block), schema))
    return out


def keep_clean(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no item is found."""
    column = docs.columns.index("text")

    def search(block: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([next(block.value.find(t), None) is None for t in texts(batch.column(column))], pa.bool_()))

        return run

    for block in blocks:
        docs = docs.mapInArrow(search(block), docs.schema)
    return docs
